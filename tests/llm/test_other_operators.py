"""Brute-force twins of the operators that stand outside the pipeline."""

import hashlib
import io
import random
import re
import zipfile
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest

from reelspark.llm import linededup, queries, secrets, tokens, topk, warc
from reelspark.llm.common import work_dir

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


# top-k


def brute_top(vectors, k, mod):
    fine = {i: np.floor(64 * np.array(v, float)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, x in fine.items():
        if q % mod == 0:
            s = sorted((-int(x @ y), i) for i, y in fine.items() if i != q and len(x) == len(y) > 0)
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def top(spark, data, k, mod=2):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    v = topk.as_integers(df)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where(f"vec_id % {mod} = 0"), v, k).collect())


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_top_k(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rnd = np.random.default_rng(3)
    near = rnd.normal(size=(5, 6))
    data = [(i, (near[i % 5] + 0.2 * rnd.normal(size=6)).tolist(), 0) for i in range(300)]
    data += [(300 + i, [1.0, 0.0, 0.5, 0.0, 0.0, 0.25], 0) for i in range(150)]  # many ties
    data += [(900, None, 0), (902, [1.0, None, 1.0, 0.0, 0.0, 0.0], 0), (904, [float("nan")] * 6, 0), (906, [float("inf")] + [0.0] * 5, 0), (908, [], 0), (910, [3.0, 4.0], 0), (911, [1.0, 1.0], 0)]
    want = brute_top([(i, np.float32(v).tolist() if v is not None and None not in v else v) for i, v, _ in data], 7, 2)
    assert top(spark, data, 7) == want


def test_top_k_visits_few_leaves():
    """A tree of many leaves: near queries see a small part of them."""
    rnd = np.random.default_rng(5)
    x = np.floor(64 * (rnd.normal(size=(40, 8))[rnd.integers(0, 40, 5000)] * 4 + 0.1 * rnd.normal(size=(5000, 8))))
    tree = topk.BallTree(np.arange(5000), x)
    leaves = sum(not left for left in tree.left)
    own = np.arange(200)
    scores, found = np.full((200, 5), -np.inf), np.full((200, 5), topk.NONE)
    tree.search(x[:200], own, scores, found, np.full(200, -np.inf))
    s = x[:200] @ x.T
    s[own, own] = -np.inf
    assert (np.sort(s, axis=1)[:, :-6:-1] == scores).all() and leaves > 60 and tree.visited < 0.2 * leaves * 200


def test_top_k_lists_few_shards(spark, monkeypatch):
    """A vector of many copies, and clusters: of all queries and shards few are listed, and ties go to the smaller ids."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    listed, real = [], topk.bounded
    monkeypatch.setattr(topk, "bounded", lambda *a: listed.append(real(*a)) or listed[-1])
    rnd = np.random.default_rng(6)
    near = rnd.normal(size=(25, 6)) * 3
    data = [(i, (near[i % 25] + 0.05 * rnd.normal(size=6)).tolist() if i % 3 else [4.0, -4.0, 4.0, 0.0, 0.0, 2.0], 0) for i in range(1500)]
    assert top(spark, data, 5, 20) == brute_top([(i, np.float32(v).tolist()) for i, v, _ in data], 5, 20)
    queries, shards = 75, 1500 / 40
    assert sum(df.count() for df in listed) < 0.4 * queries * shards


def test_top_k_small(spark):
    assert top(spark, [], 5) == []
    assert top(spark, [(0, [1.0, 2.0], 1)], 5) == []
    assert top(spark, [(0, [1.0], 1), (0, [1.0], 1), (1, [2.0], 1), (1, [2.0], 1)], 5) == [(0, 1, 1, 64 * 128)]


def test_ball_tree_random():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 300, 1000):
        x = np.floor(8 * rnd.normal(size=(n, 3)))
        tree = topk.BallTree(np.arange(n), x)
        q, own = x[: min(n, 50)], np.arange(min(n, 50))
        scores, found = np.full((len(q), 4), -np.inf), np.full((len(q), 4), topk.NONE)
        tree.search(q, own, scores, found, np.full(len(q), -np.inf))
        for i in own:
            s = sorted((-(q[i] @ x[j]), j) for j in range(n) if j != i)[:4]
            assert [(-a, b) for a, b in zip(scores[i], found[i], strict=True) if np.isfinite(a)] == s


# token counts


def test_token_rollup(spark):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rows(queries.op2_token_counts(spark, SF))}
    e, first, want = tokens.encoder(tokens.VOCABULARY), {}, defaultdict(lambda: [0, 0])
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        if first.setdefault(d.text, d.doc_id) != d.doc_id:
            continue
        text = "\n".join(dict.fromkeys(d.text.split("\n")))
        for name, n in (("byte_bpe_50k", len(e.encode_ordinary(text))), ("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text)))):
            t = want[d.source, d.lang, name]
            t[0], t[1] = t[0] + 1, t[1] + n
    assert got == {k: tuple(v) for k, v in want.items()}


def test_token_rollup_odd_ids(spark, tmp_path):
    """Null doc_ids, and texts that share one: each row is revised by its own counts."""
    data = [(None, "a b\na b\nc"), (None, "a b\na b\nc"), (None, "plain"), (1, "x y\nx y"), (1, "other words here"), (1, "x y\nx y"), (2, "first"), (3, "first"), (3, "q r\nq r\nq r"), (4, "x y\nx y"), (5, None), (None, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en" if t != "plain" else None, "s") for i, t in data], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    e, want = tokens.encoder(tokens.VOCABULARY), defaultdict(lambda: [0, 0])
    for i, t in data:
        if i is not None and t is not None and any(j is not None and j < i and s == t for j, s in data):
            continue
        text = "\n".join(dict.fromkeys((t or "").split("\n")))
        for name, n in (("byte_bpe_50k", len(e.encode_ordinary(text))), ("words-1", len(text.split()))):
            w = want["s", "en" if t != "plain" else None, name]
            w[0], w[1] = w[0] + 1, w[1] + n
    got = rows(tokens.maintained(spark, str(tmp_path)))
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in got} == {k: tuple(v) for k, v in want.items()}


def test_rollup_commits(spark, odd_docs, no_docs):
    r = tokens.Rollup(spark, work_dir(spark, "rollup"))
    assert r.totals().count() == 0
    counts = tokens.counted(odd_docs).cache()
    assert r.commit("a", tokens.signed(counts, 1)) and not r.commit("a", tokens.signed(counts, 1))
    published, r.published = r.published, lambda batch: calls.append(batch) or (len(calls) > 1 and published(batch))  # a race: it isn't there when looked for
    calls = []
    assert not r.commit("a", tokens.signed(counts, 1)) and len(calls) == 2
    r.published = published
    once = sorted(map(str, r.totals().collect()))
    assert sum(x.n_docs for x in r.totals().where("tokenizer = 'words-1'").collect()) == odd_docs.count()
    assert r.commit("empty", tokens.signed(tokens.counted(no_docs), 1)) and sorted(map(str, r.totals().collect())) == once
    assert r.commit("gone", tokens.signed(counts, -1)) and r.totals().count() == 0


# lines


def brute_lines(docs, least, words):
    """[(doc_id, text) -> deleted places] by looking at every window."""
    keys = sorted({(d.doc_id is None, d.doc_id, hashlib.md5(d.text.encode()).hexdigest(), d.text) for d in docs if d.text is not None}, key=lambda k: (k[0], k[1] or 0, k[2]))
    first, gone = {}, defaultdict(set)
    for k in keys:
        lines = k[3].split("\n")
        for width in [x for x in (1, 2, 4) if x < least] + [least]:
            for i in range(len(lines) - width + 1):
                w = tuple(lines[i : i + width])
                if width < least and len(re.findall(r"[^\x20\x09-\x0D]+", "\n".join(w))) < words:
                    continue
                if (f := first.setdefault(w, (k, i))) != (k, i):
                    start = max(i, f[1] + width) if f[0] == k else i
                    gone[k[1], k[3]].update(range(start, i + width))
    return gone


@pytest.mark.parametrize(("least", "words"), [(1, 50), (2, 50), (3, 3), (3, 2), (5, 4)])
def test_line_dedup(spark, odd_docs, no_docs, least, words):
    rnd = random.Random(least)
    base = [(100 + i, "\n".join(rnd.choice(("a", "b", "c d", "e f g", "")) for _ in range(rnd.randint(0, 30))), "en", "s") for i in range(40)]
    base += [(200, "\n".join(["same"] * 20), "en", "s"), (200, "other\ntext", "en", "s"), (201, "\n\n\n", "en", "s"), (201, "\n\n\n", "en", "s")]
    docs = odd_docs.unionByName(spark.createDataFrame(base, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    gone, got = brute_lines(docs.collect(), least, words), rows(linededup.deduplicated_lines(docs, least, words).withColumn("n", queries.F.lit(0)))
    texts = docs.collect()
    assert len(got) == len(texts)
    want = Counter()
    for d in texts:
        dead = gone.get((d.doc_id, d.text), set())
        lines = d.text.split("\n") if d.text is not None else []
        want[d.doc_id, None if d.text is None else "\n".join(x for i, x in enumerate(lines) if i not in dead), len(lines), len(dead)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == want
    assert linededup.deduplicated_lines(no_docs, least).count() == 0


def test_line_words(spark):
    lines = ["", " ", "a", "a b", " a b", "a  b", "a b ", "a\tb", "\r", "a b\r", "é ü ß", "a\u00a0b c", "a\x0bb", "x " * 60, "a b\x0c c"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", linededup._line_words(queries.F.col("line")).alias("n")).collect()
    assert all(r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.line)) for r in got) and len(got) == len(lines)


# secrets


def brute_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secret_scan(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    more = [(50, 'ſecret token="abc" TOKEN : "abcdefg1" x', "en", "a"), (51, f"é use {key} here", "en", "a"), (52, "some_function_name_of_several_words and SomeVeryLongIdentifierName1x", "en", "a"), (53, "token=token=abcdef AKIAABC 0123456789abcdef0123456789abcdef00", "en", "a"), (54, "aaaaaaaaaabbbbbbbbbbb1111111111", "en", "a")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", queries.F.col("doc_id") + 1000), allowMissingColumns=True)
    got = rows(secrets.scan(docs))
    texts = docs.collect()
    assert len(got) == len(texts)
    want = Counter((d.doc_id, hashlib.sha256(",".join(b).encode()).hexdigest(), *(sum(x.startswith(k) for x in b) for k in ("assign", "access", "hex"))) for d in texts for b in [brute_base(d.text)])
    assert Counter((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    for d in texts:
        assert set(brute_base(d.text)) <= set(filter(None, by[d.doc_id]["spans"].split(",")))
    assert by[51]["spans"] == f"random:6:{6 + 44}" and by[52]["n_random"] == 0 and by[54]["n_random"] == 0
    assert secrets.scan(no_docs).count() == 0


def test_randomness_is_calibrated():
    """Under the null the battery rejects no oftener than it says; ordinary identifiers are rejected."""
    rnd = random.Random(2)
    for kind, alphabet in secrets.ALPHABETS.items():
        ps = [secrets.randomness("".join(rnd.choice(alphabet) for _ in range(40)), kind) for _ in range(400)]
        assert sum(p < 0.05 for p in ps) / 400 < 0.09
    assert secrets.randomness("ab12" * 10, "base36") < 1e-3 and secrets.randomness("0123456789abcdef" * 2, "hex") < 0.05


def brute_random(docs, rate=0.05):
    """[(doc_id, spans of kind random)] by ranking the p-value of every distinct token."""
    found, pairs = [], np.zeros(729, np.int64)
    for d in docs:
        base = [tuple(map(int, b.split(":")[1:])) for b in brute_base(d.text)]
        tokens = list(secrets.TOKEN.finditer(d.text or ""))
        shut = {i for x, y in [*base, *(m.span() for m in tokens)] for i in range(x, y)}
        low = [0, *(0 if i in shut or not re.fullmatch("[A-Za-z]", c) else ord(c.lower()) - 96 for i, c in enumerate(d.text or "")), 0]
        for x, y in zip(low, low[1:], strict=False):
            pairs[27 * x + y] += (x, y) != (0, 0)
        for m in tokens:
            if not any(x < m.end() and m.start() < y for x, y in base) and (kind := secrets.encoding(m[0])):
                found.append((d.doc_id, m.span(), m[0], secrets.stratum(kind, len(secrets.tested(m[0]))), secrets.randomness(m[0], kind)))
    known = secrets.calibrated(sorted({s for *_, s, _ in found}), pairs)
    p = {t: NormalDist().cdf(secrets.deviate(secrets.scores(np.array([x]))[0], known[s])) for _, _, t, s, x in found}
    cut = max((x for i, x in enumerate(sorted(p.values()), 1) if x <= rate * i / len(p)), default=-1)
    return Counter((d, f"random:{a}:{b}") for d, (a, b), t, _, _ in found if p[t] <= cut)


def test_hot_stratum(spark):
    """Ordinary tokens are told from random ones however small their share of the stratum, and copies of one random token don't lower the bar for others."""
    rnd = random.Random(6)
    draw = lambda: "".join(rnd.choice(secrets.ALPHABETS["base62"]) for _ in range(40))
    hot = draw()
    texts = [f"copy {hot} of one page" for _ in range(1500)] + [f"key {draw()} here" for _ in range(1500)] + ["a clean " + "aB1" * 14 + " text"] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(secrets.scan(docs))
    assert [r["n_random"] for r in got if r["doc_id"] >= 3000] == [0] * 6
    assert Counter((r["doc_id"], s) for r in got for s in r["spans"].split(",") if s) == brute_random(docs.collect())


def test_letters_and_digits_alone(spark):
    """Random letters of one case and random digits are secrets; words, numbers in order and short ones are not."""
    rnd = random.Random(8)
    draw = lambda a, n=32: "".join(rnd.choice(a) for _ in range(n))
    keys = [draw(secrets.LOWER), draw(secrets.UPPER), draw(secrets.DIGITS, 22), draw(secrets.LOWER).capitalize(), "-".join(draw(secrets.LOWER, 8) for _ in range(4))]
    words = ["internationalizations", "Geschwindigkeitsbegrenzung", "get_customer_account_balance", "usr/local/lib/python/site-packages", "MAX_CONNECTION_POOL_SIZE_LIMIT", "article-about-cats-and-dogs-2024", "0000000000000000000001", "-" * 40, "a" + "-" * 30, "foo-bar-baz-qux-quux"]
    scanned = lambda x: [r["spans"] for r in sorted(rows(secrets.scan(spark.createDataFrame([(i, f"é {t} here") for i, t in enumerate(x)], "doc_id long, text string"))), key=lambda r: r["doc_id"])]
    assert scanned(keys) == [f"random:2:{2 + len(x)}" for x in keys]
    assert scanned(words) == [""] * len(words)


WORDS = "get set user name account balance value index list file path data table row column key map tree query option event view model state item count total order customer com example project utils string buffer stream input thread lock queue client server request header token auth session cache page block merge split group filter sort rank score label train test".split()


def test_identifiers_and_secrets(spark):
    """Of made-up identifiers hardly any is reported, of random tokens of 40 characters most, in one table and identifiers alone."""
    rnd = random.Random(4)
    ids = []
    while len(ids) < 2400:
        ws = [rnd.choice(WORDS) + (str(rnd.randint(0, 99)) if rnd.random() < 0.4 else "") for _ in range(rnd.randint(3, 6))]
        t = (ws[0] + "".join(map(str.capitalize, ws[1:])), "_".join(ws), "".join(ws), "/".join(ws), "-".join(ws).upper())[len(ids) % 5]
        ids += [t] if len(t) >= 20 else []
    keys = [k for a in secrets.ALPHABETS.values() for k in ("".join(rnd.choice(a) for _ in range(40)) for _ in range(20)) if not secrets.HEX.search(k)]
    scan = lambda x: [r["n_random"] for r in sorted(rows(secrets.scan(spark.createDataFrame([(i, f"the value {t} here") for i, t in enumerate(x)], "doc_id long, text string"))), key=lambda r: r["doc_id"])]
    assert sum(scan(ids)) <= 2
    got = scan(ids + keys)
    assert sum(got[: len(ids)]) <= 0.1 * len(keys) and sum(got[len(ids) :]) >= 0.7 * len(keys)


def test_made_up_tokens_are_ordinary():
    """p-values of ordinary tokens that the calibration has not seen are no smaller than they say."""
    steps = secrets.chain(np.zeros(729))
    for name in ("lower:8", "base36:10", "base62:9", "base64url:11", "digits:9", "hex:8"):
        kind, n = name.partition(":")[0], secrets.least_length(name)
        middle, spread = secrets.calibrated([name], np.zeros(729))[name][:2]
        z = (secrets.scores(secrets.battery(secrets.ordinary(kind, n, steps, 2000, seed=99), kind)) - middle) / spread
        for p in (0.05, 0.01, 0.001):
            assert (z <= NormalDist().inv_cdf(p)).mean() <= 2 * p + 0.003, (name, p)


# archives


def test_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    long = "y" * 400_000
    same = "<html>" + "z" * 200
    more = [(9001, "http://x/ä b%20c\nd", same), (9000, None, same), (9002, "u", same), (9003, "", None), (9004, "v", ""), (9005, "w", "short"), (9006, "w", "short"), (9007, "l", long), (9008, "l", "\r\n\r\nnot a header"), (9000, "again", same)]
    every = pages.unionByName(spark.createDataFrame(more, "page_id long, url string, html string")).withColumn("digest", queries.F.lit("clash"))
    got = rows(warc.archive_round_trip(spark, every))
    first = {}
    for p in sorted(every.collect(), key=lambda r: r.page_id):
        first.setdefault(p.html or "", p.page_id)
    want = Counter()
    for p in every.collect():
        raw = (p.html or "").encode()
        ref = first[p.html or ""] if len(raw) >= 100 and first[p.html or ""] != p.page_id else None
        want[p.page_id, p.url or None, len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref is None else "revisit", ref, raw if ref is None else None] += 1
    assert Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is not None else None) for r in got) == want
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_packages_are_plain_zip_files(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = warc.write_packages(warc.payloads(pages), work_dir(spark, "zip"), package_bytes=20_000).collect()
    assert len(made) > 2 and sum(m.records for m in made) == pages.count()
    for m in made:
        with zipfile.ZipFile(m.path.removeprefix("file://")) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX}
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            z.writestr(f"m{i}", b"data %d" % i * 9)
        z.comment = b"PK\x05\x06 in a comment is no directory" [:3]
    found = warc.members(raw, len(raw.getvalue()))
    assert b"PK\x06\x06" in raw.getvalue() and len(found) == 5
    assert all(raw.getvalue()[a : a + n] == b"data %d" % i * 9 for i, (a, n) in enumerate(found[f"m{i}"] for i in range(5)))
