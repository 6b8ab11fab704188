"""Brute-force twins of the operators that the pipeline uses."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from reelspark.llm import decontamination, langid, mixing, neardup, queries, sharding


def rows(df):
    return [r.asDict() for r in df.collect()]


# sharding


def least_capacity(sizes, n):
    def fits(c):
        used, load = 1, 0
        for s in sizes:
            if s > c:
                return False
            if load + s > c:
                used, load = used + 1, 0
            load += s
        return used <= n

    lo, hi = 1, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def check_shards(got, texts, n):
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    groups = defaultdict(int)
    for t in texts:
        key = hashlib.md5(t.encode()).hexdigest() if t is not None else "0" * 32
        groups[key] += len((t or "").encode()) + 1
    want = least_capacity([groups[k] for k in sorted(groups)], n)
    assert max(sum(r["size"] for r in s) for s in by.values()) == want
    assert set(by) <= set(range(n))


def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rows(queries.op7_sharding(spark, sf))
    assert len(got) == len(texts)
    check_shards(got, texts.values(), 16)
    where = defaultdict(set)
    for r in got:
        t = texts[r["doc_id"]]
        where[t].add(r["shard"])
        assert r["text_crc32"] == zlib.crc32(t.encode()) and r["size"] == len(t.encode()) + 1 and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("n", [1, 3, 16])
def test_sharding_odd(spark, odd_docs, no_docs, n):
    got = rows(sharding.shard_by_bytes(odd_docs, n, keep=("lang",)))
    check_shards(got, [r.text for r in odd_docs.collect()], n)
    assert sharding.shard_by_bytes(no_docs, n).count() == 0


def test_sharding_hot(spark):
    docs = spark.createDataFrame([(i, "same text " * 20 if i % 3 else f"text {i} " * (i % 17)) for i in range(900)], "doc_id long, text string")
    got = rows(sharding.shard_by_bytes(docs, 8))
    check_shards(got, [r.text for r in docs.collect()], 8)
    assert len({r["shard"] for r in got}) > 3  # the rest is spread, not left in the first shards


# mixing


def water_fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [k for k in names if k not in full]
        level = (total - sum(full.values())) / sum(w[k] for k in rest) if rest else 0
        over = [k for k in rest if w[k] * level > most * sizes[k]]
        if not over:
            return full | {k: w[k] * level for k in rest}
        full |= {k: most * sizes[k] for k in over}


def check_mix(got, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in docs:
        sizes[r.source] += words(r.text)
    want, longest = water_fill(sizes), defaultdict(int)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for k, v in want.items():
        assert abs(taken[k] - v) <= longest[k] + 1e-6, (k, taken[k], v)


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(mixing.mix_sizes(docs))
    assert len(got) == docs.count()
    check_mix(got, docs.collect())
    key = lambda x: sorted((r["doc_id"], r["taken"]) for r in x)
    assert key(got) == key(rows(mixing.mix_sizes(docs.repartition(7))))
    # rates are the exponential tilts that meet each source's target
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for s in by.values():
        assert math.isclose(sum(r["rate"] * r["size"] for r in s), s[0]["target"], rel_tol=1e-3)
        tilts = [math.log(r["rate"]) / r["size"] for r in s if r["size"] and r["rate"] < 3]
        assert not tilts or max(tilts) - min(tilts) < 1e-9 + 1e-6 * abs(max(tilts))


def test_mixing_odd(spark, odd_docs, no_docs):
    got = rows(mixing.mix_sizes(odd_docs))
    assert len(got) == odd_docs.count()
    check_mix(got, odd_docs.collect())
    assert mixing.mix_sizes(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    copies = Counter(r["doc_id"] for r in rows(mixing.mixed(odd_docs)))
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert copies == +want and mixing.mixed(odd_docs).columns == odd_docs.columns


# language


def test_language(spark):
    got = rows(queries.op10_language_id(spark, "/root/testdata/sf0.01"))
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]].lang for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(langid.identify(odd_docs))}
    assert [got[k]["lang_pred"] for k in (3, 4, 5, 7)] == ["und"] * 4 and got[5]["score"] == 0
    assert got[1]["lang_pred"] in ("en", "fr") and langid.identify(odd_docs).count() == odd_docs.count()
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in rows(langid.predict(odd_docs, langid.learn(no_docs), ["doc_id"]))} == {"und"}
    many = spark.createDataFrame([(i, f"{chr(0x4E00 + i % 70) * 5} {chr(0x4E00 + i % 70)} {chr(0x5E00 + i % 70) * 4}", f"l{i % 70:02d}") for i in range(1400)], "doc_id long, text string, lang string")
    seventy = {r["doc_id"]: r["lang_pred"] for r in rows(langid.identify(many))}  # more than one word of bits
    assert sum(seventy[r.doc_id] == r.lang for r in many.collect()) == 1400


# decontamination


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    ws, hit, found = word.findall(low(text)), set(), set()
    at = defaultdict(list)
    for i in range(len(ws)):
        at[ws[i]].append(i)
    for key, item in items:
        iw = word.findall(low(item))
        wins = [iw[i : i + window] for i in range(len(iw) - window + 1)] if len(iw) >= window else [iw] if iw else []
        for w in wins:
            for i in at[w[0]]:
                if ws[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(key))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check_hits(got, docs, items):
    want = sorted([(d.doc_id if d.doc_id is not None else -1, *brute_hits(d.text, items)) for d in docs])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want


def test_decontamination(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = rows(queries.op4_decontamination(spark, sf))
    assert any(r["n_hit"] for r in got)
    check_hits(got, docs, items)


@pytest.mark.parametrize("part_bytes", [1_000_000, 60])
def test_decontamination_odd(spark, odd_docs, no_docs, monkeypatch, part_bytes):
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 8_000 if part_bytes > 100 else 3)  # pieces shorter than a window, too
    items = [(1, "ALPHA beta"), (2, "beta gamma delta alpha beta gamma delta alpha beta gamma delta x"), (2, "beta"), (3, None), (4, ""), (5, "x"), (6, " ".join(f"word{i} other{i % 31}" for i in range(9))), (7, "gamma delta"), (8, "a a a a a a a a a a a a"), (9, "Straße"), (10, "ete"), (None, "nobody owns")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if k is None else k, t) for k, t in items]
    more = spark.createDataFrame([(100, "a " * 11, "en", "a"), (101, "a " * 9 + "b " + "a " * 30, "en", "a"), (102, "beta gamma delta alpha beta gamma delta alpha beta gamma delta", "en", "a")], "doc_id long, text string, lang string, source string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    check_hits(rows(decontamination.find(docs, bench)), docs.collect(), named)
    assert decontamination.find(no_docs, bench).count() == 0
    assert not any(r["contaminated"] for r in rows(decontamination.find(docs, bench.limit(0))))
    left = {r["doc_id"]: r["text"] for r in rows(decontamination.clean(docs, bench))}
    assert 100 not in left and left[5] is None and left[10] == "Ünïcode été Straße über" and 101 in left and left[101].split() == ["a"] * 9 + ["b"]


def test_long_items_are_split(spark, monkeypatch):
    """An item of many pieces, and many rows of one id, make parts of bounded size; spans go on over the borders of pieces."""
    monkeypatch.setattr(decontamination, "PART_BYTES", 2_000)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 50)
    long = [f"w{i}" for i in range(1000)]
    items = spark.createDataFrame([(1, " ".join(long)), *((2, f"other {i} " + "tail " * 12) for i in range(100))], "item_id long, text string")
    own = decontamination.pieces(items, 10, "item_id", "text")
    assert max(len(r.ws.split()) for r in own.collect()) == 59 and own.count() == 120
    assert len(decontamination.automata(items, 10, "item_id", "text")) > 4
    docs = spark.createDataFrame([(1, " ".join(long[130:470])), (2, " ".join(long[5:14])), (3, "x " + " ".join(long[:80]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, [list(s) for s in r.spans], r.n_items) for r in decontamination.find(docs, items).collect()}
    assert got == {1: (340, [[0, 340]], 1), 2: (0, [], 0), 3: (80, [[1, 81]], 1)}


def test_automaton_random():
    import random

    rnd = random.Random(5)
    for _ in range(300):
        items = [(str(i), [rnd.choice([b"a", b"b"]) for _ in range(rnd.randint(0, 9))]) for i in range(rnd.randint(1, 6))]
        ws = [rnd.choice([b"a", b"b", b"c"]) for _ in range(40)]
        spans, found = decontamination.Automaton(items, 4).spans(ws)
        n, hit, n_items, _, _ = brute_hits(" ".join(w.decode() for w in ws), [(k, " ".join(w.decode() for w in x)) for k, x in items], 4)
        assert sum(b - a for a, b in decontamination.merged(spans)) == hit and len(found) == n_items


# near duplicates


def brute_components(docs, k, percent):
    sets = {}
    for d in docs:
        ws = re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", ws)
        sets[d.doc_id] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = rows(queries.op6_near_dedup(spark, sf))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, 2, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    got = rows(neardup.near_duplicates(odd_docs, 2))
    assert len(got) == odd_docs.count()
    want = brute_components([d for d in odd_docs.collect() if d.doc_id is not None], 2, 80)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert neardup.near_duplicates(no_docs).count() == 0
    assert {r["doc_id"] for r in rows(neardup.deduplicated(odd_docs, 2))} == {r["doc_id"] for r in got if r["kept"]}


def test_near_duplicate_chains(spark):
    """A chain of texts in which only neighbours are linked, and unlinked texts that share buckets."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"c{j}" if j < 4 * i else w for j, w in enumerate(base)) for i in range(24)]
    docs = spark.createDataFrame([(97 * i % 101, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(neardup.near_duplicates(docs, 2))}
    assert got == brute_components(docs.collect(), 2, 80)


# pipeline


def brute_language(docs, least=3, close=0.25):
    """doc_id -> (language, share) by exact sets of trigrams, without hashes or a filter."""

    def grams(text):
        t = [c if c.isalpha() else " " for c in " " + (text or "").lower() + " "]
        return ["".join(t[i - 1 : i + 2]) for i in range(1, len(t) - 1) if t[i] != " "]

    counts = defaultdict(Counter)
    for d in docs:
        if d.lang is not None and d.text is not None and not (d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 3 == 1):
            counts[d.lang].update(grams(d.text))
    total, top = {k: sum(c.values()) for k, c in counts.items()}, defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            if n >= least:
                top[g] = max(top[g], n / total[k])
    sets = {k: {g for g, n in c.items() if n >= least and n / total[k] >= close * top[g]} for k, c in counts.items()}
    out = {}
    for d in docs:
        g = grams(d.text)
        out[d.doc_id] = max(((sum(x in s for x in g) / len(g), k) for k, s in sets.items()), default=(0.0, "und")) if g else (0.0, "und")
    return {i: (k, s) for i, (s, k) in out.items()}


def test_language_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_language(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(queries.op10_language_id(spark, sf))}
    assert got.keys() == want.keys()
    assert all(abs(got[i][1] - want[i][1]) < 0.02 for i in want)
    assert sum(got[i][0] != want[i][0] for i in want) <= 0.01 * len(want)  # near ties


def planted(spark, sf):
    """Documents of sf with ones of other languages and of none, copies, and odd rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.where("length(text) > 500").orderBy("doc_id").first()
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    more = [
        (10_001, finnish, None, "web"), (10_002, "qxzv kjwp xvqz wjkq zzxv pqkj vwxq jjkz " * 8, None, "web"), (10_003, None, "en", "web"), (10_004, "", "en", None), (10_005, "123 456 !!", None, "web"),
        (10_006, first.text, first.lang, "copy"), (first.doc_id, first.text, first.lang, first.source), (10_007, first.text + " " + item, first.lang, "zz"), (10_008, item, first.lang, "zz"),
    ]
    return docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(*r, len(r[1] or "")) for r in more], "doc_id long, text string, lang string, source string, n_chars long"))


def brute_cut(text, items):
    """text without the words of windows that occur in it, or None if none is left."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    places = list(word.finditer(low))
    ws, hit = [m[0] for m in places], set()
    for _, item in items:
        iw = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        wins = {tuple(iw[i : i + 10]) for i in range(len(iw) - 9)} if len(iw) >= 10 else {tuple(iw)} if iw else set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in wins:
                    hit.update(range(i, i + n))
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    gone = spans if len(hit) >= 0.5 * len(ws) else [x for x in spans if x[1] - x[0] >= 10]
    if hit and sum(b - a for a, b in gone) == len(ws):
        return None
    for a, b in reversed(gone):
        text = text[: places[a].start()] + text[places[b - 1].end() :]
    return text


def test_run_is_brute_force(spark, sf, tmp_path):
    import corpus_pipeline

    docs = planted(spark, sf)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, every = rows(corpus_pipeline.run(spark, str(tmp_path))), docs.collect()
    known = brute_language(every)
    assert all(known[i][1] < corpus_pipeline.LEAST_SCORE for i in (10_001, 10_002, 10_003, 10_004, 10_005))
    left = {(d.doc_id, d.text): d for d in every if known[d.doc_id][0] != "und" and known[d.doc_id][1] >= corpus_pipeline.LEAST_SCORE}
    assert len(every) - len(left) == 6  # the five above and a repeated row: no other document goes
    groups = brute_components(left.values(), 5, 80)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {d.doc_id: brute_cut(d.text, items) for d in left.values() if groups[d.doc_id][1] == d.doc_id}
    texts = {i: t for i, t in texts.items() if t is not None}
    by = {d.doc_id: d for d in left.values()}
    words, sizes, taken, longest = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)), Counter(), Counter(), Counter()
    for i, t in texts.items():
        sizes[by[i].source] += words(t)
        longest[by[i].source] = max(longest[by[i].source], words(t))
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    assert all(r["text"] == texts[r["doc_id"]] and r["lang"] == by[r["doc_id"]].lang and r["source"] == by[r["doc_id"]].source and r["n_chars"] == len(r["text"]) for r in got)
    for i, n in copies.items():
        taken[by[i].source] += n * words(texts[i])
    for k, want in water_fill(sizes).items():
        assert abs(taken[k] - want) <= longest[k] + 1e-6
    check_shards(got, [r["text"] for r in got], 16)


def test_stages_on_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, sf)
            assert set(before.columns) <= set(docs.columns) and (name == "shard" or docs.columns == before.columns)
        n = docs.count()
        assert (n > 0) == (before.count() > 0)


def test_deduplicated_rows_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (1, a), (2, a + " tail"), (2, b), (3, b), (None, a), (4, None), (4, None), (5, "")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in rows(neardup.deduplicated(docs)))
    assert got == Counter([(1, a), (2, b), (None, a), (4, None), (5, "")])


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = docs.cache()
        seen[name] = (before.collect(), docs.collect())
        assert docs.columns == columns or name == "shard" and set(columns) <= set(docs.columns)
    a, b = seen["language_id"]
    assert {r.doc_id for r in a} - {r.doc_id for r in b} <= {r.doc_id for r in a if not any(c.isalpha() for c in r.text or "")}
    a, b = seen["near_dedup"]
    want = brute_components(a, 5, 80)
    assert {r.doc_id for r in b} == {i for i, (_, c) in want.items() if i == c}
    a, b = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in a if not brute_hits(r.text, items)[4]}
    text = {r.doc_id: r.text for r in a}
    assert all(r.n_chars == len(r.text) for r in b)
    assert clean <= {r.doc_id for r in b} and all(r.text == text[r.doc_id] for r in b if r.doc_id in clean)
    a, b = seen["mix"]
    assert {r.doc_id for r in b} <= {r.doc_id for r in a} and max(Counter(r.doc_id for r in b).values()) <= 3
    a, b = seen["shard"]
    check_shards([r.asDict() for r in b], [r.text for r in a], 16)
