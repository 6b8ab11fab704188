"""Brute-force twin of the spelling variants: words whose texts without one letter agree."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from reelspark.llm import queries, spelling


def counted(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near_pairs(words):
    holes, pairs = defaultdict(list), set()
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].append(w)
            if w[:i] + w[i + 1 :] in words:
                pairs.add((w, w[:i] + w[i + 1 :]))
    pairs |= {p for group in holes.values() for p in itertools.combinations(group, 2)}
    return pairs


def brute(docs):
    n = counted(docs)
    near = defaultdict(set)
    for a, b in near_pairs(n):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    cols = ("word", "form", "root", "n", "n_near", "form_n")
    assert df.columns == list(cols)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("most", [20_000, 40])
def test_query(spark, sf, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST", most)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert got(queries.op12_spelling_variants(spark, sf)) == want and sum(x[4] for x in want) > 100


@pytest.mark.parametrize("most", [20_000, 3, 1])
def test_dense_words(spark, monkeypatch, most):
    """Few letters, so that nearly all words are near others and edits lie in runs of equal letters."""
    monkeypatch.setattr(spelling, "MOST", most)
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 9))) for _ in range(300)}
    docs = [(i, " ".join(w for w in words for _ in range(rnd.randrange(5) ** 2))) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(spelling.variants(df)) == brute(docs)


def test_odd(spark, odd_docs, no_docs):
    assert got(spelling.variants(no_docs)) == []
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(spelling.variants(odd_docs)) == brute(docs)
    long = "q" * 30_000
    docs = [(1, f"{long} {long}x ÐÉTRANGE {'z' * 3000}y{'z' * 3000}"), (None, f"{long} {long}x"), (1, f"{long} {long}x {long} {long} {long} {long} {long}")]
    df = spark.createDataFrame(docs * 3, "doc_id long, text string")
    assert got(spelling.variants(df)) == brute(docs * 3)


def test_acceptor_is_minimal():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in range(200)})
    a = spelling.Acceptor(words)
    read = set()
    todo = [(0, "")]
    reached = {0}
    while todo:
        q, x = todo.pop()
        if a.final[q]:
            read.add(x)
        reached |= set(a.arcs[q].values())
        todo += [(r, x + c) for c, r in a.arcs[q].items()]
    after = {tuple(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert read == set(words) and len(reached) == len(after)
    assert {frozenset(p) for p in a.near_pairs()} == {frozenset(p) for p in near_pairs(set(words))} and len(list(a.near_pairs())) == len(near_pairs(set(words)))
