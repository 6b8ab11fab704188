"""Brute-force twin of the n-gram join: all pairs of sets."""

import random

import numpy as np
import pytest

from reelspark.llm import neardup, ngramjoin, queries

SCHEMA = "doc_id long, text string"


def sets(docs, k):
    out = []
    for doc, text in docs:
        ws = (text or "").encode().lower().split()
        out.append((doc, {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()))
    return out


def brute(docs, k, percent):
    own = sets(docs, k)
    root = list(range(len(own)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(own):
        for j, (b, y) in enumerate(own[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(i)] = top(j)
    out = []
    for i, (doc, x) in enumerate(own):
        out.append((doc, len(x), None if doc is None else min(own[j][0] for j in range(len(own)) if top(j) == top(i) and own[j][0] is not None) if x else doc))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 3, 90)
    assert got(queries.op13_ngram_join(spark, sf)) == want and sum(a != c for a, _, c in want) > 5


def family(rnd, n, words=60, edits=3, letters=4):
    """Copies of copies with words replaced, from few words, so that chains and borders occur."""
    texts = [[f"w{rnd.randrange(500)}" for _ in range(words)]]
    while len(texts) < n:
        t = list(rnd.choice(texts))
        for _ in range(rnd.randrange(edits)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(letters)}"
        if rnd.random() < 0.3:
            del t[rnd.randrange(len(t))]
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (1, 80), (2, 100)])
def test_chains(spark, monkeypatch, k, percent):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngramjoin, "STEP", 4)
    rnd = random.Random(11)
    texts = [t for s in range(6) for t in family(rnd, 40, 20 + 15 * s)]
    common = " ".join(f"licence{i}" for i in range(30))
    texts += [f"{common} " + " ".join(f"own{i}.{j}" for j in range(i % 5)) for i in range(40)] + ["a b", "b a", "a b", "a", "A", "b"]
    docs = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    want = brute(docs, k, percent)
    assert got(ngramjoin.similar_components(spark.createDataFrame(docs, SCHEMA), k, percent)) == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_odd(spark, odd_docs, no_docs):
    assert got(ngramjoin.similar_components(no_docs)) == []
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(ngramjoin.similar_components(odd_docs)) == brute(docs, 3, 90)


def test_tree_leaves_paths_early():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 1 << 60, 2000, dtype=np.uint64))
    near = [np.unique(np.concatenate([np.delete(base, rnd.integers(0, len(base), 20)), rnd.integers(0, 1 << 60, 20, dtype=np.uint64)])) for _ in range(50)]
    far = [np.unique(rnd.integers(0, 1 << 60, 2000, dtype=np.uint64)) for _ in range(50)]
    tree = ngramjoin.PrefixTree(list(range(100)), near + far)
    for y in (near[0], far[0], base):
        want = [i for i, x in enumerate(near + far) if 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))]
        tree.steps = 0
        assert sorted(tree.linked(y, 90)) == want
        assert tree.steps < 0.75 * sum(map(len, near + far))
