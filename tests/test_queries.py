"""Every query against its SQL oracle, and the ones without SQL against plain Python."""

import math

import duckdb
import numpy as np
import pytest

from reelspark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return str(v)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-5))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, duck, sf, name):
    df = core.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rel = duck.sql(core.ORACLES[name])
    assert sorted(rel.columns) == names
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=key)
    want = sorted(([plain(r[rel.columns.index(n)]) for n in names] for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_pvalue(spark, sf):
    got = {r.l_suppkey: r.p_value for r in core.QUERIES["a14_accuracy_pvalue"](spark, sf).collect()}
    rows = core.logits(spark, sf).select("l_suppkey", "y", "pred").collect()
    for k, p in got.items():
        hits = [r.y == r.pred for r in rows if r.l_suppkey == k]
        z = (sum(hits) / len(hits) - 1 / 3) / math.sqrt((1 / 3) * (2 / 3) / len(hits))
        assert math.isclose(p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)


def matrix(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), np.array([r.label for r in rows], float)


def test_effective_rank_and_pca(spark, sf):
    ids, x, _ = matrix(spark, sf)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.linalg.svd(u, compute_uv=False)
    p = s / s.sum()
    assert math.isclose(core.QUERIES["a23_effective_rank"](spark, sf).first()[0], math.exp(-(p * np.log(p)).sum()), rel_tol=1e-6)
    c = x - x.mean(axis=0)
    _, sv, vt = np.linalg.svd(c, full_matrices=False)
    got = {r.vec_id: (r.pc1, r.pc2, r.explained) for r in core.QUERIES["m07_pca"](spark, sf).collect()}
    want = np.abs(c @ vt[:2].T)
    assert all(np.allclose(got[i][:2], w, atol=1e-5) for i, w in zip(ids.tolist(), want, strict=True))
    assert math.isclose(got[0][2], (sv[:2] ** 2).sum() / (sv**2).sum(), rel_tol=1e-5)


def test_ridge_is_the_normal_solution(spark, sf):
    ids, x, y = matrix(spark, sf)
    c = x - x.mean(axis=0)
    w = np.linalg.solve(c.T @ c + np.eye(x.shape[1]), c.T @ (y - y.mean()))
    got = {r.vec_id: r.pred for r in core.QUERIES["m03_fit_ridge"](spark, sf).collect()}
    assert np.allclose([got[i] for i in ids.tolist()], c @ w + y.mean(), atol=1e-5)


def test_classifier_is_at_the_minimum(spark, sf):
    ids, x, y = matrix(spark, sf)
    y = (y < 5).astype(float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.r_[x.T @ (weight * (p - y)) + w, (weight * (p - y)).sum()]
        xs = np.c_[x, np.ones(len(x))]
        h = xs.T @ (xs * (weight * p * (1 - p))[:, None]) + np.diag([1.0] * x.shape[1] + [0.0])
        step = np.linalg.solve(h, g)
        w, b = w - step[:-1], b - step[-1]
    got = {r.vec_id: r.score for r in core.QUERIES["m02_fit_classifier"](spark, sf).collect()}
    assert np.allclose([got[i] for i in ids.tolist()], 1 / (1 + np.exp(-(x @ w + b))), atol=1e-4)


def test_grid_heads(spark, sf):
    """The heads' best epochs and values, by the same training in plain numpy."""
    rows = core.splits.hash_split(spark.read.parquet(f"{sf}/embeddings.parquet"), 0.3, 1, "vec_id").collect()
    x, y, fit = np.array([[*r.embedding, 1.0] for r in rows], float), np.array([r.label % 3 for r in rows]), np.array([r.split == "train" for r in rows])
    counts = np.bincount(y[fit]) + 1e-6
    weight = (1 / counts) / (1 / counts).sum() * 3
    want = []
    for rate in (0.01, 0.1):
        for decay in (0.0, 0.01):
            w, m, v, best = np.zeros((x.shape[1], 3)), 0.0, 0.0, (0, -1.0)
            for t in range(1, 9):
                p = np.exp(x[fit] @ w)
                p /= p.sum(axis=1, keepdims=True)
                own = weight[y[fit]][:, None]
                g = x[fit].T @ ((p - np.eye(3)[y[fit]]) * own) / own.sum()
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * w)
                acc = float(((x[~fit] @ w).argmax(axis=1) == y[~fit]).mean())
                best = (t, acc) if acc > best[1] else best
            want.append((rate, decay, *best))
    got = [(r.rate, r.decay, r.epoch, r.value) for r in core.QUERIES["m04_grid_heads"](spark, sf).orderBy("position").collect()]
    assert all(a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_grid_probe_values(spark, sf):
    """Validation errors of the ridge grid, by normal equations."""
    rows = core.splits.hash_split(spark.read.parquet(f"{sf}/embeddings.parquet"), 0.3, 1, "vec_id").collect()
    x, y, fit = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows], float), np.array([r.split == "train" for r in rows])
    mx, my = x[fit].mean(axis=0), y[fit].mean()
    c = x[fit] - mx
    want = [np.abs((x[~fit] - mx) @ np.linalg.solve(c.T @ c + a * np.eye(x.shape[1]), c.T @ (y[fit] - my)) + my - y[~fit]).mean() for a in (0.1, 1.0, 10.0)]
    got = [r.value for r in core.QUERIES["m04_grid_probe"](spark, sf).orderBy("position").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_run_task_values(spark, sf):
    """Point values of the task's report, by normal equations on pooled and standardised vectors."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    study = np.array([r.vec_id % 97 for r in rows])
    keys = np.unique(study)
    x = np.stack([np.array([r.embedding for r in rows], float)[study == k].mean(axis=0) for k in keys])
    y = np.array([np.array([r.label for r in rows], float)[study == k].mean() for k in keys])
    fit, test = keys % 5 < 3, keys % 5 == 4
    z = (x - x[fit].mean(axis=0)) / x[fit].std(axis=0)
    mz, my = z[fit].mean(axis=0), y[fit].mean()
    w = np.linalg.solve((z[fit] - mz).T @ (z[fit] - mz) + np.eye(z.shape[1]), (z[fit] - mz).T @ (y[fit] - my))
    pred = (z[test] - mz) @ w + my
    got = {r.metric: r.value for r in core.QUERIES["m05_run_task"](spark, sf).where("split = 'TEST'").collect()}
    assert math.isclose(got["mae"], np.abs(pred - y[test]).mean(), rel_tol=1e-5) and math.isclose(got["rmse"], math.sqrt(((pred - y[test]) ** 2).mean()), rel_tol=1e-5)


def test_embed_values(spark, sf):
    """Mean byte counts of a conversation's texts."""
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        want.setdefault(r.conv_id, []).append(np.bincount(np.frombuffer(str(r.text).encode(), np.uint8) % 8, minlength=8))
    got = {r.id: r.embedding for r in core.QUERIES["m06_embed"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], np.mean(v, axis=0), rtol=1e-5) for k, v in want.items())


def test_runs(spark, sf):
    assert {r.split for r in core.QUERIES["m05_run_task"](spark, sf).collect()} == {"VAL", "TEST"}
    assert core.QUERIES["m04_grid_probe"](spark, sf).count() == 3
    assert core.QUERIES["m06_embed"](spark, sf).count() > 0
    got = core.flagship(spark, sf).collect()
    assert [r.k for r in got] == [1, 5, 10] and got[0].recall <= got[1].recall <= got[2].recall
