"""Ridge paths from one Gram matrix, and singular values by QR in a tree."""

import numpy as np
import pytest

from reelspark.operators import probes, vectors

SCHEMA = "embedding array<double>, target double"


def framed(spark, x, y, parts=5):
    return spark.createDataFrame([([float(c) for c in v], None if t is None else float(t)) for v, t in zip(x, y, strict=True)], SCHEMA).repartition(parts)


def test_ridge_path_is_ridge(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 6)) * [1, 2, 0.1, 5, 1, 1] + 3
    y = x @ rnd.normal(size=6) + rnd.normal(size=200) + 7
    df, alphas = framed(spark, x, y), (0.0, 0.5, 10.0, 1e4)
    path = probes.ridge_path(df, alphas)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.array([np.linalg.solve(xc.T @ xc + a * np.eye(6), xc.T @ yc) for a in alphas])
    assert np.allclose(path.weights, want, rtol=1e-8, atol=1e-10)
    assert np.allclose([r.mae for r in path.errors(df).orderBy("position").collect()], [np.abs(x @ w + y.mean() - x.mean(axis=0) @ w - y).mean() for w in want])
    one = probes.fit_ridge(df, 10.0)
    assert np.allclose(one.coefficients, want[2], rtol=1e-6) and np.isclose(one.intercept, path.intercepts[2])


def test_ridge_path_odd(spark):
    x = np.c_[np.ones(5), np.arange(5.0), 2 * np.arange(5.0)]  # constant and dependent columns
    df = framed(spark, x, [1, 2, 3, None, 5])
    path = probes.ridge_path(df, (1e-3,))
    assert np.isfinite(path.weights).all() and path.errors(df).first().mae < 1e-2
    with pytest.raises(ValueError, match="no rows"):
        probes.ridge_path(df.limit(0), (1.0,))


def test_ridge_grid_is_one_pass(spark, sf):
    df = framed(spark, np.random.default_rng(1).normal(size=(50, 3)), range(50))
    tracker, group = spark.sparkContext.statusTracker(), "ridge-grid"
    jobs = {}
    for grid in ((1.0,), (0.1, 0.3, 1.0, 3.0, 10.0, 30.0)):
        spark.sparkContext.setJobGroup(f"{group}{len(grid)}", "")
        probes.grid_probe(df, df, grid, "regression")
        jobs[len(grid)] = len(tracker.getJobIdsForGroup(f"{group}{len(grid)}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[6] > 0


def test_singular_values_keep_their_digits(spark):
    """Values down to 1e-9 of the largest, which a Gram matrix loses."""
    rnd = np.random.default_rng(3)
    u, v = np.linalg.qr(rnd.normal(size=(300, 12)))[0], np.linalg.qr(rnd.normal(size=(12, 12)))[0]
    s = np.logspace(0, -9, 12)
    x = u * s @ v.T
    plain = np.linalg.svd(x, compute_uv=False)
    for parts in (1, 3, 20):
        got = vectors.singular_values(framed(spark, x, [0.0] * 300, parts))
        assert np.allclose(got, plain, rtol=1e-6, atol=0)
    squared = np.sqrt(np.clip(np.linalg.eigvalsh(x.T @ x)[::-1], 0, None))
    assert not np.allclose(squared, plain, rtol=1e-2, atol=0)
    few = framed(spark, x[:5], [0.0] * 5, 4)
    assert np.allclose(vectors.singular_values(few), np.linalg.svd(x[:5], compute_uv=False), rtol=1e-6, atol=1e-15)
    assert len(vectors.singular_values(few.limit(0))) == 0 and vectors.effective_rank(few.limit(0)).first()[0] == 0.0
