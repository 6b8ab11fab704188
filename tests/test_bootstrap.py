"""Bootstrap sums: draws add up to n, agree between tasks and reruns, and have the right spread."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import bootstrap, metrics


@pytest.mark.parametrize("n", [1, 9, 10, 11, 95, 640])
def test_draws_of_all_blocks_are_n(n):
    blocks = math.ceil(n / 10)
    counts = np.stack([bootstrap.block_counts(n, b, 300, 7, 10) for b in range(blocks)])
    assert (counts.sum(axis=0) == n).all() and (counts >= 0).all()
    sizes = np.array([min(n, 10 * b + 10) - 10 * b for b in range(blocks)])
    assert (np.abs(counts.mean(axis=1) - sizes) < 6 * np.sqrt(sizes / 300) + 1e-9).all()
    if blocks > 1:  # a multinomial's variance, not a Poisson's or a fixed share's
        share = sizes / n
        assert (np.abs(counts.var(axis=1) / (n * share * (1 - share)) - 1) < 0.5).all()
    for b in range(blocks):
        weights = np.stack(list(bootstrap.block_weights(n, b, 300, 7, 10)))
        assert weights.shape == (300, sizes[b]) and (weights.sum(axis=1) == counts[b]).all()


def test_sums(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", 64)
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(3, 2), None if i % 7 == 0 else 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double, some double")
    reps = {r.replicate: r for r in bootstrap.replicate_sums(df, {"x": "x", "some": "some"}, ["id"], 400).collect()}
    again = {r.replicate: r for r in bootstrap.replicate_sums(df.repartition(7), {"x": "x", "some": "some"}, ["id"], 400).collect()}
    assert len(reps) == 400 and all(r.drawn == 1000 for r in reps.values())
    assert all(math.isclose(reps[k].x, again[k].x, rel_tol=1e-9) and reps[k].some == again[k].some for k in reps)
    x = np.array([r[1] for r in rows])
    means = np.array([r.x / 1000 for r in reps.values()])
    assert abs(means.mean() - x.mean()) < 5 * x.std() / math.sqrt(1000 * 400) and 0.85 < means.std() / (x.std() / math.sqrt(1000)) < 1.15
    ci = {r.metric: r for r in bootstrap.sums_ci(df, {"x": "x", "some": "some"}, {"mean": F.col("x") / F.col("drawn"), "share": F.col("some") / F.col("drawn")}, ["id"], 400).collect()}
    assert math.isclose(ci["mean"].value, x.mean()) and math.isclose(ci["mean"].lower, np.quantile(means, 0.025)) and math.isclose(ci["mean"].upper, np.quantile(means, 0.975))
    assert ci["share"].value == sum(r[2] is not None for r in rows) / 1000
    none = bootstrap.sums_ci(df.limit(0), {"x": "x"}, {"mean": F.when(F.col("drawn") > 0, F.col("x") / F.col("drawn"))}, ["id"], 10).collect()
    assert [tuple(r) for r in none] == [("mean", None, None, None)]


def test_own_metric(spark):
    rnd = random.Random(4)
    rows = [(i + 1, rnd.choice([0.5, 1.5, 2.5, 9.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "row long, x double")
    w = metrics.draws(df, 50, 1)
    drawn = {}
    for r in w.collect():
        drawn.setdefault(r.replicate, []).extend([dict(rows)[r.row]] * r.weight)
    want = [sorted(v)[(len(v) - 1) // 2] for v in drawn.values()]
    got = metrics.bootstrap_ci(df, bootstrap.python_metric(bootstrap.weighted_median, ["x"], "median"), ["median"], weights=w).first()
    assert got.value == sorted(x for _, x in rows)[29] and got.lower == np.quantile(want, 0.025) and got.upper == np.quantile(want, 0.975)
