"""Hand-worked cases and properties."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.functions.columns import l2_normalize, softmax
from reelspark.operators import joins, labels, metrics, ranks, retrieval, splits, tiles
from reelspark.plans import frames

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(df):
    return df.first().asDict()


def test_resample_by_hand(spark):
    df = spark.createDataFrame([(10, 30.0), (10, 0.0), (1, 60.0), (5, 12.0)], "n_frames int, fps double")
    got = [r.frame_idx for r in frames.resample_plan(df).collect()]
    assert got == [[0, 1, 2, 4, 5, 6, 8, 9], list(range(10)), [0], [0, 0, 1, 2, 2, 2, 3, 4, 4, 4]]


def test_clips_by_hand(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 10)], "id string, n_frames int")
    assert [(r.clip_idx, r.empty) for r in frames.clip_plan(df, 4).collect()] == [([0, 1, 2, 2], False), ([], True), ([3, 4, 5, 6], False)]
    assert [r.id for r in frames.clip_plan(df, 4, short="drop").collect()] == ["c"]
    first = {r.id: r.clip_idx for r in frames.clip_plan(df, 4, 2, "first").collect()}
    assert first == {"a": [0, 0, 1, 2], "b": [], "c": [0, 2, 4, 6]}
    tile = {r.id: r.clip_idx for r in frames.clip_plan(df, 4, 2, "first", short="tile").collect()}
    assert tile["a"] == [0, 2, 1, 0]


@quick
@given(st.integers(1, 90), st.integers(1, 40), st.integers(1, 20))
def test_windows_cover_every_frame(spark, n, window, stride):
    stride = min(stride, window)
    df = spark.createDataFrame([(n,)], "n_frames int")
    rows = frames.sliding_windows(df, window, stride).collect()
    seen = {i for r in rows for i in r.window_idx}
    assert seen <= set(range(n)) and all(len(r.window_idx) == window for r in rows)
    assert n < window or seen == set(range(n))


@quick
@given(st.integers(1, 60), st.floats(1, 120), st.floats(1, 120))
def test_resample_in_range(spark, n, fps, target):
    r = one(frames.resample_plan(spark.createDataFrame([(n, fps)], "n_frames int, fps double"), target))
    assert r["frame_idx"] == sorted(r["frame_idx"]) and len(r["frame_idx"]) == r["t_out"] and set(r["frame_idx"]) <= set(range(n))


def test_label_rules(spark):
    t = [(1, "Mild-to-moderate"), (2, "mildly odd"), (3, "mild"), (4, "abnormal"), (5, "?"), (6, None)]
    df = spark.createDataFrame(t, "id int, text string")
    assert {r.id: r.label for r in labels.grade_text(df, "text").collect()} == {1: 2, 3: 1, 4: 0}
    p = spark.createDataFrame([(1, "No effusion"), (2, "normal"), (3, "small effusion, normal"), (4, "unseen")], "id int, text string")
    assert {r.id: r.label for r in labels.presence_text(p, "text").collect()} == {1: 0, 2: 0, 3: 1}
    m = spark.createDataFrame([(1, "20 mmHg\nplus 5 mm Hg, 9 MMHG"), (2, "35.5 mmHg"), (3, "none")], "id int, text string")
    assert {r.id: r.label for r in labels.sum_first_two(m, "text").collect()} == {1: 25, 2: 5}
    n = spark.createDataFrame([(1, " 2.0 "), (2, "8.01"), (3, "x"), (4, None), (5, "NaN")], "id int, text string")
    assert {r.id: r.label for r in labels.numeric_label(n, "text").collect()} == {1: 2.0}


def test_build_text_views(spark):
    row = {"view": "RVIT", "age_at_visit": "61.7", "ejection_fraction": 55.0} | dict.fromkeys((*labels.FREE_TEXT_FIELDS, *labels.TAG_FIELDS), " ")
    schema = ", ".join(f"{k} {'double' if k == 'ejection_fraction' else 'string'}" for k in row)
    rows = [row | {"right_atrium": "ra ", "left_ventricle": "lv", "conditions": "c"}, row | {"left_ventricle": "lv"}, row | {"view": "nan", "age_at_visit": "x", "ejection_fraction": None}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert [r.text for r in labels.build_text(df).collect()] == ["Age: 61 years. Ejection fraction: 55.0. ra c", "Age: 61 years. Ejection fraction: 55.0. lv", labels.FALLBACK_TEXT]


@quick
@given(st.lists(st.integers(0, 8), min_size=1, max_size=60), st.integers(1, 6))
def test_row_numbers_and_sums(spark, values, parts):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v int").repartition(parts)
    got = ranks.row_numbers(df, "v", "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rn)] == [i for _, i in sorted((v, i) for i, v in enumerate(values))]
    assert sorted(r.rn for r in got) == list(range(1, len(values) + 1))
    sums, run = {r.id: r.upto for r in ranks.prefix_sums(df, {"v": "upto"}, ["id"]).collect()}, 0
    for i, v in enumerate(values):
        run += v
        assert sums[i] == run


@quick
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=40))
def test_auc_mirror(spark, pairs):
    df = spark.createDataFrame([(y, s / 6) for y, s in pairs], "y int, score double")
    a, b = one(metrics.roc_auc(df))["auc"], one(metrics.roc_auc(df.withColumn("score", 1 - F.col("score"))))["auc"]
    assert (a is None and b is None) if len({y for y, _ in pairs}) < 2 else math.isclose(a, 1 - b, abs_tol=1e-12)
    won = [(x > z) + (x == z) / 2 for y, x in pairs if y for w, z in pairs if not w]
    assert not won or math.isclose(a, sum(won) / len(won), abs_tol=1e-12)


def test_edges_of_metrics(spark):
    none = spark.createDataFrame([], "y int, pred int, score double")
    assert math.isnan(one(metrics.accuracy_pvalue(none))["p_value"])
    df = spark.createDataFrame([(0, 0, 0.2), (0, 2, 0.9)], "y int, pred int, score double")
    assert one(metrics.roc_auc(df))["auc"] is None and one(metrics.average_precision(df))["ap"] is None
    r = one(metrics.classification_metrics(df))
    assert (r["accuracy"], r["precision"], r["recall"]) == (0.5, 0.5, 0.25)
    assert one(metrics.specificity(df, 3))["specificity"] == pytest.approx((0 + 1 + 0.5) / 3)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, pred double")
    assert one(metrics.regression_metrics(flat))["r2"] == 0.0 and one(metrics.regression_metrics(flat, safe=False))["r2"] is None
    edges = spark.createDataFrame([(0.0, 1), (1 / 15, 1), (1.0, 1)], "conf double, correct int")
    assert one(metrics.ece(edges))["ece"] == pytest.approx((2 - 1 / 15 + 0) / 3)
    assert one(metrics.calibrate_threshold(none))["threshold"] == 0.5


def test_macro_replaces_own_columns(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1], 7.0), (1, [0.2, 0.8], 7.0)], "y int, probs array<double>, score double")
    assert one(metrics.macro(metrics.roc_auc, df, "auc"))["auc"] == 1.0


def test_poisson_weights(spark):
    w = metrics.poisson_draws(spark.range(1, 3001).withColumnRenamed("id", "row"), 20).agg(F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q")).first()
    assert abs(w.s / 60_000 - 1) < 0.02 and abs(w.q / 60_000 - 2) < 0.06


def test_splits_are_disjoint_and_nested(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("site"))
    s = splits.split_studies(df, 0.1, 1, [3, 5])
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n["val"] == int(0.1 * (500 - n["holdout"])) and sum(n.values()) == 500
    assert all(r.n == 0 for r in joins.audit_splits(s, df.select("id"), [3, 5]).collect())
    small, large = ({r.id for r in splits.take_fraction(df, f, 9).collect()} for f in (0.05, 0.1))
    assert len(small) == 25 and small < large


def test_shards_hold_at_most_n(spark):
    n = ranks.assign_shards(spark.range(95), 20, "id", start=4).groupBy("shard_id").count().collect()
    assert sorted((r.shard_id, r["count"]) for r in n) == [(4, 20), (5, 20), (6, 20), (7, 20), (8, 15)]


def test_anti_join_keeps_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    assert [r.id for r in joins.drop_ids(df, spark.createDataFrame([(1,), (None,)], "id int"), "id").collect()] == [None]


def test_long_vectors(spark):
    """Softmax and unit length take sums and maxima once a row: with 3,000 entries a sum an entry would take minutes."""
    df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: (i * (F.col("id") + 1) % 17 + 1).cast("double")).alias("v"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    r = df.select(total(softmax(F.col("v"))).alias("s"), total(F.transform(l2_normalize(F.col("v")), lambda x: x * x)).alias("q")).collect()
    assert all(math.isclose(x.s, 1, rel_tol=1e-9) and math.isclose(x.q, 1, rel_tol=1e-9) for x in r)
    for c in (softmax(F.col("v")), l2_normalize(F.col("v"))):  # one aggregate in the expression, and it is in no lambda over entries
        text = str(df.select(c.alias("c"))._jdf.queryExecution().analyzed())
        assert text.count("aggregate(") == 1


def test_similar_pairs(spark):
    rows = [(i, [float(i % 3), float(i % 2), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    want = {(a, b): sum(x * y for x, y in zip(v, w, strict=True)) for a, v in rows for b, w in rows if a != b}
    got = {(r.a, r.b): r.sim for r in retrieval.pairwise_similarity(df, 2.0).collect()}
    assert got == {k: s for k, s in want.items() if s >= 2.0}
    assert {(r.a, r.b) for r in retrieval.pairwise_similarity(df, -1.0, upper=True).collect()} == {k for k in want if k[0] < k[1]}


@pytest.mark.parametrize(("n", "copies", "gathered"), [(2, 0, 100), (41, 0, 5), (40, 0, 5), (60, 40, 5), (30, 30, 1)])
def test_lower_median(spark, monkeypatch, n, copies, gathered):
    """By brackets of four bins, down to few values or to equal ones, over several blocks."""
    monkeypatch.setattr(retrieval, "GATHERED", gathered)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    rnd = random.Random(n)
    vs = [[rnd.gauss(0, 1) for _ in range(3)] for _ in range(n)]
    vs[:copies] = [vs[0]] * copies
    vs = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vs]
    want = sorted(sum(x * y for x, y in zip(v, w, strict=True)) for i, v in enumerate(vs) for w in vs[:i])
    df = spark.createDataFrame(list(enumerate(vs)), "id long, embedding array<double>")
    got = retrieval.similarity_stats(df, bins=4).first()
    assert math.isclose(got.median, want[(len(want) - 1) // 2], abs_tol=1e-12) and math.isclose(got.max, want[-1], abs_tol=1e-12)
    assert retrieval.similarity_stats(df.limit(0)).count() <= 1


def _vectors(n: int, dim: int = 3) -> list[tuple[int, list[float]]]:
    rnd = random.Random(n)
    vs = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(n)]
    return [(i * 7 % 1009, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in enumerate(vs)]


def test_blocks_are_sent_in_proportion(spark, monkeypatch):
    """Each block goes to as many tiles as there are strips, a fixed number; a table four times as large is sent four times, not sixteen."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 4)
    monkeypatch.setattr(tiles, "MOST_STRIPS", 4)
    sent, run = [], tiles.run
    monkeypatch.setattr(tiles, "run", lambda dealt, *a: (sent.append(dealt.count()), run(dealt, *a))[1])
    for n in (100, 400):
        df = spark.createDataFrame(_vectors(n), "id long, embedding array<double>")
        assert retrieval.similarity_stats(df, bins=50).count() == 1
        assert sent.pop() <= 4 * n / 4 and sent.pop() <= 4 * n / 4
        sent.clear()


def test_row_similarities_over_tiles(spark, monkeypatch):
    """Sums over rows of larger ids, whatever block and tile they are in; equal ids aren't paired, and rows without id or vector take no part."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    monkeypatch.setattr(tiles, "SLAB", 5)
    rows = [*_vectors(150), (7, [1.0, 0.0, 0.0])]
    want = {}
    for a, v in rows:
        for b, w in rows:
            if a < b:
                want.setdefault(a, []).append(sum(x * y for x, y in zip(v, w, strict=True)))
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0, 0.0]), (3000, None)], "id long, embedding array<double>")
    got = {r.a: r for r in retrieval.similarity_rows(df).collect()}
    assert got.keys() == want.keys() and all(got[a].n == len(x) and math.isclose(got[a].total, sum(x), abs_tol=1e-9) and math.isclose(got[a].best, max(x), abs_tol=1e-12) for a, x in want.items())


def test_uniformity_over_tiles(spark, monkeypatch):
    """As by all pairs; a worker gets blocks one by one and not the pairs of a partition."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    rows = _vectors(150)
    s = [sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, v) in enumerate(rows) for _, w in rows[:i]]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    sent, run = [], tiles.run
    monkeypatch.setattr(tiles, "run", lambda dealt, *a: (sent.append(dealt), run(dealt, *a))[1])
    assert math.isclose(retrieval.uniformity(df).first()[0], math.log((2 * sum(math.exp(4 * x - 4) for x in s) + 150 * math.exp(-8)) / 150**2), abs_tol=1e-9)
    assert max(len(r.v) for r in sent[0].select("v").collect()) <= 40 * 3 * 8


def _peak(tile, n=1500):
    """Bytes that a tile takes at most for the pair of two blocks of n rows, in slabs of products."""
    rnd = np.random.default_rng(3)
    q, c = (tiles.Block({"at": i, "ids": np.arange(i, 2 * n, 2).tobytes(), "v": rnd.normal(size=(n, 8)).tobytes(), "dim": 8}) for i in range(2))
    tracemalloc.start()
    try:
        assert not list(tile.pair(q, c))
        return tracemalloc.get_traced_memory()[1] / (tiles.SLAB * n * 8)
    finally:
        tracemalloc.stop()


def test_row_sums_take_no_products(monkeypatch):
    """Numbers and sums come from the vectors behind a row; products, here none, are only needed for the best."""
    assert _peak(retrieval._Rows()) < 1.6
    monkeypatch.setattr(tiles, "slabs", lambda q, c: iter(()))
    block, tile = tiles.Block({"at": 0, "ids": np.array([1, 4, 4, 9]).tobytes(), "v": np.array([1.0, 2.0, 3.0, 5.0]).tobytes(), "dim": 1}), retrieval._Rows()
    other = tiles.Block({"at": 1, "ids": np.array([2, 7]).tobytes(), "v": np.array([10.0, 20.0]).tobytes(), "dim": 1})
    assert not [*tile.pair(block, block), *tile.pair(block, other)]
    assert tile.of(block)[0].tolist() == [5, 2, 2, 0] and tile.of(block)[1].tolist() == [40.0, 50.0, 75.0, 0.0]
    assert tile.of(other)[0].tolist() == [3, 1] and tile.of(other)[1].tolist() == [100.0, 100.0]


def test_kernel_holds_one_slab(spark):
    """The kernel is made where the products lie; without rows there is a null, as by SQL."""
    assert _peak(retrieval._Kernel()) < 1.2
    assert [r[0] for r in retrieval.uniformity(spark.createDataFrame([], "id long, embedding array<double>")).collect()] == [None]
