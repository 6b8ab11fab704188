"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards near one another: to the nearest of some pivots, whose number grows with the table, and a pivot's rows, in the order of their distance and
id, to shards of at most SHARD_ROWS (more only beyond MOST_SHARDS shards). Each shard becomes one row with its ball tree, its centre, radius and least id. A query
visits its best shards by upper bound first, in two rounds. The k-th score so far is then its floor, and only shards whose bound reaches it are listed
for the last round, so no table of all queries and shards is made. Scores are whole numbers and ties go to smaller ids, so a bound that only equals the floor matters
only for smaller ids: the shards of a vector with very many copies aren't all visited.
In a tree a query first takes the leaf that a descent by larger bounds leads to; then nodes whose upper bound |q| * radius + q . centre is
below its current k-th score are left out, and its leaves are visited in the order of their bounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import written
from reelspark.operators.ranks import row_numbers

SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 20_000, 64, 4_000
MOST_PIVOTS, PIVOT_SAMPLE = 1_024, 4_000
MOST_SHARDS = 200_000  # balls that the driver and each task hold: a centre each
FIRST, THEN = 1, 4  # visits of a query up to which the first two rounds go
NONE = np.iinfo(np.int64).max


def as_integers(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) with v = floor(scale * x) as doubles; rows that are null or hold a null or non-finite component go."""
    x = F.transform(F.col(col), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(fine)
    return v.select("vec_id", F.transform("x", lambda c: _floor(c * scale)).alias("v"), F.size("x").alias("dim"))


def _floor(c):
    """floor as a double, for values beyond the long range too (those are whole already)."""
    return F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pivots_of(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each length of vectors, centres after a few k-means steps over a sample: two for each SHARD_ROWS of n rows, MOST_PIVOTS at most, from the PIVOT_SAMPLE
    rows of least hashes and 16 more for each pivot."""
    h = F.xxhash64("vec_id", F.lit(1))
    k = min(MOST_PIVOTS, max(1, 2 * n // SHARD_ROWS))
    # the sample is bounded; the search is exact whatever the pivots are
    t = rows.orderBy(h, "vec_id").limit(PIVOT_SAMPLE + 16 * k).select("v", "dim").toPandas()
    out = {}
    for dim, part in t.groupby("dim"):
        x = np.unique(np.stack([np.asarray(v, float) for v in part.v]), axis=0)
        c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
        for _ in range(5):
            own = nearest(x, c)
            c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        out[int(dim)] = c
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the pivot and the squared distance to it; vectors of a length that no pivot has go to pivot 0 of distance 0."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            own, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                if (c := sent.value.get(int(dim))) is not None and dim:
                    at = np.flatnonzero(dims == dim)
                    x = matrix(batch.column("v").take(pa.array(at)), int(dim))
                    own[at] = nearest(x, c)
                    far[at] = ((x - c[own[at]]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(far)], [*batch.schema.names, "pivot", "far"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, dim int, pivot int, far double")


class BallTree:
    """Rows in leaf order; a node is (first, last, centre, radius, left, right)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(ids))
        self.first, self.last, self.left, centres, radii = [], [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = x[order[a:b]]
            centre = own.mean(axis=0)
            me = len(self.first)
            self.first.append(a)
            self.last.append(b)
            self.left.append([])
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            if parent >= 0:
                self.left[parent].append(me)
            if b - a > LEAF_ROWS:
                far = own[((own - centre) ** 2).sum(axis=1).argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                side = own @ (other - far)
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(side, middle)]
                todo += [(a, a + middle, me), (a + middle, b, me)]
        self.ids, self.x = ids[order], x[order]
        self.centre, self.radius = np.stack(centres), np.array(radii)
        self.visited = 0  # pairs of a query and a leaf

    def search(self, q: np.ndarray, own: np.ndarray, scores: np.ndarray, found: np.ndarray, floor: np.ndarray) -> None:
        """Puts into scores and found (queries x k, best first; NONE where none) what is better than it; floor: scores that a k-th best surely reaches."""
        size = np.sqrt((q * q).sum(axis=1))
        slack = 1e-9 * (1 + size * np.sqrt((self.x * self.x).sum(axis=1).max()))

        def bound(rows: np.ndarray, node: int) -> np.ndarray:
            return q[rows] @ self.centre[node] + size[rows] * self.radius[node] + slack[rows]

        def worst(rows: np.ndarray) -> np.ndarray:
            return np.maximum(scores[rows, -1], floor[rows])

        def visit(rows: np.ndarray, node: int) -> None:
            self.visited += len(rows)
            first, last = self.first[node], self.last[node]
            ids = np.broadcast_to(self.ids[first:last], (len(rows), last - first))
            s = np.where(ids == own[rows, None], -np.inf, q[rows] @ self.x[first:last].T)
            can = s >= worst(rows)[:, None]
            some = can.any(axis=1)
            columns = can.any(axis=0)  # few rows and columns of a leaf can count once k-th scores are high
            if some.any():
                better(rows[some], s[some][:, columns], ids[some][:, columns], scores, found)

        seen, todo = np.zeros(len(q), np.int64), [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if not self.left[node]:
                seen[rows] = node
                visit(rows, node)
                continue
            one, two = self.left[node]
            to_one = bound(rows, one) >= bound(rows, two)
            todo += [(child, part) for child, part in ((one, rows[to_one]), (two, rows[~to_one])) if len(part)]
        leaves: list[tuple[np.ndarray, np.ndarray, int]] = []
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            b = bound(rows, node)
            keep = b >= worst(rows)
            rows = rows[keep]
            if len(rows) and self.left[node]:
                todo += [(child, rows) for child in self.left[node]]
            elif len(rows):
                new = seen[rows] != node
                leaves.append((rows[new], b[keep][new], node))
        if not sum(len(rows) for rows, _, _ in leaves):
            return
        # leaf by leaf, those of the highest bounds first, with the queries whose k-th score they can still reach
        for rows, upper, node in sorted(leaves, key=lambda leaf: -leaf[1].max(initial=-np.inf)):
            rows = rows[upper >= worst(rows)]
            if len(rows):
                visit(rows, node)


def better(rows: np.ndarray, s: np.ndarray, ids: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
    """Merges candidates into the best ones of rows: higher scores first, ties by the smaller id."""
    k = scores.shape[1]
    s, ids = np.concatenate([scores[rows], s], axis=1), np.concatenate([found[rows], ids], axis=1)
    ids = np.where(np.isneginf(s), NONE, ids)
    order = np.lexsort((ids, -s), axis=1)[:, :k]
    scores[rows], found[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)


def trees(placed: DataFrame) -> DataFrame:
    """A row a shard (shard, dim, tree, centre, radius, least_id): placed has vec_id, v, dim, shard."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(part.vec_id.to_numpy(), np.stack(part.v.to_numpy()).astype(float))
        return pd.DataFrame({"shard": part.shard.iloc[:1], "dim": part.dim.iloc[0], "tree": [pickle.dumps(tree)], "centre": [tree.centre[0].tobytes()], "radius": tree.radius[0], "least_id": part.vec_id.min()})

    return placed.groupBy("shard").applyInPandas(build, "shard long, dim int, tree binary, centre binary, radius double, least_id long")


def searched(visits: DataFrame, forest: DataFrame, k: int) -> DataFrame:
    """visits (query_id, v, shard, floor): the best k of the shard for each visit, those that can count. A shard of many visits is copied for each QUERY_ROWS of them."""

    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(queries) or not len(shard):
            return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
        tree = pickle.loads(shard.tree.iloc[0])
        own = queries.query_id.to_numpy()
        scores, found = np.full((len(own), k), -np.inf), np.full((len(own), k), NONE)
        tree.search(np.stack(queries.v.to_numpy()).astype(float), own, scores, found, queries.floor.to_numpy())
        real = np.isfinite(scores) & (scores >= queries.floor.to_numpy()[:, None])
        return pd.DataFrame({"query_id": np.repeat(own, k)[real.ravel()], "vec_id": found[real], "score": scores[real].astype(np.int64)}, columns=names)

    slices = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("slices"))  # a row a shard
    visits = visits.join(F.broadcast(slices), "shard").withColumn("slice", F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("slices"))).drop("slices")
    copies = slices.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("part")).join(forest.select("shard", "tree"), "shard").select(F.col("shard").alias("of"), "part", "tree")
    return visits.groupBy("shard", "slice").cogroup(copies.groupBy("of", "part")).applyInPandas(run, "query_id long, vec_id long, score long")


def balls_of(forest: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length of vectors (shards, centres, radii, least ids), gathered: at most MOST_SHARDS and a length's last shards."""
    t = forest.select("shard", "dim", "centre", "radius", "least_id").toPandas().sort_values("shard")
    return {int(d): (p.shard.to_numpy(), np.stack([np.frombuffer(b, float) for b in p.centre]), p.radius.to_numpy(), p.least_id.to_numpy()) for d, p in t.groupby("dim")}


def bounded(queries: DataFrame, balls: dict[int, tuple[np.ndarray, ...]], last: bool) -> DataFrame:
    """queries (query_id, vkey, v, dim, floor, tie): (query_id, vkey, shard, nth, bound, least_id) of each query's THEN shards of the highest bounds, or, for the last round, of the others that can
    change its best k: the bound, a whole number, is above the floor, or equals it and the shard has ids below the largest one that the query holds at its floor."""
    sent = queries.sparkSession.sparkContext.broadcast(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in sent.value:
                    continue
                shards, centres, radii, least = sent.value[int(dim)]
                every = np.flatnonzero(dims == dim)
                for i in range(0, len(every), step := max(1, 4_000_000 // len(shards))):
                    at = every[i : i + step]
                    ids, keys, floor, tie = (batch.column(c).to_numpy()[at] for c in ("query_id", "vkey", "floor", "tie"))
                    q = matrix(batch.column("v").take(pa.array(at)), int(dim))
                    b = q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radii
                    b = np.where(np.isfinite(b), np.floor(b + 1e-9 * (1 + np.abs(b))), np.inf)
                    order = np.argsort(-b, axis=1, kind="stable")[:, :THEN]
                    if last:
                        can = (b > floor[:, None]) | ((b == floor[:, None]) & (least < tie[:, None]))
                        np.put_along_axis(can, order, False, axis=1)
                        row, col = np.nonzero(can)
                        nth = np.full(len(row), THEN)
                    else:
                        row, col, nth = np.repeat(np.arange(len(at)), order.shape[1]), order.ravel(), np.tile(np.arange(order.shape[1]), len(at))
                    cols = (ids[row], keys[row], shards[col], nth, b[row, col], least[col])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.float64(), pa.int64()), strict=True)], ["query_id", "vkey", "shard", "nth", "bound", "least_id"])

    return queries.select("query_id", "vkey", "v", "dim", "floor", "tie").mapInArrow(run, "query_id long, vkey long, shard long, nth long, bound double, least_id long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query's k highest inner products with candidates of other ids, ties to the smaller vec_id.

    Both inputs are as from as_integers(); only vectors of one length meet. Fewer than k rows if there are fewer candidates. Sums are exact below 2**53. Repeated
    candidate rows count once; repeated queries too. Vectors of no components meet nothing, however long others are. Empty tables give no rows. Other columns, whatever their
    names, are dropped by as_integers()."""
    candidates = written(candidates.dropDuplicates(["vec_id", "v"]).where("dim > 0"), "vectors")
    n = candidates.count()
    near = row_numbers(dealt(candidates, pivots_of(candidates, n)), "dim", "pivot", "far", "vec_id")
    starts = near.groupBy("dim", "pivot").agg(F.min("rn").alias("first"))  # a row a pivot
    size = max(SHARD_ROWS, -(-n // MOST_SHARDS))
    # a shard is told by the number of its first row
    shard = F.col("rn") - F.pmod(F.col("rn") - F.col("first"), F.lit(size))
    placed = near.join(F.broadcast(starts), ["dim", "pivot"]).select("vec_id", "v", "dim", shard.alias("shard"))
    forest = written(trees(placed), "forest")
    balls = balls_of(forest)
    queries = queries.dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), "v", "dim", F.xxhash64("v").alias("vkey"))
    free = (F.lit(float("-inf")).alias("floor"), F.lit(NONE).alias("tie"))
    first = written(bounded(queries.select("*", *free), balls, False), "first")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def floors(every: DataFrame) -> DataFrame:
        """(query_id, floor, tie) of queries that have k neighbours."""
        low = F.max(F.struct(-F.col("score"), "vec_id")).alias("low")
        return every.groupBy("query_id").agg(F.count("*").alias("n"), low).where(F.col("n") >= k).select("query_id", (-F.col("low.col1")).cast("double").alias("floor"), F.col("low.vec_id").alias("tie"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def visited(visits: DataFrame) -> DataFrame:
        return searched(visits.join(queries, ["query_id", "vkey"]).select("query_id", "v", "shard", "floor"), forest, k)

    def with_floors(rows: DataFrame, every: DataFrame) -> DataFrame:
        return rows.join(floors(every), "query_id", "left").withColumns({"floor": F.coalesce("floor", free[0]), "tie": F.coalesce("tie", free[1])})

    every = written(ranked(visited(first.where(F.col("nth") < FIRST).withColumn("floor", free[0]))), "best")
    can = (F.col("bound") > F.col("floor")) | ((F.col("bound") == F.col("floor")) & (F.col("least_id") < F.col("tie")))
    again = written(with_floors(first.where(F.col("nth") >= FIRST), every).where(can), "again")
    every = written(ranked(every.drop("rank").unionByName(visited(again))), "best")
    rest = written(bounded(with_floors(queries, every), balls, True), "rest")
    rest = rest.join(floors(every), "query_id", "left").withColumn("floor", F.coalesce("floor", free[0]))
    return ranked(every.drop("rank").unionByName(visited(rest))).select("query_id", "rank", "vec_id", "score")
