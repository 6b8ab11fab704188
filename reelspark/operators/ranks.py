"""Global ranks and prefix sums without a one-partition window (W2 to W8), and first rows (L1, L2).

A global row number is taken in two passes: a range-partitioned, sorted copy of the rows is written
down, so that both passes see the same partitions; each partition's count, one row a partition, gives the
offset that its own increasing row ids need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.sources.work import written


def _ordered(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows in range partitions, sorted, with __part and __at, increasing in the order."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return written(placed.withColumn("__part", F.shiftright("__at", 33)), "ordered")


def row_numbers(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """Adds the row number, from 1, in the order; ties in any order."""
    placed = _ordered(df, list(order))
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))  # a row a partition
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", (before - F.col("first") + 1).alias("__off"))
    return placed.join(F.broadcast(parts), "__part").withColumn(name, F.col("__at") + F.col("__off")).drop("__part", "__at", "__off")


def prefix_sums(df: DataFrame, sums: dict[str, str], order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """Adds sums[name] = running total of each column `name` up to and with the row, in the order (in each group `by`).

    Rows of a partition are summed in place; a group's earlier partitions add their totals. One row a group and partition is
    gathered, never the rows themselves."""
    by = by or []
    placed = _ordered(df, [*by, *order])
    own = W.partitionBy("__part", *by)
    parts = placed.groupBy("__part", *by).agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("__part", *by, *(F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums))
    upto = own.orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    same = placed["__part"] == parts["__part"]
    for c in by:
        same = same & placed[c].eqNullSafe(parts[c])
    out = placed.join(parts, same).select(placed["*"], *(parts[f"__o_{c}"] for c in sums))
    for c, name in sums.items():
        out = out.withColumn(name, F.sum(c).over(upto) + F.col(f"__o_{c}"))
    return out.drop("__part", "__at", *(f"__o_{c}" for c in sums))


def assign_shards(df: DataFrame, size: int, *order: Column | str, start: int = 0) -> DataFrame:
    """Adds shard_id: `size` rows a shard in the order, numbered from `start`. W3."""
    return row_numbers(df, *order).withColumn("shard_id", (F.floor((F.col("rn") - 1) / size) + start).cast("long"))


def assign_round_robin(df: DataFrame, workers: int, *order: Column | str) -> DataFrame:
    """Adds worker: rows dealt in turn in the order. W3."""
    return row_numbers(df, *order).withColumn("worker", F.pmod(F.col("rn") - 1, F.lit(workers)).cast("int"))


def curve(df: DataFrame, score: str = "score", truth: str = "y", weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """A row per distinct score (in each group): cumulative true and false positives at that threshold. W4."""
    w = F.col(weight) if weight else F.lit(1)
    by = by or []
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w * (F.col(truth) == 1).cast("int")).alias("pos"), F.sum(w * (F.col(truth) != 1).cast("int")).alias("neg"))
    return prefix_sums(counts, {"pos": "tp", "neg": "fp"}, [F.desc("score")], by)


def avg_rank(df: DataFrame, col: str, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Adds the average rank, from 1, of the column's values: ties share the mean of their ranks. W5."""
    by = by or []
    counts = df.groupBy(*by, F.col(col).alias("__v")).agg(F.count("*").alias("n"))
    ranks = prefix_sums(counts, {"n": "upto"}, ["__v"], by).select(*(F.col(c).alias(f"__b_{c}") for c in by), "__v", (F.col("upto") - (F.col("n") - 1) / 2).alias(name))
    same = F.col(col) == F.col("__v")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return df.join(ranks, same).drop("__v", *(f"__b_{c}" for c in by))


def rolling_mean(df: DataFrame, col: str, window: int, order: str, by: list[str] | None = None) -> DataFrame:
    """Adds {col}_smooth, the centred mean of `window` rows, fewer at the edges. W6: for rolled-up tables of a row a step."""
    w = W.partitionBy(*(by or [])).orderBy(order).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn(f"{col}_smooth", F.avg(col).over(w))


def top_items(df: DataFrame, group: str, by: str, key: str, k: int = 3) -> DataFrame:
    """The k rows of the largest `by` in each group, nulls last, ties by key. W2."""
    w = W.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def resolve_duplicates(df: DataFrame, key: str, order: list[str], policy: str = "last") -> DataFrame:
    """One row a key: the last or the first in the order. W7."""
    cols = [F.desc(c) if policy == "last" else F.asc(c) for c in order]
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*cols))).where("__rn = 1").drop("__rn")


def best_run(df: DataFrame, metric: str, position: str, mode: str = "max", by: list[str] | None = None) -> DataFrame:
    """The first row, by position, of the best metric (in each group). W8."""
    w = W.partitionBy(*(by or [])).orderBy(F.desc_nulls_last(metric) if mode == "max" else F.asc_nulls_last(metric), position)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """L1."""
    return df.orderBy(key).limit(n)


def physical_order(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of neighbouring places together and in order, for sequential reads. L2."""
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols)
