"""Bootstrap of sums without a table of draws (A17), and metrics of a caller's own in Python (M9).

Rows are numbered 1 .. n and cut into blocks of BLOCK_ROWS. The n draws of a replicate go down a binary tree over the blocks: each node splits what reaches it between its halves by
a binomial draw that is seeded by the node, so a task finds its own block's counts of all replicates alone, along one path, and they add up to n exactly. Inside the block the
draws fall on rows, and weights times columns gives the block's part of every replicate's sums. So a replicate costs a row a block, not a row a draw, and no draw is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ranks import row_numbers

BLOCK_ROWS = 10_000


def block_counts(n: int, block: int, replicates: int, seed: int, size: int) -> np.ndarray:
    """How many of each replicate's n draws fall on a block of `size` rows."""
    lo, hi = 0, math.ceil(n / size)
    counts = np.full(replicates, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rows, left = min(n, hi * size) - lo * size, (mid - lo) * size
        part = np.random.default_rng([seed, lo, hi]).binomial(counts, left / rows)
        if block < mid:
            counts, hi = part, mid
        else:
            counts, lo = counts - part, mid
    return counts


def block_weights(n: int, block: int, replicates: int, seed: int, size: int) -> Iterator[np.ndarray]:
    """For each replicate, how often each row of the block is drawn."""
    rows = min(n, (block + 1) * size) - block * size
    rng = np.random.default_rng([seed, block, 1 << 32])
    for count in block_counts(n, block, replicates, seed, size):
        yield np.bincount(rng.integers(0, rows, count), minlength=rows)


def replicate_sums(df: DataFrame, sums: dict[str, Column | str], order: Sequence[Column | str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, drawn, sums by name): each replicate's sums over the rows that it draws, nulls as 0; drawn is their number, n.

    The order numbers the rows, so it should be unique for reruns to agree. An empty table gives no rows."""
    names = list(sums)
    own = df.select(*(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0)).cast("double").alias(f"__s{i}") for i, c in enumerate(sums.values())), *(o if isinstance(o, Column) else F.col(o) for o in order))
    placed = row_numbers(own, *order, name="__row")
    n, size = placed.count(), BLOCK_ROWS
    blocks = placed.select(F.floor((F.col("__row") - 1) / size).alias("__block"), "__row", *(f"__s{i}" for i in range(len(names))))

    def of_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__row")
        x = np.column_stack([np.ones(len(rows)), *(rows.column(f"__s{i}").to_numpy() for i in range(len(names)))])
        got = np.stack([w @ x for w in block_weights(n, rows.column("__block")[0].as_py(), replicates, seed, size)])
        return pa.table({"replicate": np.arange(replicates), "drawn": got[:, 0].astype(np.int64), **{f"s{i}": got[:, i + 1] for i in range(len(names))}})

    schema = ", ".join(["replicate long", "drawn long", *(f"s{i} double" for i in range(len(names)))])
    parts = blocks.groupBy("__block").applyInArrow(of_block, schema)
    return parts.groupBy("replicate").agg(F.sum("drawn").alias("drawn"), *(F.sum(f"s{i}").alias(name) for i, name in enumerate(names)))


def sums_ci(df: DataFrame, sums: dict[str, Column | str], values: dict[str, Column], order: Sequence[Column | str], replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(metric, value, lower, upper) of metrics that are expressions over sums and `drawn`, the number of rows: the point over all rows, percentile bounds over the replicates in which it is defined."""
    point = df.agg(F.count("*").alias("drawn"), *(F.coalesce(F.sum(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0)).cast("double")), F.lit(0.0)).alias(name) for name, c in sums.items()))
    reps = replicate_sums(df, sums, order, replicates, seed)
    tails = [(1 - level) / 2, (1 + level) / 2]
    bounds = reps.agg(*(F.percentile(F.when(~F.isnan(v.cast("double")), v.cast("double")), tails).alias(f"__{m}") for m, v in values.items()))  # one row
    one = point.select(*(v.cast("double").alias(m) for m, v in values.items())).crossJoin(F.broadcast(bounds))
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.coalesce(F.col(f"__{m}")[0], m).alias("lower"), F.coalesce(F.col(f"__{m}")[1], m).alias("upper")) for m in values]
    return one.select(F.inline(F.array(*rows)))


def python_metric(f: Callable[..., float | None], cols: Sequence[str], name: str) -> Callable[[DataFrame, Sequence[str], str | None], DataFrame]:
    """A metric for bootstrap_ci() from f(*columns, weights) over numpy arrays, for what has no column form, such as medians. M9.

    Spark aggregates groups in Arrow: a group's columns are one task's, so a replicate's rows have to fit in it. Rows without weight count once."""

    @F.arrow_udf("double", F.ArrowUDFType.GROUPED_AGG)
    def own(*arrays: pa.Array) -> float:
        return f(*(a.to_numpy(zero_copy_only=False) for a in arrays))

    def metric(df: DataFrame, by: Sequence[str], weight: str | None) -> DataFrame:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        return df.groupBy(*by).agg(own(*(F.col(c) for c in cols), w).alias(name))

    return metric


def weighted_median(x: np.ndarray, w: np.ndarray) -> float | None:
    """The least value with half of the weight at or below it."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(w[order])
    return float(x[order][np.searchsorted(upto, upto[-1] / 2)]) if len(x) else None

