"""Vector tables: pooling, standardisation, Gram matrices, PCA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.sources.work import written

FAN = 8


def mean_pool(df: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """The mean vector of each key, by partial sums in map tasks. A4; for means of means pool twice."""
    v = array_to_vector(F.col(col).cast("array<double>"))
    return df.where(F.col(col).isNotNull()).groupBy(key).agg(Summarizer.mean(v).alias("m")).select(key, vector_to_array("m").alias(col))


def mean_pool_sql(df: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """mean_pool() by exploding: for short vectors. A4."""
    parts = df.select(key, F.posexplode(col).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select(key, F.col("m.x").alias(col))


def vector_stats(df: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: mean and population std a component, 1 where the variance is zero. M1."""
    v = array_to_vector(F.col(col).cast("array<double>"))
    s = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"))
    n = F.col("s.count")
    std = F.transform(vector_to_array("s.variance"), lambda x: F.when(x > 1e-24, F.sqrt(x * (n - 1) / n)).otherwise(1.0))
    return s.select(vector_to_array("s.mean").alias("mean"), std.alias("std"))


def standardize(df: DataFrame, stats: DataFrame, col: str = "embedding") -> DataFrame:
    """The column with each component less its mean, over its std. M1."""
    out = df.crossJoin(F.broadcast(stats.select(F.col("mean").alias("__m"), F.col("std").alias("__s"))))
    z = F.zip_with(F.zip_with(F.col(col).cast("array<double>"), F.col("__m"), lambda x, m: x - m), F.col("__s"), lambda x, s: x / s)
    return out.withColumn(col, z).drop("__m", "__s")


def gram(df: DataFrame, col: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, D x D matrix of X'X): each partition adds up its own matrix, and the matrices are added by row on executors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = None, None, 0
        for batch in batches:
            c = batch.column(0)
            if len(c):
                x = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
                total, sums = (x.T @ x, x.sum(axis=0)) if total is None else (total + x.T @ x, sums + x.sum(axis=0))
                n += len(c)
        if total is not None:
            d = len(sums)
            rows = [*total.tolist(), sums.tolist(), [float(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 2), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["i", "v"])

    parts = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>")).mapInArrow(part, "i int, v array<double>")
    rows = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()  # D + 2 rows
    by = {r.i: r.v.toArray() for r in rows}
    if not by:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = len(by) - 2
    return int(by[d + 1][0]), by[d], np.stack([by[i] for i in range(d)])


def _matrix(column: pa.Array | pa.ChunkedArray, d: int | None = None) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if d is None else d)


def singular_values(df: DataFrame, col: str = "embedding") -> np.ndarray:
    """Singular values of the rows' matrix, falling, by QR in a tree: a task keeps the R factor of what it has read, and R factors are stacked and factored again, FAN at a time.

    Nothing is squared, so small values keep their digits. A factor is D x D; tasks hold FAN of them, and the driver the last one. Rows without vector are left out."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = place = None
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch[i : i + 4096]
                place, x = part.column(1)[0].as_py(), _matrix(part.column(0))
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([r.tobytes()], pa.binary()), pa.array([r.shape[1]], pa.int32())], ["place", "r", "d"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        d = int(part.d.iloc[0])
        r = np.linalg.qr(np.vstack([np.frombuffer(b, float).reshape(-1, d) for b in part.sort_values("place").r]), mode="r")
        return pd.DataFrame({"place": part.place.iloc[:1] // FAN, "r": [r.tobytes()], "d": d})

    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>"), F.spark_partition_id().cast("long").alias("place"))
    factors = written(rows.mapInArrow(factor, "place long, r binary, d int"), "factors")
    last = factors.agg(F.max("place").alias("p")).first().p
    while last:
        factors = factors.groupBy(F.floor(F.col("place") / FAN)).applyInPandas(merged, "place long, r binary, d int")
        last //= FAN
    got = factors.collect()
    return np.linalg.svd(np.frombuffer(got[0].r, float).reshape(-1, got[0].d), compute_uv=False) if got else np.zeros(0)


def effective_rank(df: DataFrame, col: str = "embedding") -> DataFrame:
    """exp of the entropy of the singular values' shares, uncentred. A23."""
    s = singular_values(df, col)
    p = s[s > 0] / s.sum() if s.sum() else s[:0]
    return df.sparkSession.createDataFrame([(float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0,)], "effective_rank double")


def pca(df: DataFrame, k: int = 2, col: str = "embedding") -> tuple[DataFrame, list[float]]:
    """df with pc, its k principal components after centring (the largest loading is positive), and the explained shares of variance. M7."""
    n, sums, g = gram(df, col)
    mean = sums / n
    values, vectors = np.linalg.eigh(g / n - np.outer(mean, mean))
    top = np.argsort(values)[::-1][:k]
    axes = vectors[:, top].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]

    @F.arrow_udf("array<double>")
    def project(vs: pa.Array) -> pa.Array:
        x = vs.flatten().to_numpy(zero_copy_only=False).reshape(len(vs), -1)
        return pa.array(((x - mean) @ axes.T).tolist(), pa.list_(pa.float64()))

    return df.withColumn("pc", project(F.col(col).cast("array<double>"))), [float(v) for v in values[top] / values.sum()]
