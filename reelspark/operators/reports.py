"""Reports and log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ranks import rolling_mean


def summary(df: DataFrame, splits: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """One row a task from (task, split, metric, value, lower, upper): columns {split}_{metric}, with _lo and _hi. A24."""
    names = [f"{s}_{m}" for s in splits for m in metrics]
    wide = df.withColumn("name", F.concat_ws("_", "split", "metric")).groupBy("task").pivot("name", names)
    wide = wide.agg(F.first("value").alias("v"), F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    return wide.select("task", *(F.round(F.col(f"`{n}_{a}`"), digits).alias(n + b) for n in names for a, b in (("v", ""), ("lo", "_lo"), ("hi", "_hi"))))


def scaling_table(df: DataFrame, fractions: Sequence[int]) -> DataFrame:
    """(task, f{fraction}.., delta) of (task, fraction, value), and a row `mean` over the tasks that have a value; delta is last less first. A25."""
    wide = df.groupBy("task").pivot("fraction", list(fractions)).agg(F.first("value"))
    wide = wide.select("task", *(F.col(f"`{f}`").alias(f"f{f}") for f in fractions))
    mean = wide.agg(*(F.avg(f"f{f}").alias(f"f{f}") for f in fractions)).select(F.lit("mean").alias("task"), "*")
    return wide.unionByName(mean).withColumn("delta", F.col(f"f{fractions[-1]}") - F.col(f"f{fractions[0]}"))


def log_rollup(df: DataFrame, k: int = 10, smooth: int = 5) -> DataFrame:
    """A row an epoch: mean loss and its centred mean; and over all epochs the least mean, the last epoch and the mean of its last k rows. A26."""
    per = rolling_mean(df.groupBy("epoch").agg(F.avg("loss").alias("mean_loss")), "mean_loss", smooth, "epoch")
    every = per.agg(F.min("mean_loss").alias("min_loss"), F.max("epoch").alias("last_epoch"))
    last = per.join(F.broadcast(every), F.col("epoch") > F.col("last_epoch") - k).agg(F.avg("mean_loss").alias("last_k_mean"))
    return per.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(last))


def corpus_estimate(shards: DataFrame, per_shard: int = 1000, batch: int = 1, workers: int = 1) -> DataFrame:
    """shards, samples, batches a worker. A28."""
    n = F.count("*")
    return shards.agg(n.alias("shards"), (n * per_shard).alias("samples"), F.floor(n * per_shard / (batch * workers)).cast("long").alias("batches_per_worker"))


def throughput(progress: DataFrame, ts: str = "ts", status: str = "status") -> DataFrame:
    """A row a status: n, and n a second between the log's first and last entry. A29."""
    span = progress.agg((F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("us"))
    per = progress.groupBy(status).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(span)).select(status, "n", F.when(F.col("us") > 0, F.col("n") * 1e6 / F.col("us")).alias("per_second"))
