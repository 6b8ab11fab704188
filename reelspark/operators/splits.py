"""Seeded splits and samples (L3 to L6): the order is that of a portable hash of seed and id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.columns import hash_int
from reelspark.operators.ranks import row_numbers


def _hash_order(key: str, seed: int):
    return hash_int(seed, F.col(key)), F.col(key)


def split_studies(df: DataFrame, val_frac: float, seed: int, holdout: list, key: str = "id", site: str = "site") -> DataFrame:
    """Adds split: holdout for the held-out sites; of the others the first max(1, int(val_frac * n)) in hash order are val. L3."""
    held = F.coalesce(F.col(site).isin(*holdout), F.lit(False))
    free = row_numbers(df.where(~held).select(key).distinct(), *_hash_order(key, seed))
    n = free.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") * F.lit(val_frac))).alias("__n"))
    side = free.crossJoin(F.broadcast(n)).select(key, F.when(F.col("rn") <= F.col("__n"), "val").otherwise("train").alias("__side"))
    out = df.withColumn("__held", held).join(side, key, "left")
    return out.withColumn("split", F.when(F.col("__held"), "holdout").otherwise(F.col("__side"))).drop("__held", "__side")


def take_fraction(df: DataFrame, fraction: float, seed: int, key: str = "id") -> DataFrame:
    """max(1, int(n * fraction)) rows in hash order: a smaller fraction's rows are among a larger one's. L4."""
    ranked = row_numbers(df, *_hash_order(key, seed))
    n = ranked.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") * F.lit(fraction))).alias("__n"))
    return ranked.crossJoin(F.broadcast(n)).where("rn <= __n").drop("rn", "__n")


def sample_items(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows, the first in hash order. L5."""
    return df.orderBy(*_hash_order(key, seed)).limit(n)


def hash_split(df: DataFrame, val_frac: float, seed: int, key: str) -> DataFrame:
    """Adds split (train or val) by the hash of the key alone: disjoint whatever rows are sampled. L5."""
    return df.withColumn("split", F.when(hash_int(seed, F.col(key)) < int(val_frac * (1 << 32)), "val").otherwise("train"))


def cap_per_worker(df: DataFrame, n: int, workers: int, *order: str) -> DataFrame:
    """The first n rows of each worker, rows being dealt to workers in turn: those of the first n * workers places. L6."""
    out = row_numbers(df, *order).withColumn("worker", F.pmod(F.col("rn") - 1, F.lit(workers)).cast("int"))
    return out.where(F.col("rn") <= n * workers)
