"""Joins and set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row a key: the first in the order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def enrich_manifest(manifest: DataFrame, meta: DataFrame, key: str, wanted: list[str], order: list[str]) -> DataFrame:
    """Every manifest row with those of the wanted metadata columns that exist, the first row of a repeated key. J1."""
    cols = [c for c in wanted if c in meta.columns]
    return manifest.join(first_per_key(meta, key, *order).select(key, *cols), key, "left")


def attach_annotations(df: DataFrame, items: DataFrame, studies: DataFrame, item: str, study: str, kind: str) -> DataFrame:
    """Every row with its item's kind ('' if missing) and its study's fields (null if missing). J2."""
    out = df.join(items.select(item, kind), item, "left").withColumn(kind, F.coalesce(kind, F.lit("")))
    return out.join(studies, study, "left")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed. J3."""
    return df.join(ids.select(key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed, null keys too. J4."""
    return df.join(ids.select(key), key, "left_anti")


def propagate_labels(labels: DataFrame, items: DataFrame, study: str) -> DataFrame:
    """A study's label on each of its items. J5."""
    return items.join(labels, study)


def labelled_embeddings(emb: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Embeddings that have a label. J6."""
    return emb.join(labels, key)


def attach_site(df: DataFrame, sites: DataFrame, study: str, site: str) -> DataFrame:
    """Every row with its site, '' if unknown. J7."""
    return df.join(sites.select(study, site), study, "left").withColumn(site, F.coalesce(site, F.lit("")))


def missing_ids(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Wanted ids that were never found. J9."""
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def locate(index: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The index rows to fetch. J10."""
    return index.join(ids.select(key).distinct(), key)


def union_ids(*frames: DataFrame) -> DataFrame:
    """Distinct ids of one-column tables. U1, U2."""
    return reduce(DataFrame.union, frames).distinct()


union_label_ids = union_ids


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3."""
    return a.intersect(b)


def subtract_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4."""
    return a.subtract(b)


def skip_set(done: DataFrame, holdout: DataFrame) -> DataFrame:
    """U5."""
    return union_ids(done, holdout)


def stack_splits(**splits: DataFrame) -> DataFrame:
    """Rows of each split with its name. U6."""
    return reduce(DataFrame.unionByName, (df.withColumn("split", F.lit(name)) for name, df in splits.items()))


def audit_splits(df: DataFrame, labels: DataFrame, held_sites: list, key: str = "id", split: str = "split", site: str = "site") -> DataFrame:
    """(check, n): ids in several splits, held-out sites elsewhere, held-out splits of other sites, labels in no split. All must be 0. U7."""
    several = df.groupBy(key).agg(F.countDistinct(split).alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("ids_in_several_splits").alias("check"), "n")
    held = F.col(site).isin(*held_sites)
    leaks = df.agg(F.count_if(held & (F.col(split) != "holdout")).alias("n")).select(F.lit("held_site_outside_holdout").alias("check"), "n")
    other = df.agg(F.count_if(~held & (F.col(split) == "holdout")).alias("n")).select(F.lit("other_site_in_holdout").alias("check"), "n")
    lost = labels.join(df, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("labels_in_no_split").alias("check"), "n")
    return several.unionByName(leaks).unionByName(other).unionByName(lost)
