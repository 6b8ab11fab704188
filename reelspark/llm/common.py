"""What the training-data operators share: written tables, and text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.sources.work import discard, shared_dir, work_dir, written

__all__ = ["WORD", "discard", "few", "n_words", "quoted", "shared_dir", "table", "uniform", "work_dir", "written"]

#: ASCII white space that separates words, and the pattern of a word.
WORD = "[^\\x20\\x09-\\x0D]+"


def few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices. Spark bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch); a slice bounds what becomes Python objects at once."""
    for batch in batches:
        for i in range(0, max(1, len(batch)), rows):
            yield batch[i : i + rows]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of a name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def n_words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A draw from [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))
