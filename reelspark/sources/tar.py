"""Operators on sample shards (S9 to S11, K2): see shards.py for the format."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators.ranks import assign_shards
from reelspark.sources.shards import TASK_BYTES, headers, listed, opened, payload, register

MEMBER = "shard string, key string, fmt string, offset long, size long, seq long"


def members(shards: DataFrame, on_error: str = "skip") -> DataFrame:
    """A row per sample member of the shards in `path`: shard, key, fmt, offset and size of its data, place in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with opened(uri) as f:
                    rows = [(uri, *row) for row in headers(f, on_error)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "key", "fmt", "offset", "size", "seq"])

    return shards.select("path").repartition("path").mapInArrow(run, MEMBER)


def _shards(spark: SparkSession, dirs: list[str], content: str, min_bytes: int) -> DataFrame:
    register(spark)
    paths = [spark._jvm.org.apache.hadoop.fs.Path(d) for d in dirs]
    full = [str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()) for p in paths]  # as Spark's own sources name files
    return spark.read.format("sample_shards").option("paths", json.dumps(full)).option("content", content).option("minBytes", min_bytes).load()


def index_shards(spark: SparkSession, dirs: list[str], min_bytes: int = 0) -> DataFrame:
    """(key, shard, offset, size, fmt) of each frames member. S9."""
    return _shards(spark, dirs, "index", min_bytes)


def fetch_payload(index: DataFrame, on_error: str = "fail") -> DataFrame:
    """The index with payload, the bytes of each range, null where the file ends before the range does. S11. Ranges are read in the order of their places.

    A file or store that can't be read fails the task, so that it is tried again ('fail'), or is told in the column payload_error ('tell')."""
    if on_error not in ("fail", "tell"):
        raise ValueError(f"on_error is fail or tell, not {on_error!r}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_uri, f = None, None
        for part in parts:
            out, errors = [], []
            for uri, offset, size in zip(part.shard, part.offset, part["size"], strict=True):
                data = error = None
                try:
                    if uri != open_uri:
                        open_uri = None
                        f = opened(uri)
                        open_uri = uri
                    data = payload(f, int(offset), int(size))
                except OSError as e:
                    if on_error == "fail":
                        raise
                    open_uri, error = None, f"{type(e).__name__}: {e}"
                out.append(data)
                errors.append(error)
            yield part.assign(payload=out) if on_error == "fail" else part.assign(payload=out, payload_error=errors)

    total = index.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
    # tasks by the bytes that they will read, not by the index's own size
    placed = index.repartitionByRange(max(1, math.ceil(total / TASK_BYTES)), "shard", "offset").sortWithinPartitions("shard", "offset")
    schema = ", ".join(f"`{n}` {t}" for n, t in index.dtypes) + ", payload binary" + (", payload_error string" if on_error == "tell" else "")
    return placed.mapInPandas(run, schema)


def read_samples(spark: SparkSession, dirs: list[str], min_bytes: int = 0) -> DataFrame:
    """(shard, key, frames, fmt, metadata): frames with their metadata text, '{}' if there is none or it isn't JSON; metadata alone is dropped. S10. Each byte is read once."""
    return _shards(spark, dirs, "samples", min_bytes)


def write_shards(df: DataFrame, path: str, shard_size: int = 1000, prefix: str = "shard") -> DataFrame:
    """Writes samples (key, frames, metadata) as tar shards of at most shard_size samples in key order, and returns (shard_id, path, n). K2.

    Numbers go on after the highest one in the folder. Samples are streamed, so a task holds one at a time; all shards appear at the job's commit."""
    start = max((int(uri.rsplit("-", 1)[-1][:-4]) + 1 for uri, _ in listed(path, f"{prefix}-*.tar")), default=0)
    placed = assign_shards(df.select("key", "frames", "metadata"), shard_size, "key", start=start)
    register(df.sparkSession)
    rows = placed.select("shard_id", "key", "frames", "metadata").repartition("shard_id").sortWithinPartitions("shard_id", "key")
    rows.write.format("sample_shards").mode("append").option("prefix", prefix).save(path)
    name = F.concat(F.lit(f"{path.rstrip('/')}/{prefix}-"), F.format_string("%06d", "shard_id"), F.lit(".tar"))
    return placed.groupBy("shard_id").agg(F.count("*").alias("n")).select(F.col("shard_id").cast("long").alias("shard_id"), name.alias("path"), "n")
