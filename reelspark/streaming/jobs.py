"""Structured Streaming jobs (T1 to T7). Each returns a started query or a streaming frame; stream and batch give equal rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reelspark.operators import joins
from reelspark.sources import tar, writers


def _published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else spark.createDataFrame([], schema)


def resume_stream(spark: SparkSession, source: str, schema: str, progress: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], retry_errors: bool = False, files_per_batch: int = 1) -> StreamingQuery:
    """Processes manifest files as they come, without ids that have a status, and logs a status for each. T1.

    A batch writes its results and statuses into folders of its own number, so that a repeated batch replaces its own."""

    def work(batch: DataFrame, number: int) -> None:
        done = _published(spark, progress, "id string, status string, ts timestamp, batch long").where(F.col("batch") != number)
        if retry_errors:
            done = done.where("status <> 'error'")
        todo = joins.drop_ids(batch.dropDuplicates(["id"]), done, "id")
        result = process(todo)
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")
        spark.read.parquet(f"{out}/batch={number}").select("id", "status", F.current_timestamp().alias("ts")).write.mode("overwrite").parquet(f"{progress}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "shard-*.tar") -> StreamingQuery:
    """Appends the index of shards that are new in a folder. T2."""

    def work(batch: DataFrame, number: int) -> None:
        tar.members(batch.select("path")).where("fmt <> 'json'").select("key", "shard", "offset", "size", "fmt").write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder).select("path")
    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_stream(frames: DataFrame, meta: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Frames with the metadata of their key that comes within the delay before or after; null metadata if none does. T3."""
    f, m = frames.withWatermark(ts, delay).alias("f"), meta.withWatermark(ts, delay).alias("m")
    near = (F.col("f.key") == F.col("m.key")) & F.col(f"m.{ts}").between(F.expr(f"f.{ts} - interval {delay}"), F.expr(f"f.{ts} + interval {delay}"))
    return f.join(m, near, "left_outer").select("f.key", F.col(f"f.{ts}").alias(ts), "f.frames", F.coalesce("m.metadata", F.lit("{}")).alias("metadata"))


def log_meter(df: DataFrame, window: str = "1 hour", slide: str | None = None, ts: str = "ts", value: str = "loss", by: str | None = None) -> DataFrame:
    """(start, end, n, mean, least) of each window. T4; on a batch its twin."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    keys = [w.alias("w"), *([by] if by else [])]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([by] if by else []), "n", "mean", "least")


def log_meter_stream(df: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "1 hour", ts: str = "ts", value: str = "loss", by: str | None = None) -> DataFrame:
    """As log_meter(), for append mode: a window is given once it can't change. T4."""
    return log_meter(df.withWatermark(ts, delay), window, slide, ts, value, by)


def progress_stream(df: DataFrame, status: str = "status") -> DataFrame:
    """Counts by status, for update or complete mode; progress_counters() counts as rows come. T5."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


class _Counters(StatefulProcessor):
    """Counts of a worker's statuses, kept between batches."""

    def __init__(self, every: int, flush: int, idle_ms: int):
        self.every, self.flush, self.idle_ms = every, flush, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "logged long, processed long, skipped long, errors long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        logged, processed, skipped, errors, timer = self.counts.get() or (0, 0, 0, 0, 0)
        last = timer
        for us, _, status in sorted(((r.us, r.id, r.status) for r in rows), key=lambda r: [(x is None, x or 0) for x in r[:2]]):  # nulls last
            logged += 1
            processed, skipped, errors = processed + (status == "processed"), skipped + (status == "skipped"), errors + (status == "error")
            last = last if us is None else max(last, us // 1000 + self.idle_ms)
            if status == "processed" and processed % self.every == 0:
                yield Row(worker=key[0], kind="counter", logged=logged, processed=processed, skipped=skipped, errors=errors)
            if logged % self.flush == 0:
                yield Row(worker=key[0], kind="flush", logged=logged, processed=processed, skipped=skipped, errors=errors)
        if last != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last)
        self.counts.update((logged, processed, skipped, errors, last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        logged, processed, skipped, errors, _ = self.counts.get()
        self.counts.update((logged, processed, skipped, errors, 0))
        yield Row(worker=key[0], kind="idle", logged=logged, processed=processed, skipped=skipped, errors=errors)


def progress_counters(df: DataFrame, every: int = 100, flush: int = 50, idle: timedelta = timedelta(hours=1), delay: str = "1 minute") -> DataFrame:
    """(worker, kind, logged, processed, skipped, errors) of a stream (worker, ts, id, status): a worker's counters at each `every` processed ones, at each `flush` logged ones, and once
    the watermark is `idle` past its last row. T5. Rows of a batch count in the order of ts and id.

    State is five numbers a worker; a stream is keyed by worker, so no task counts all. The session needs the RocksDB state store (with_rocksdb)."""
    rows = df.select("worker", "ts", F.unix_micros("ts").alias("us"), "id", "status").withWatermark("ts", delay)
    schema = f"worker {df.schema['worker'].dataType.simpleString()}, kind string, logged long, processed long, skipped long, errors long"
    return rows.groupBy("worker").transformWithState(_Counters(every, flush, int(idle.total_seconds() * 1000)), outputStructType=schema, outputMode="append", timeMode="EventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """State of arbitrary stateful operators is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dedup_stream(df: DataFrame, key: str = "key", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first row of each key within the delay. T6."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def embed_stream(df: DataFrame, store: writers.EmbeddingStore, embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Embeds what comes and puts it into the store, newer vectors over older ones. T7. Repeating a batch changes nothing."""

    def work(batch: DataFrame, number: int) -> None:
        store.upsert(embed(batch))

    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
