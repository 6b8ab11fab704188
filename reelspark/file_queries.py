"""Queries of sources, sinks and streams: a given table is written in the format, and read back through the operator."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import bootstrap, metrics
from reelspark.queries import BOOT, ITEMS, C, items, numbered, query, r6, table
from reelspark.sources import readers, tar, writers
from reelspark.sources.work import work_dir, written
from reelspark.streaming import jobs

SHARD = 200


# text, CSV and JSON sources


@query("s01_read_annotations", """SELECT o_orderkey::VARCHAR AS study_uuid, o_custkey::VARCHAR AS bmi, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS conditions, o_orderpriority AS conclusions, NULL::VARCHAR AS height,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS dicom_type FROM orders""")
def _(s, d):
    o = table(s, d, "orders").withColumn("bucket", F.floor(C("o_orderkey") / 50_000))
    key = C("o_orderkey").cast("string")
    study = F.struct(key.alias("study_uuid"), C("o_custkey").alias("bmi"), F.array("o_orderstatus", "o_orderpriority").alias("conditions"), C("o_orderpriority").alias("conclusions"), F.lit(1).alias("unlisted"))
    again = F.struct(key.alias("study_uuid"), F.lit(0).cast("long").alias("bmi"), F.array().cast("array<string>").alias("conditions"), F.lit("later").alias("conclusions"), F.lit(2).alias("unlisted"))
    item = F.struct(key.alias("dicom_uuid"), F.when(C("o_orderkey") % 3 > 0, C("o_orderstatus")).alias("type"))
    docs = o.groupBy("bucket").agg(F.to_json(F.struct(F.collect_list(item).alias("dicoms"), F.concat(F.collect_list(study), F.collect_list(again)).alias("studies"))).alias("value"))
    path = work_dir(s, "annotations")
    docs.write.partitionBy("bucket").text(path)  # a document a file
    found, studies = readers.read_annotations(s, path)
    return studies.join(found.withColumnRenamed("dicom_uuid", "study_uuid"), "study_uuid").select("study_uuid", "bmi", "conditions", "conclusions", "height", "dicom_type")


@query("s02_read_manifest", f"WITH {ITEMS} SELECT id AS dicom_uuid, study::VARCHAR AS study_uuid, CASE WHEN view = 'N' THEN NULL ELSE view END AS view, type, n_frames::DOUBLE AS n_frames, round(delta_cm, 6) AS delta FROM items")
def _(s, d):
    view = F.when(C("view") == "N", "nan").otherwise(C("view"))
    path = work_dir(s, "manifest")
    items(s, d).select(C("id").alias("dicom_uuid"), C("study").alias("study_uuid"), F.lit("/x").alias("disk_path"), view.alias("view"), "type", "n_frames", C("delta_cm").alias("physical_delta_x")).write.csv(path, header=True)
    return readers.read_manifest(s, path).select("dicom_uuid", "study_uuid", "view", "type", "n_frames", r6("physical_delta_x", "delta"))


def label_file(s: SparkSession, d: str, broken: str = "") -> str:
    """A list in which each id has an earlier label, a blank line and a later one."""
    path, key = work_dir(s, "labels"), C("o_orderkey").cast("string")
    table(s, d, "orders").select(F.concat(key, F.lit(" 1\n\n  "), key, F.lit("   "), C("o_totalprice").cast("string"), F.lit(broken)).alias("value")).write.text(path)
    return path


@query("s03_read_label_list", "SELECT o_orderkey::VARCHAR AS id, o_totalprice AS label FROM orders")
def _(s, d):
    return readers.read_label_list(s, label_file(s, d), "strict")


@query("s15_load_dataset", "SELECT o_orderkey::VARCHAR AS id, o_totalprice AS label FROM orders")
def _(s, d):
    return readers.load_dataset(s, "Labels", path=label_file(s, d, "\nthree tokens here\nword x"), mode="lenient")


@query("s04_read_id_list", "SELECT DISTINCT c_nationkey::VARCHAR AS id FROM customer")
def _(s, d):
    path = work_dir(s, "ids")
    table(s, d, "customer").select(F.concat(F.lit(" "), C("c_nationkey").cast("string"), F.lit("\n\n")).alias("value")).write.text(path)
    return readers.read_id_list(s, path)


@query("s05_read_site_map", "SELECT o_orderkey::VARCHAR AS study_icid, o_custkey::VARCHAR AS site_id FROM orders")
def _(s, d):
    rows = table(s, d, "orders").select(C("o_orderkey").alias("study_icid"), F.explode(F.array(F.struct(F.lit(0).alias("v"), F.lit("old").alias("site_id")), F.struct(F.lit(1).alias("v"), C("o_custkey").cast("string").alias("site_id")))).alias("x"))
    path = work_dir(s, "sites")
    rows.select("study_icid", "x.*").repartition("study_icid").sortWithinPartitions("study_icid", "v").drop("v").write.csv(path, header=True)
    return readers.read_site_map(s, path)


# shards


PACKED = f"""s AS (SELECT 'p' || printf('%012d', page_id) AS key, coalesce(html, '') AS html, '{{"page_id":' || page_id || '}}' AS metadata, (row_number() OVER (ORDER BY page_id) - 1) // {SHARD} AS shard_id FROM pages),
    z AS (SELECT *, octet_length(encode(html)) AS size, 512 + (octet_length(encode(html)) + 511) // 512 * 512 AS a, 512 + (octet_length(encode(metadata)) + 511) // 512 * 512 AS b FROM s),
    o AS (SELECT *, coalesce(sum(a + b) OVER (PARTITION BY shard_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 512 AS place FROM z)"""


def packed(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """(folder, report) of the pages as sample shards."""
    folder = work_dir(s, "shards")
    p = table(s, d, "pages").select(F.format_string("p%012d", "page_id").alias("key"), F.coalesce(C("html"), F.lit("")).cast("binary").alias("frames"), F.format_string('{"page_id":%d}', "page_id").alias("metadata"))
    return folder, written(tar.write_shards(p, folder, SHARD), "report")


def number():
    return F.regexp_extract("shard", r"shard-(\d+)\.tar$", 1).cast("long").alias("shard_id")


@query("k02_write_shards", f"WITH {PACKED} SELECT shard_id::BIGINT AS shard_id, count(*) AS n FROM s GROUP BY 1")
def _(s, d):
    return packed(s, d)[1].select("shard_id", "n")


@query("s08_list_shards", f"WITH {PACKED} SELECT shard_id::BIGINT AS shard_id, ((sum(a + b) + 1024 + 10239) // 10240 * 10240)::BIGINT AS length FROM z GROUP BY 1 HAVING ((sum(a + b) + 1024 + 10239) // 10240 * 10240) > 10000")
def _(s, d):
    return readers.list_shards(s, [packed(s, d)[0]]).withColumnRenamed("path", "shard").select(number(), "length")


@query("s09_index_shards", f"WITH {PACKED} SELECT key, shard_id::BIGINT AS shard_id, place::BIGINT AS \"offset\", size::BIGINT AS size, 'npz' AS fmt FROM o")
def _(s, d):
    return tar.index_shards(s, [packed(s, d)[0]]).select("key", number(), "offset", "size", "fmt")


@query("s10_read_samples", f"WITH {PACKED} SELECT key, md5(html) AS frames_md5, 'npz' AS fmt, metadata FROM s")
def _(s, d):
    return tar.read_samples(s, [packed(s, d)[0]]).select("key", F.md5("frames").alias("frames_md5"), "fmt", "metadata")


@query("s11_fetch_payload", f"WITH {PACKED} SELECT key, CASE WHEN shard_id % 2 = 0 THEN md5(html) END AS payload_md5 FROM s")
def _(s, d):
    index = tar.index_shards(s, [packed(s, d)[0]])
    lost = index.withColumn("offset", F.when(index["shard"].rlike(r"[02468]\.tar$"), C("offset")).otherwise(F.lit(1 << 50)))  # ranges outside the file can't be read
    return tar.fetch_payload(lost).select("key", F.md5("payload").alias("payload_md5"))


# sinks


@query("k03_append_progress", "SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'processed' END AS status FROM events UNION ALL SELECT event_id::VARCHAR, 'skipped' FROM events WHERE event_id % 2 = 0")
def _(s, d):
    e, path = table(s, d, "events").select(C("event_id").cast("string").alias("id"), "event_id"), work_dir(s, "progress")
    writers.append_progress(e.withColumn("status", F.when(C("event_id") % 5 == 0, "error").otherwise("processed")), path)
    writers.append_progress(e.where("event_id % 2 = 0").withColumn("status", F.lit("skipped")), path)
    return s.read.parquet(path).where("ts is not null").select("id", "status")


@query("k04_append_report", "SELECT event_type AS task, 'one' AS run_id, round(avg(value), 6) AS mean, NULL::DOUBLE AS top FROM events GROUP BY 1 UNION ALL SELECT event_type, 'two', NULL, max(value) FROM events GROUP BY 1")
def _(s, d):
    by, path = table(s, d, "events").groupBy(C("event_type").alias("task")), work_dir(s, "reports")
    writers.append_report(by.agg(r6(F.avg("value"), "mean")), path, "one")
    writers.append_report(by.agg(F.max("value").alias("top")), path, "two")
    return writers.read_report(s, path).select("task", "run_id", "mean", "top")


@query("k05_write_predictions", "SELECT event_id, value AS score, 'a' AS run_id FROM events UNION ALL SELECT event_id, value * 2, 'b' FROM events")
def _(s, d):
    e, path = table(s, d, "events").select("event_id", C("value").alias("score")), work_dir(s, "predictions")
    writers.write_predictions(e, path, "a")
    writers.write_predictions(e.withColumn("score", C("score") * 2), path, "b")
    return s.read.parquet(path).select("event_id", "score", "run_id")


# streams over files, until nothing new is there


def streamed(s: SparkSession, df: DataFrame, label: str, *more: DataFrame) -> DataFrame:
    """A stream over df, written as files, and further files after it."""
    path = work_dir(s, label)
    for part in (df, *more):
        part.write.mode("append").parquet(path)
    return s.readStream.schema(df.schema).parquet(path)


def drained(s: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """What a stream gives until its sources are read."""
    out = work_dir(s, label)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(df.schema).parquet(out)


@query("t01_resume_stream", "SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'processed' END AS status FROM events")
def _(s, d):
    ids, src = table(s, d, "events").select(C("event_id").cast("string").alias("id")), work_dir(s, "work")
    places = [work_dir(s, x) for x in ("progress", "out", "checkpoint")]
    for part in (ids.where("id % 2 = 0"), ids):  # the second list repeats the first
        part.repartition(2).write.mode("append").parquet(src)
        jobs.resume_stream(s, src, "id string", *places, lambda df: df.withColumn("status", F.when(C("id") % 5 == 0, "error").otherwise("processed")), files_per_batch=2).awaitTermination()
    return s.read.parquet(places[0]).select("id", "status")


@query("t02_index_stream", f"WITH {PACKED} SELECT key, shard_id::BIGINT AS shard_id, place::BIGINT AS \"offset\", size::BIGINT AS size FROM o")
def _(s, d):
    out = work_dir(s, "index")
    jobs.index_stream(s, packed(s, d)[0], out, work_dir(s, "checkpoint")).awaitTermination()
    return s.read.parquet(out).select("key", number(), "offset", "size")


@query("t03_pair_stream", "SELECT event_id::VARCHAR AS key, 'f' || event_id AS frames, CASE WHEN event_id % 3 > 0 THEN 'm' || event_id ELSE '{}' END AS metadata FROM events")
def _(s, d):
    e = table(s, d, "events").select(C("event_id").cast("string").alias("key"), C("ts").cast("timestamp").alias("ts"))
    end = s.range(1).select(F.lit("end").alias("key"), F.lit("2200-01-01").cast("timestamp").alias("ts"))  # later than all, so that what waits is given
    f, m = (t.withColumn(name, F.concat(F.lit(name[0]), "key")) for t, name in ((e, "frames"), (e.where("key % 3 > 0").withColumn("ts", C("ts") + F.expr("interval 2 minutes")), "metadata")))
    last = [end.withColumn(c, F.lit("x")) for c in ("frames", "metadata")]
    pairs = jobs.pair_stream(streamed(s, f, "frames", last[0]), streamed(s, m, "meta", last[1]))
    return drained(s, pairs, "pairs").where("key <> 'end'").select("key", "frames", "metadata")


@query("t04_log_meter", "WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM events) SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least FROM w GROUP BY ALL")
def _(s, d):
    e = table(s, d, "events").select("event_type", "value", C("ts").cast("timestamp").alias("ts"))
    end = s.range(1).select(F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("2200-01-01").cast("timestamp").alias("ts"))  # later than all, so that every window ends
    early, late = (table(s, d, "events").where(f"event_id % 2 = {i}").select(*e.columns[:2], C("ts").cast("timestamp").alias("ts")) for i in (0, 1))
    m = drained(s, jobs.log_meter_stream(streamed(s, early, "log", late, end), "6 hours", value="value", by="event_type", delay="3650 days"), "meter").where("event_type <> 'end'")
    return m.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r6("mean"), r6("least"))


@query("t05_progress", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    e, out = table(s, d, "events").select(C("event_type").alias("status"), "event_id"), work_dir(s, "counts")
    counts = jobs.progress_stream(streamed(s, e.where("event_id % 2 = 0"), "log", e.where("event_id % 2 = 1")))
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", work_dir(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    every = s.read.schema("status string, n long, batch long").parquet(out)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch").select("status", "n")


STATUS = "CASE WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 11 = 0 THEN 'skipped' ELSE 'processed' END"


@query("t05_progress_counters", f"""WITH e AS (SELECT user_id AS worker, ts, event_id, {STATUS} AS status FROM events), c AS (SELECT worker, status, count(*) OVER o AS logged, count(*) FILTER (status = 'processed') OVER o AS processed,
    count(*) FILTER (status = 'skipped') OVER o AS skipped, count(*) FILTER (status = 'error') OVER o AS errors FROM e WINDOW o AS (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT worker, 'counter' AS kind, logged, processed, skipped, errors FROM c WHERE status = 'processed' AND processed % 20 = 0 UNION ALL SELECT worker, 'flush', logged, processed, skipped, errors FROM c WHERE logged % 10 = 0
    UNION ALL SELECT worker, 'idle', max(logged), max(processed), max(skipped), max(errors) FROM c GROUP BY worker""")
def _(s, d):
    e = table(s, d, "events").select(C("user_id").alias("worker"), C("ts").cast("timestamp").alias("ts"), C("event_id").alias("id"), F.expr(STATUS).alias("status"))
    end = s.range(1).select(F.lit(-1).cast("long").alias("worker"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("id"), F.lit("end").alias("status"))
    jobs.with_rocksdb(s)
    counters = jobs.progress_counters(streamed(s, e, "log", end), 20, 10, timedelta(days=3650))
    return drained(s, counters, "counters").where("worker >= 0")


@query("t06_dedup_stream", "SELECT DISTINCT user_id::VARCHAR AS key FROM events")
def _(s, d):
    e = table(s, d, "events").select(C("user_id").cast("string").alias("key"), C("ts").cast("timestamp").alias("ts"))
    return drained(s, jobs.dedup_stream(streamed(s, e, "keys"), delay="3650 days"), "once").select("key")


@query("t07_embed_stream", "SELECT vec_id AS id, round(2 * embedding[1]::DOUBLE, 6) AS first, len(embedding)::INT AS dim FROM embeddings")
def _(s, d):
    e = table(s, d, "embeddings").select(C("vec_id").alias("id"), C("embedding").cast("array<double>").alias("embedding"))
    store = writers.EmbeddingStore(s, work_dir(s, "store"), "id long, embedding array<double>")
    store.upsert(e.where("id % 2 = 0"))  # older vectors, which the stream's replace
    jobs.embed_stream(streamed(s, e, "vectors"), store, lambda df: df.select("id", F.transform("embedding", lambda x: x * 2).alias("embedding")), work_dir(s, "checkpoint")).awaitTermination()
    return store.read().select("id", r6(C("embedding")[0], "first"), F.size("embedding").alias("dim"))


# a caller's own metric


@query("m09_own_metric", f"""WITH {BOOT}, a AS (SELECT replicate, sqrt(avg(x * x)) AS rms FROM w JOIN n USING (row) GROUP BY replicate)
    SELECT 'rms' AS metric, (SELECT round(sqrt(avg(x * x)), 6) FROM n) AS value, round(quantile_cont(rms, 0.025), 6) AS lower, round(quantile_cont(rms, 0.975), 6) AS upper FROM a""")
def _(s, d):
    def rms(df: DataFrame, by: list[str], weight: str | None) -> DataFrame:
        w = C(weight) if weight else F.lit(1)
        return df.groupBy(*by).agg(F.sqrt(F.sum(w * C("x") * C("x")) / F.sum(w)).alias("rms"))

    data = numbered(s, d)
    return metrics.bootstrap_ci(data, rms, ["rms"], weights=written(metrics.draws(data, 200, 42), "draws")).select("metric", r6("value"), r6("lower"), r6("upper"))


@query("m09_python_metric", f"""WITH {BOOT}, a AS (SELECT replicate, quantile_disc(x, 0.5) AS med FROM w JOIN n USING (row) GROUP BY replicate)
    SELECT 'median' AS metric, (SELECT round(quantile_disc(x, 0.5), 6) FROM n) AS value, round(quantile_cont(med, 0.025), 6) AS lower, round(quantile_cont(med, 0.975), 6) AS upper FROM a""")
def _(s, d):
    data = numbered(s, d)
    median = bootstrap.python_metric(bootstrap.weighted_median, ["x"], "median")
    return metrics.bootstrap_ci(data, median, ["median"], weights=written(metrics.draws(data, 200, 42), "draws")).select("metric", r6("value"), r6("lower"), r6("upper"))
