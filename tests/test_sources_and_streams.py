"""Files, shards and streams: round trips, and stream = batch."""

import io
import json
import tarfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reelspark.sources import readers, tar, writers
from reelspark.streaming import jobs


def put(path, text):
    path.write_text(text)
    return str(path)


def test_label_lists(spark, tmp_path):
    p = put(tmp_path / "a.csv", "x 1\n\n y  2.5 \nx 3\n")
    assert {r.id: r.label for r in readers.read_label_list(spark, p).collect()} == {"x": 3.0, "y": 2.5}
    q = put(tmp_path / "b.csv", "x 1\nbroken line here\nz\n")
    assert {r.id for r in readers.read_label_list(spark, q, "lenient").collect()} == {"x"}
    assert {r.id for r in readers.read_label_list(spark, q, "ids").collect()} == {"x", "broken", "z"}
    with pytest.raises(Exception, match="not `id label`"):
        readers.read_label_list(spark, q).collect()
    assert {r.id for r in readers.read_id_list(spark, put(tmp_path / "c", " a\n\nb\na\n")).collect()} == {"a", "b"}
    assert {tuple(r) for r in readers.read_site_map(spark, put(tmp_path / "d.csv", "study_icid,site_id\n1,a\n2,b\n1,c\n")).collect()} == {("1", "c"), ("2", "b")}


def test_annotations(spark, tmp_path):
    doc = {"dicoms": [{"dicom_uuid": "a", "type": "Standard"}, {"dicom_uuid": "a", "type": "Other"}, {"dicom_uuid": "b"}],
           "studies": [{"study_uuid": "s", "conditions": ["x", {"y": 1}], "bmi": 21.5, "conclusions": "fine", "extra": 1}, {"study_uuid": "s", "bmi": 3}]}
    items, studies = readers.read_annotations(spark, put(tmp_path / "a.json", json.dumps(doc, indent=1)))
    assert {r.dicom_uuid: r.dicom_type for r in items.collect()} == {"a": "Standard", "b": None}
    s = studies.collect()
    assert len(s) == 1 and s[0].bmi == "21.5" and s[0].conclusions == "fine" and json.loads(s[0].conditions) == ["x", {"y": 1}] and s[0].height is None


def test_tables(spark, tmp_path):
    m = readers.read_manifest(spark, put(tmp_path / "m.csv", "dicom_uuid,study_uuid,disk_path,view,type,n_frames,physical_delta_x\n007,1,/x,nan,Standard,12,0.03\n"))
    assert m.first().dicom_uuid == "007" and m.first().view is None and m.first().n_frames == 12.0
    log = readers.read_train_log(spark, put(tmp_path / "l.csv", "epoch,itr,loss,a,b,c\n1,0,0.5,1,2,3\nepoch,itr,loss,a,b,c\n2,1,0.25,1,2,3\n"))
    assert [(r.epoch, r.loss) for r in log.collect()] == [(1, 0.5), (2, 0.25)]
    p = readers.read_predictions(spark, put(tmp_path / "p.csv", 'id,y_true,y_prob\na,1,"[0.1, 2.0]"\nb,0,0.75\n')).collect()
    assert p[0].logits == [0.1, 2.0] and p[1].score == 0.75 and p[1].pred == 1.0
    t = readers.read_task_labels(spark, put(tmp_path / "t.csv", "study_id,label,study designation\n1,x,train\n2,,test\n"))
    assert [(r.study_id, r.split) for r in t.collect()] == [("1", "TRAIN")]
    assert readers.load_dataset(spark, "Train_LOG", path=str(tmp_path / "l.csv")).count() == 2
    with pytest.raises(ValueError, match="unknown dataset"):
        readers.load_dataset(spark, "nothing")


def samples(spark, n):
    return spark.range(n).select(F.format_string("k%03d", "id").alias("key"), F.concat(F.lit("frames-"), "id").cast("binary").alias("frames"), F.format_string('{"i": %d}', "id").alias("metadata"))


def test_shard_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    assert sorted(r.n for r in tar.write_shards(samples(spark, 25), root, 10).collect()) == [5, 10, 10]
    again = tar.write_shards(samples(spark, 3).withColumn("key", F.concat(F.lit("new"), "key")), root, 10).collect()
    assert [r.shard_id for r in again] == [3]
    got = tar.read_samples(spark, [root]).collect()
    assert len(got) == 28
    assert {(r.key, bytes(r.frames).decode(), json.loads(r.metadata)["i"]) for r in got if r.key[0] == "k"} == {(f"k{i:03d}", f"frames-{i}", i) for i in range(25)}
    index = tar.index_shards(spark, [root])
    assert index.count() == 28 and {r.fmt for r in index.collect()} == {"npz"}
    lost = index.limit(1).withColumn("size", F.lit(1 << 40))
    assert tar.fetch_payload(lost).first().payload is None
    assert readers.list_shards(spark, [root], 10_000).count() + readers.list_shards(spark, [root], 10**9).count() == 4


def test_odd_shards(spark, tmp_path):
    def add(t, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))

    with tarfile.open(tmp_path / "shard-000000.tar", "w") as t:
        add(t, "d/a.frames.npy", b"A")
        add(t, "b.metadata.json", b"{}")
        add(t, "c.frames.npz", b"C" * 2000)
        add(t, "c.metadata.json", b"not json")
        add(t, "notes.txt", b"x")
    raw = (tmp_path / "shard-000000.tar").read_bytes()
    (tmp_path / "shard-000001.tar").write_bytes(raw[:700])
    (tmp_path / "shard-000002.tar").write_bytes(b"no tar at all" * 100)
    got = {(r.shard[-5], r.key, r.metadata) for r in tar.read_samples(spark, [f"file://{tmp_path}"]).collect()}
    assert {(k, m) for s, k, m in got if s == "0"} == {("a", "{}"), ("c", "{}")} and not any(s == "2" for s, _, _ in got)
    with pytest.raises(Exception, match="ReadError|truncated|bad"):
        tar.members(spark.createDataFrame([(f"file://{tmp_path}/shard-000002.tar",)], "path string"), "fail").collect()


def test_sinks(spark, tmp_path):
    p = f"{tmp_path}/labels"
    writers.write_label_list(spark.createDataFrame([("a", 0.5, "t", "val")], "id string, label double, task string, split string"), p)
    assert [r.value for r in spark.read.text(f"{p}/task=t/split=val").collect()] == ["a 0.500000"]
    r = f"{tmp_path}/report"
    writers.append_report(spark.createDataFrame([(1.0,)], "auc double"), r)
    writers.append_report(spark.createDataFrame([(2.0,)], "mae double"), r, "two")
    assert {(x.auc, x.mae) for x in writers.read_report(spark, r).collect()} == {(1.0, None), (None, 2.0)}
    writers.write_predictions(spark.range(2), f"{tmp_path}/pred", "one")
    with pytest.raises(Exception, match="already exists"):
        writers.write_predictions(spark.range(2), f"{tmp_path}/pred", "one")
    store = writers.EmbeddingStore(spark, f"file://{tmp_path}/store", "id long, embedding array<double>")
    for v in (1.0, 2.0):
        store.upsert(spark.range(3 if v == 1.0 else 1).select("id", F.array(F.lit(v)).alias("embedding")))
    assert {r.id: r.embedding for r in store.read().collect()} == {0: [2.0], 1: [1.0], 2: [1.0]}
    done = f"{tmp_path}/progress"
    writers.append_progress(spark.createDataFrame([("a", "processed")], "id string, status string"), done)
    assert spark.read.parquet(done).columns == ["id", "status", "ts"]


T0 = datetime(2024, 1, 1)


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_store_rewrites_touched_buckets(spark, tmp_path):
    store = writers.EmbeddingStore(spark, f"file://{tmp_path}/store", "id long, embedding array<double>", buckets=16)
    rows = lambda n, v: spark.range(n).select("id", F.array(F.lit(v)).alias("embedding"))
    assert store.read().count() == 0 and store.versions() == []
    store.upsert(rows(400, 1.0))
    before = files(tmp_path / "store")
    assert len(before) == 16
    earlier = store.read()
    store.upsert(rows(1, 2.0))
    after = files(tmp_path / "store")
    assert all(after[p] == t for p, t in before.items()) and len(after) == 17  # one bucket is new, all others stand as they were
    value = lambda df: {r.id: r.embedding[0] for r in df.collect()}
    assert value(store.read()) == {i: 2.0 if i == 0 else 1.0 for i in range(400)}
    assert value(earlier) == value(store.read(0)) == dict.fromkeys(range(400), 1.0)  # the version that it was opened on
    store.upsert(rows(0, 3.0))
    assert store.versions() == [0, 1]
    store.upsert(rows(1, 2.0))
    assert store.versions() == [1, 2] and len(files(tmp_path / "store")) == 17 and value(store.read())[0] == 2.0
    store.rebucket(4)
    assert len(value(store.read())) == 400 and len(store.read().inputFiles()) == 4


def test_store_writers_at_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/store", "id long, embedding array<double>"
    one, two = (writers.EmbeddingStore(spark, path, schema, buckets=4) for _ in range(2))
    rows = lambda i: spark.createDataFrame([(i, [float(i)])], schema)
    one.upsert(rows(1))
    real, raced = one._published, []

    def late(number, state):
        if not raced:
            raced.append(number)
            two.upsert(rows(2))  # comes first
        return real(number, state)

    one._published = late
    one.upsert(rows(3))
    assert raced == [1] and one.versions()[-1] == 2 and {r.id for r in two.read().collect()} == {1, 2, 3}
    (tmp_path / "store" / "versions" / "000000000003.json").write_text('{"buckets": 4, "fol')  # a writer was lost
    one.upsert(rows(4))
    assert two.versions()[-1] == 4 and {r.id for r in two.read().collect()} == {1, 2, 3, 4}


def test_resume(spark, tmp_path):
    src, args = f"{tmp_path}/src", (f"{tmp_path}/progress", f"{tmp_path}/out", f"{tmp_path}/cp")
    work = lambda df: df.withColumn("status", F.when(F.col("id") == "bad", "error").otherwise("processed"))
    for ids in (["a", "bad"], ["a", "b", "bad", "b"]):
        spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(src)
        jobs.resume_stream(spark, src, "id string", *args, work).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(args[1]).collect()) == ["a", "b", "bad"]


def test_index_stream(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    for n, prefix in ((3, ""), (2, "z")):
        tar.write_shards(samples(spark, n).withColumn("key", F.concat(F.lit(prefix), "key")), root, 10).collect()
        jobs.index_stream(spark, root, f"{tmp_path}/index", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/index").select("key", "shard", "offset", "size", "fmt")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tar.index_shards(spark, [root]).collect()))


def memory(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def stream_of(spark, tmp_path, name, rows, schema, files=3):
    df = spark.createDataFrame(rows, schema)
    for i in range(files):
        df.where(F.pmod(F.hash(*df.columns), F.lit(files)) == i if name != "ordered" else F.lit(True)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"), df


def test_pairing(spark, tmp_path):
    f = spark.createDataFrame([(f"k{i}", T0 + timedelta(minutes=i), f"f{i}") for i in range(4)] + [("late", T0 + timedelta(hours=9), "x")], "key string, ts timestamp, frames string")
    m = spark.createDataFrame([(f"k{i}", T0 + timedelta(minutes=i + 2), f"m{i}") for i in (0, 2)] + [("end", T0 + timedelta(hours=9), "x")], "key string, ts timestamp, metadata string")
    f.coalesce(1).write.parquet(f"{tmp_path}/f")
    m.coalesce(1).write.parquet(f"{tmp_path}/m")
    pairs = jobs.pair_stream(spark.readStream.schema(f.schema).parquet(f"{tmp_path}/f"), spark.readStream.schema(m.schema).parquet(f"{tmp_path}/m"))
    got = {r.key: r.metadata for r in memory(spark, pairs, "paired").collect()}
    assert got["k0"] == "m0" and got["k2"] == "m2" and got.get("k1", "{}") == "{}" and got.get("k3", "{}") == "{}"


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_meter_stream_is_batch(spark, tmp_path, slide):
    rows = [(T0 + timedelta(minutes=7 * i), float(i % 5), "ab"[i % 2]) for i in range(60)]
    stream, batch = stream_of(spark, tmp_path, "log", rows, "ts timestamp, loss double, kind string", 1)
    name = f"meter{'_s' if slide else ''}"
    got = {tuple(r) for r in memory(spark, jobs.log_meter_stream(stream, "1 hour", slide, "0 seconds", by="kind"), name).collect()}
    want = {tuple(r) for r in jobs.log_meter(batch, "1 hour", slide, by="kind").collect()}
    last = max(r[0] for r in rows)
    assert got and got <= want and {w for w in want if w[1] <= last - timedelta(hours=1)} <= got


def test_progress_and_dedup(spark, tmp_path):
    rows = [(f"k{i % 5}", T0 + timedelta(seconds=i), "ok" if i % 3 else "error") for i in range(30)]
    stream, batch = stream_of(spark, tmp_path, "p", rows, "key string, ts timestamp, status string")
    got = {r.status: r.n for r in memory(spark, jobs.progress_stream(stream), "counts", "complete").collect()}
    assert got == {r.status: r.n for r in jobs.progress_stream(batch).collect()}
    assert sorted(r.key for r in memory(spark, jobs.dedup_stream(stream), "once").collect()) == [f"k{i}" for i in range(5)]


def test_embed_stream(spark, tmp_path):
    stream, _ = stream_of(spark, tmp_path, "e", [(i,) for i in range(6)], "id long", 2)
    store = writers.EmbeddingStore(spark, f"file://{tmp_path}/store", "id long, embedding array<double>")
    jobs.embed_stream(stream, store, lambda df: df.select("id", F.array(F.col("id") * 1.0).alias("embedding")), f"{tmp_path}/cp").awaitTermination()
    assert {r.id: r.embedding for r in store.read().collect()} == {i: [float(i)] for i in range(6)}


def test_counters_go_on_after_a_restart(spark, tmp_path):
    """Rows in two lists, the stream ended and started again between them: counters as of one pass over all."""
    jobs.with_rocksdb(spark)
    log = [(f"w{i % 3}", T0 + timedelta(seconds=i), i, ("processed", "skipped", "error")[(i % 7 > 4) + (i % 7 > 5)]) for i in range(200)]
    schema = "worker string, ts timestamp, id long, status string"
    src, out = f"{tmp_path}/log", f"{tmp_path}/counters"
    for part in (log[:77], log[77:], [("end", T0 + timedelta(days=9), -1, "end")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        stream = jobs.progress_counters(spark.readStream.schema(schema).parquet(src), 10, 5, timedelta(hours=1))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = []
    for w in ("w0", "w1", "w2"):
        n = {"processed": 0, "skipped": 0, "error": 0}
        for logged, (_, _, _, status) in enumerate((r for r in log if r[0] == w), 1):
            n[status] += 1
            row = (w, logged, n["processed"], n["skipped"], n["error"])
            want += [(row[0], kind, *row[1:]) for kind, due in (("counter", status == "processed" and n["processed"] % 10 == 0), ("flush", logged % 5 == 0)) if due]
        want.append((row[0], "idle", *row[1:]))
    got = [tuple(r) for r in spark.read.parquet(out).where("worker <> 'end'").collect()]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_counters_take_rows():
    """A worker's rows are counted as rows: no frame is built for a worker. A row without a time comes last and sets no timer."""
    from types import SimpleNamespace

    from pyspark.sql import Row
    from reelspark.streaming import jobs

    kept, timers = [], []
    counters = jobs._Counters(2, 3, 1000)
    counters.counts = SimpleNamespace(get=lambda: kept[-1] if kept else None, update=kept.append)
    counters.handle = SimpleNamespace(registerTimer=timers.append, deleteTimer=timers.remove)
    rows = [Row(us=us, id=i, status=s) for us, i, s in ((None, 1, "processed"), (5_000, 3, "error"), (5_000, 2, "processed"), (9_000, 4, "skipped"))]
    assert [tuple(r) for r in counters.handleInputRows((7,), iter(rows), None)] == [(7, "flush", 3, 1, 1, 1), (7, "counter", 4, 2, 1, 1)]
    assert kept[-1] == (4, 2, 1, 1, 1009) and timers == [1009]
    assert [tuple(r) for r in counters.handleInputRows((7,), iter([Row(us=None, id=5, status="error")]), None)] == [] and timers == [1009]
