"""The sample shards as a data source: pushed filters, bytes read once, commits and lost attempts."""

import json
import os
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith
from pyspark.sql.types import StructType

from reelspark.sources import shards, tar


def samples(spark, n, size=0):
    frames = F.concat(F.lit("frames-"), "id", F.lit("x" * size)).cast("binary")
    return spark.range(n).select(F.format_string("k%03d", "id").alias("key"), frames.alias("frames"), F.format_string('{"i": %d}', "id").alias("metadata"))


def schema(ddl):
    return StructType.fromDDL(ddl)


class Counted:
    """An open file that adds up what is read of it."""

    def __init__(self, f, got):
        self.f, self.got = f, got

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read(self, n=-1):
        out = self.f.read(n)
        self.got.append(len(out))
        return out

    def __getattr__(self, name):
        return getattr(self.f, name)


def test_filters_are_pushed(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    tar.write_shards(samples(spark, 30), root, 10)
    one = tar.read_samples(spark, [root]).where("key = 'k011' AND fmt = 'npz'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")
    assert [bytes(r.frames) for r in one.collect()] == [b"frames-11"]
    index = tar.index_shards(spark, [root])
    assert index.where("key LIKE 'k00%'").count() == 10 and index.where("key IN ('k001', 'k029') AND offset >= 0").count() == 2
    assert index.where(F.col("shard").endswith("-000002.tar")).count() == 10


def test_bytes_are_read_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/shards"
    tar.write_shards(samples(spark, 20, 5000), root, 10)
    got, real = [], shards.opened
    monkeypatch.setattr(shards, "opened", lambda uri: Counted(real(uri), got))

    def read(filters=(), ddl=shards.SAMPLES, **options):
        got.clear()
        r = shards.ShardReader({"path": root} | options, schema(ddl))
        assert list(r.pushFilters(list(filters))) == []
        return [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()], sum(n for n in got if n not in (1, 512))  # a header has 512, and one byte tells that a member ends

    every, n = read()
    assert len(every) == 20 and n == sum(len(x["frames"]) + len(x["metadata"]) for x in every)
    some, n = read([StringStartsWith(("key",), "k01"), EqualTo(("fmt",), "npz")])
    assert len(some) == 10 and n == sum(len(x["frames"]) + len(x["metadata"]) for x in some)
    none, n = read(ddl="key string, metadata string")
    assert len(none) == 20 and n == sum(len(x["metadata"]) for x in none)
    index, n = read(ddl=shards.INDEX, content="index")
    assert len(index) == 20 and n == 0
    got.clear()
    assert read([EqualTo(("shard",), f"{root}/shard-000001.tar")])[0] == every[10:]


def test_partitions_by_bytes(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    tar.write_shards(samples(spark, 60, 5000), root, 10)
    count = lambda **o: [len(p.shards) for p in shards.ShardReader({"path": root} | o, schema(shards.INDEX)).partitions()]
    assert count() == [6] and count(taskBytes="150000") == [2, 2, 2] and count(taskBytes="1") == [1] * 6 and count(minBytes="1000000000") == [0]
    assert shards.ShardReader({"path": f"file://{tmp_path}/none"}, schema(shards.INDEX)).partitions()[0].shards == []


def batches(n, shard=0, fail_at=None):
    for i in range(n):
        if i == fail_at:
            raise RuntimeError("lost")
        yield pa.RecordBatch.from_pydict({"key": [f"k{i}"], "frames": [b"F%d" % i], "metadata": [None if i % 2 else json.dumps({"i": i})], "shard_id": [shard + i // 4]})


def test_lost_attempts_leave_nothing(tmp_path):
    root = f"file://{tmp_path}/shards"
    w = shards.ShardWriter({"path": root}, False)
    with pytest.raises(RuntimeError, match="lost"):
        w.write(batches(10, fail_at=7))
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []
    # two attempts of a task at once, of which one counts, and another task
    slow, first, other = w.write(batches(10)), w.write(batches(10)), w.write(batches(3, shard=7))
    assert not any(f.endswith(".tar") for f in os.listdir(tmp_path / "shards"))
    w.commit([first, other, None])
    assert sorted(os.listdir(tmp_path / "shards")) == [f"shard-{i:06d}.tar" for i in (0, 1, 2, 7)] and slow.files != first.files
    with tarfile.open(tmp_path / "shards" / "shard-000001.tar") as t:
        assert [(m.name, t.extractfile(m).read()) for m in t][:3] == [("k4.frames.npz", b"F4"), ("k4.metadata.json", b'{"i": 4}'), ("k5.frames.npz", b"F5")]
    again = shards.ShardWriter({"path": root}, False)
    with pytest.raises(FileExistsError):
        again.commit([again.write(batches(3, shard=7))])
    again.abort([])
    assert len(os.listdir(tmp_path / "shards")) == 4
    over = shards.ShardWriter({"path": root}, True)
    over.commit([over.write(batches(3, shard=9))])
    assert os.listdir(tmp_path / "shards") == ["shard-000009.tar"]


def test_failed_jobs_leave_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    bad = samples(spark, 30).withColumn("shard_id", (F.regexp_extract("key", "\\d+", 0).cast("long") / 10).cast("long"))
    bad = bad.withColumn("frames", F.when(F.col("key") == "k025", F.raise_error(F.lit("lost"))).otherwise(F.col("frames")))
    shards.register(spark)
    with pytest.raises(Exception, match="lost"):
        bad.repartition(3, "shard_id").sortWithinPartitions("shard_id").write.format("sample_shards").mode("append").save(root)
    assert not (tmp_path / "shards").exists() or os.listdir(tmp_path / "shards") == []


def test_a_lost_store_is_an_error(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    tar.write_shards(samples(spark, 4), root, 2)
    index = tar.index_shards(spark, [root])
    outside = index.withColumn("offset", F.col("offset") + (1 << 40))
    assert [r.payload for r in tar.fetch_payload(outside).collect()] == [None] * 4
    lost = index.withColumn("shard", F.when(F.col("key") == "k000", F.lit(f"file://{tmp_path}/gone.tar")).otherwise(F.col("shard")))
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        tar.fetch_payload(lost).collect()
    told = {r.key: r for r in tar.fetch_payload(lost, "tell").collect()}
    assert told["k000"].payload is None and "gone.tar" in told["k000"].payload_error and bytes(told["k003"].payload) == b"frames-3" and told["k003"].payload_error is None


def test_streamed_samples_are_never_held(tmp_path):
    """A shard of many samples: what a task holds of it is one batch."""

    live = []

    def one_by_one():
        for i in range(200):
            live.append(i)
            yield pa.RecordBatch.from_pydict({"key": [f"k{i:03d}"], "frames": [bytes(100_000)], "metadata": ["{}"], "shard_id": [0]})
            size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path) for f in files)
            assert size > (i - 1) * 100_000 - 64 * 10240  # what came before stands in the file

    w = shards.ShardWriter({"path": f"file://{tmp_path}/s"}, False)
    w.commit([w.write(one_by_one())])
    assert len(live) == 200 and os.path.getsize(tmp_path / "s" / "shard-000000.tar") > 20_000_000
