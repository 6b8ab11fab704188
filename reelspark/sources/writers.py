"""Sinks (K1, K3 to K6)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def label_lines(df: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """One column: `id label`, six decimals for fractions, none for whole-number types. K1."""
    whole = dict(df.dtypes)[label] in ("int", "bigint", "smallint", "tinyint", "string")
    text = F.concat_ws(" ", F.col(key).cast("string"), F.col(label).cast("string") if whole else F.format_string("%.6f", F.col(label).cast("double")))
    return df.withColumn("value", text)


def write_label_list(df: DataFrame, path: str, partitions: tuple[str, ...] = ("task", "split"), key: str = "id", label: str = "label") -> None:
    """K1."""
    label_lines(df, key, label).select(*partitions, "value").write.partitionBy(*partitions).mode("overwrite").text(path)


def append_progress(df: DataFrame, path: str) -> None:
    """Appends (id, status, ts). K3."""
    df.select("id", "status", F.coalesce(F.col("ts"), F.current_timestamp()).alias("ts") if "ts" in df.columns else F.current_timestamp().alias("ts")).write.mode("append").parquet(path)


def append_report(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Appends rows with their own columns and a run id. K4."""
    df.withColumn("run_id", F.lit(run_id or uuid.uuid4().hex)).write.mode("append").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """All appended rows, columns united by name. K4."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_predictions(df: DataFrame, path: str, run_id: str) -> None:
    """One folder a run; a run that is there is an error. K5."""
    df.write.mode("errorifexists").parquet(f"{path}/run_id={run_id}")


def upsert_embeddings(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows, and the old ones of other keys. K6."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class EmbeddingStore:
    """A table in hash buckets of its key and in versions. K6.

    A version is a manifest: for each bucket the folder that holds it. An upsert writes new folders for the buckets that its keys fall into, and then publishes the next manifest
    by creating its file, which fails if another writer came first; the upsert is then made again on that one's version. A manifest cut short by a lost
    writer counts for nothing. Readers see whole versions; folders of the newest version and the one before are kept."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "id string, embedding array<float>", key: str = "id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._p(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _manifest(self, name: str) -> dict | None:
        p = self._p(f"{self.path}/versions/{name}")
        f = self._fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode())
        except ValueError:  # its writer was lost, or is at it
            return None
        finally:
            f.close()

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and self._manifest(n)]

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        known = self.versions()
        number = version if version is not None else max(known, default=-1)
        return number, self._manifest(f"{number:012d}.json") if number >= 0 else {"buckets": self.buckets, "folders": {}}

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or the one asked for."""
        return self._read(sorted(self._state(version)[1]["folders"].values()))

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Folders by bucket of bucketed rows."""
        name = uuid.uuid4().hex
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        return {n.split("=")[1]: f"{name}/{n}" for n in self._names(f"data/{name}") if n.startswith("__bucket=")}

    def _published(self, number: int, state: dict) -> bool:
        p = self._p(f"{self.path}/versions/{number:012d}.json")
        self._fs.mkdirs(p.getParent())
        try:
            out = self._fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return True

    def _next(self) -> int:
        """Behind all manifests, those cut short included."""
        return max((int(n[:-5]) for n in self._names("versions") if n.endswith(".json")), default=-1) + 1

    def upsert(self, new: DataFrame) -> None:
        """New rows replace those of their keys. Repeating an upsert changes nothing."""
        for _ in range(10):
            number, (old_number, state) = self._next(), self._state()
            rows = self._bucketed(new, state["buckets"])
            written = self._write(rows)  # computed once: its folders tell the buckets
            if not written:
                return
            there = [state["folders"][b] for b in written if b in state["folders"]]
            folders = written
            if there:
                fresh = self._read(list(written.values()))
                folders = self._write(self._bucketed(upsert_embeddings(self._read(there), fresh, self.key), state["buckets"]))
                self._fs.delete(self._p(f"{self.path}/data/{next(iter(written.values())).split('/')[0]}"), True)
            if self._published(number, {"buckets": state["buckets"], "folders": state["folders"] | folders}):
                self.vacuum()
                return
            self._fs.delete(self._p(f"{self.path}/data/{next(iter(folders.values())).split('/')[0]}"), True)
        raise RuntimeError("ten other writers came first")

    def rebucket(self, buckets: int) -> None:
        """A version in another number of buckets, for a table that has grown."""
        number = self._next()
        if not self._published(number, {"buckets": buckets, "folders": self._write(self._bucketed(self.read(), buckets))}):
            raise RuntimeError("another writer came first")
        self.vacuum()

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what only versions before the last `keep` need. Folders that no version names yet may be a writer's own and stay until a later version exists for them."""
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        used = {f for v in kept for f in self._manifest(f"{v:012d}.json")["folders"].values()}
        for v in old:
            for f in set(self._manifest(f"{v:012d}.json")["folders"].values()) - used:
                self._fs.delete(self._p(f"{self.path}/data/{f}"), True)
            self._fs.delete(self._p(f"{self.path}/versions/{v:012d}.json"), False)
