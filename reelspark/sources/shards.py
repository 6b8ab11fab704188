"""Sample shards as a Spark data source (S9, S10, K2): tar files of `key.frames.npy|npz` and `key.metadata.json` members.

    register(spark)
    spark.read.format("sample_shards").option("content", "index").load(folder).where("key = 'a'")
    df.write.format("sample_shards").mode("append").save(folder)

A partition is a run of shards of about TASK_BYTES. Tasks read headers and seek over payloads; filters on key, fmt and shard are pushed, so that payloads of
other samples are never read, and those of the right ones once. Files are opened by pyarrow's file systems, so a path may be local or in any store that those know.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

#: The members' suffixes.
SUFFIXES = (".frames.npy", ".frames.npz", ".metadata.json")
TASK_BYTES = 64_000_000
BATCH_BYTES = 8_000_000
INDEX = "key string, shard string, offset long, size long, fmt string"
SAMPLES = "shard string, key string, frames binary, fmt string, metadata string"
TYPES = {"offset": pa.int64(), "size": pa.int64(), "frames": pa.binary()}


def split_name(name: str) -> tuple[str, str] | None:
    base = name.rsplit("/", 1)[-1]
    return next(((base[: -len(s)], s.rsplit(".", 1)[-1]) for s in SUFFIXES if base.endswith(s) and len(base) > len(s)), None)


def opened(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def headers(f, on_error: str = "skip") -> list[tuple[str, str, int, int, int]]:
    """(key, fmt, offset, size, place) of an open shard's sample members. A broken shard ends where it breaks ('skip') or fails ('fail')."""
    rows = []
    try:
        with tarfile.open(fileobj=f, mode="r:") as tar:
            for i, m in enumerate(tar):
                if m.isfile() and (k := split_name(m.name)):
                    rows.append((*k, m.offset_data, m.size, i))
    except (tarfile.TarError, EOFError):  # not OSError: a store that can't be reached is no broken shard
        if on_error == "fail":
            raise
    return rows


def payload(f, offset: int, size: int) -> bytes | None:
    """The bytes of a range, null if the file ends before it does. A store that can't be read is an error."""
    if offset < 0 or offset + size > f.size():
        return None
    f.seek(offset)
    return f.read(size)


def listed(folder: str, glob: str = "shard-*.tar") -> list[tuple[str, int]]:
    """(uri, bytes) of a folder's shards, none if there is no folder."""
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    prefix = folder.rstrip("/").removesuffix(root.rstrip("/"))
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, glob))


def as_text_json(data: bytes | None) -> str:
    """A metadata member's text, '{}' if there is none or it isn't JSON."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        text = (data or b"").decode()
        json.loads(text, parse_constant=refuse)
        return text
    except ValueError:
        return "{}"


@dataclass
class Run(InputPartition):
    shards: list[str]


class ShardReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.names = schema.names
        self.index = options.get("content", "samples") == "index"
        self.folders = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.glob, self.on_error = options.get("glob", "shard-*.tar"), options.get("onError", "skip")
        self.min_bytes, self.task_bytes = int(options.get("minBytes", 0)), int(options.get("taskBytes", TASK_BYTES))
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in ("key", "fmt", "shard"):
                yield f
            elif isinstance(f, EqualTo):
                self.pushed.append((column, "in", frozenset([f.value])))
            elif isinstance(f, In):
                self.pushed.append((column, "in", frozenset(f.value)))
            elif isinstance(f, StringStartsWith):
                self.pushed.append((column, "starts", f.value))
            elif not isinstance(f, IsNotNull):  # these columns are never null
                yield f

    def wanted(self, **values: str) -> bool:
        return all(c not in values or (values[c] in v if kind == "in" else values[c].startswith(v)) for c, kind, v in self.pushed)

    def partitions(self) -> list[Run]:
        runs, size = [], 0
        for uri, n in sorted(x for folder in self.folders for x in listed(folder, self.glob)):
            if n > self.min_bytes and self.wanted(shard=uri):
                if not runs or size + n > self.task_bytes:
                    runs.append(Run([]))
                    size = 0
                runs[-1].shards.append(uri)
                size += n
        return runs or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for uri in partition.shards:
            for row in self.entries(uri) if self.index else self.samples(uri):
                rows.append([row[n] for n in self.names])
                size += 200 + len(row.get("frames") or b"")
                if size > BATCH_BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, TYPES.get(n, pa.string())) for n, c in zip(self.names, zip(*rows, strict=True), strict=True)], self.names)

    def entries(self, uri: str) -> Iterator[dict]:
        with opened(uri) as f:
            found = headers(f, self.on_error)
        for key, fmt, offset, size, _ in found:
            if fmt != "json" and self.wanted(key=key, fmt=fmt):
                yield {"key": key, "shard": uri, "offset": offset, "size": size, "fmt": fmt}

    def samples(self, uri: str) -> Iterator[dict]:
        """Of members of one name the last one counts; metadata alone is left out."""
        with opened(uri) as f:
            frames, metadata = {}, {}
            for key, fmt, offset, size, _ in headers(f, self.on_error):
                (metadata if fmt == "json" else frames)[key] = (fmt, offset, size)
            for key, (fmt, offset, size) in sorted(frames.items(), key=lambda x: x[1][1]):
                if self.wanted(key=key, fmt=fmt):
                    row = {"shard": uri, "key": key, "fmt": fmt}
                    if "frames" in self.names:
                        row["frames"] = payload(f, offset, size)
                    if "metadata" in self.names:
                        row["metadata"] = as_text_json(payload(f, *metadata[key][1:]) if key in metadata else None)
                    yield row


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # (staged path, final name)


class ShardWriter(DataSourceArrowWriter):
    """Rows (shard_id, key, frames, metadata), a shard's rows in one partition and next to each other. A task streams samples into files of a folder of its own attempt, which the commit
    moves to their names; a file that is there is never replaced, but for mode `overwrite`, which deletes the folder's other shards."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.prefix, self.overwrite = options["path"].rstrip("/"), options.get("prefix", "shard"), overwrite
        self.job = uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.folder)
        return store, root, f"{root}/.staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, _, staging = self._staging()
        own = f"{staging}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        files, number, out, tar = [], None, None, None
        try:
            for batch in iterator:
                cols = [batch.column(batch.schema.get_field_index(c)) for c in ("shard_id", "key", "frames", "metadata")]
                for i in range(len(batch)):
                    shard, key, frames, metadata = (c[i].as_py() for c in cols)
                    if shard != number:
                        if tar:
                            tar.close()
                            out.close()
                        number, name = shard, f"{self.prefix}-{shard:06d}.tar"
                        files.append((f"{own}/{name}", name))
                        out = store.open_output_stream(files[-1][0])
                        tar = tarfile.open(fileobj=out, mode="w|")
                    for suffix, data in ((".frames.npz", frames or b""), (".metadata.json", (metadata or "{}").encode())):
                        info = tarfile.TarInfo(f"{key}{suffix}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
            if tar:
                tar.close()
                out.close()
        except BaseException:
            with suppress(OSError, ValueError):  # the file goes
                if tar:
                    tar.close()
                    out.close()
            store.delete_dir(own)
            raise
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root, staging = self._staging()
        files = [x for m in messages if m for x in m.files]
        names = [name for _, name in files]
        there = {uri.rsplit("/", 1)[-1] for uri, _ in listed(self.folder, f"{self.prefix}-*.tar")}
        if len(set(names)) < len(names) or (not self.overwrite and there & set(names)):
            raise FileExistsError(f"shards written twice, or there already: {sorted(there & set(names))[:3]}")
        for name in there if self.overwrite else ():
            store.delete_file(f"{root}/{name}")
        for path, name in files:
            store.move(path, f"{root}/{name}")
        store.delete_dir(staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class SampleShards(DataSource):
    """Options: path (or paths, a JSON list), content (samples or index), glob, minBytes (shards of no more are left out), onError (skip or fail), taskBytes; prefix for writing.
    With a schema of fewer columns, what isn't asked for isn't read."""

    @classmethod
    def name(cls) -> str:
        return "sample_shards"

    def schema(self) -> str:
        return INDEX if self.options.get("content", "samples") == "index" else SAMPLES

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SampleShards)
