"""Records of one huge JSON document, read in parallel.

A document is an object of arrays of objects. It is cut into byte ranges. A first pass tells for each range, whether it begins inside a string or not, how its quotes and brackets change
that and the depth; summed over the ranges before, that is each range's own state. A second pass finds the objects that begin in its range at the records' depth, follows the last one into
the next ranges, and gives the records' texts, which Spark parses. Files are opened by pyarrow's file systems; what is gathered of a document is a row a range and a row an array.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from reelspark.sources.shards import opened
from reelspark.sources.work import written

CHUNK_BYTES = 16_000_000
MOST_TASKS = 10_000
AHEAD = 1 << 20  # bytes that are read at once to find a record's end


def _backslashes(f, start: int) -> int:
    """How many backslashes stand right before a place."""
    n, step = 0, 64
    while start - n > 0:
        back = min(step, start - n)
        f.seek(start - n - back)
        part = f.read(back)
        run = len(part) - len(part.rstrip(b"\\"))
        n += run
        if run < back:
            break
        step *= 4
    return n


def brackets(raw: bytes, before: int, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """(places, depths behind them) of the brackets outside strings, and the state at the end. before: backslashes right before the bytes."""
    b = np.frombuffer(raw, np.uint8)
    at = np.arange(len(b))
    other = np.maximum.accumulate(np.where(b != 92, at, -1)) if len(b) else at
    run = np.empty(len(b), np.int64)  # backslashes right before each place
    if len(b):
        run[0], run[1:] = before, at[:-1] - other[:-1] + np.where(other[:-1] < 0, before, 0)
    quote = (b == 34) & (run % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2 == 1
    step = np.zeros(len(b), np.int64)
    step[(b == 123) | (b == 91)], step[(b == 125) | (b == 93)] = 1, -1
    places = np.flatnonzero((step != 0) & ~within)
    depths = depth + np.cumsum(step[places])
    return places, depths, bool(within[-1]) if len(b) else inside, int(depths[-1]) if len(places) else depth


def _key_before(f, place: int) -> str:
    """The name whose value begins at a place."""
    step = 256
    while True:
        start = max(0, place - step)
        f.seek(start)
        part = f.read(place - start).rstrip()
        if part.endswith(b":") and (body := part[:-1].rstrip()).endswith(b'"'):
            i = len(body) - 1
            while (i := body.rfind(b'"', 0, i)) >= 0:
                if (len(body[:i]) - len(body[:i].rstrip(b"\\"))) % 2 == 0:
                    return json.loads(body[i:])
        if start == 0:
            return ""
        step *= 8


def _ranges(spark: SparkSession, path: str, chunk: int) -> tuple[DataFrame, int]:
    """(path, length, start) of each range, and their number."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / chunk)), F.lit(0)).alias("n")).first().n
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start")
    return files.select("path", "length", starts), max(1, min(MOST_TASKS, math.ceil(n)))


def _changes(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start")), strict=True):
                with opened(path) as f:
                    before = _backslashes(f, start)
                    f.seek(start)
                    raw = f.read(min(chunk, length - start))
                (_, _, odd, free), (_, _, _, held) = brackets(raw, before, False, 0), brackets(raw, before, True, 0)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([start]), pa.array([int(odd)], pa.int64()), pa.array([free], pa.int64()), pa.array([held], pa.int64())], ["path", "length", "start", "odd", "free", "held"])

    return run


def _found(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "inside", "depth")), strict=True):
                rows: list[tuple[int, str, str]] = []
                with opened(path) as f:
                    before = _backslashes(f, start)
                    f.seek(start)
                    raw = f.read(min(chunk, length - start))
                    places, depths, within, level = brackets(raw, before, bool(inside), depth)
                    b = np.frombuffer(raw, np.uint8)[places]
                    for p in places[(b == 91) & (depths == 2)].tolist():
                        rows.append((start + p, "array", _key_before(f, start + p)))
                    opens, closes = places[(b == 123) & (depths == 3)], places[(b == 125) & (depths == 2)]
                    ends = np.append(closes, -1)[np.searchsorted(closes, opens)]
                    for p, e in zip(opens.tolist(), ends.tolist(), strict=True):
                        if e >= 0:
                            rows.append((start + p, "record", raw[p : e + 1].decode()))
                            continue
                        text, at = [raw[p:]], start + len(raw)  # goes on behind the range
                        while at < length:
                            lead = _backslashes(f, at)
                            f.seek(at)
                            part = f.read(min(AHEAD, length - at))
                            places, depths, within, level = brackets(part, lead, within, level)
                            last = places[depths == 2]
                            if len(last):
                                text.append(part[: int(last[0]) + 1])
                                rows.append((start + p, "record", b"".join(text).decode()))
                                break
                            text.append(part)
                            at += len(part)
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["path", "place", "kind", "text"])

    return run


def json_records(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, name, place, text): each object of the arrays in the documents of a path, its array's name, and where it begins. A range of more bytes than a record has costs nothing else; a
    document cut short gives the records that are whole."""
    ranges, n = _ranges(spark, path, chunk_bytes)
    changes = written(ranges.repartition(n, "path", "start").mapInArrow(_changes(chunk_bytes), "path string, length long, start long, odd long, free long, held long"), "ranges")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    states = changes.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    states = states.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("held")).otherwise(F.col("free"))).over(before), F.lit(0)))
    found = states.select("path", "length", "start", "inside", "depth").repartition(n, "path", "start").mapInArrow(_found(chunk_bytes), "path string, place long, kind string, text string")
    found = written(found, "records")
    arrays = found.where("kind = 'array'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("arrays"))  # a row a document
    own = F.element_at(F.filter("arrays", lambda a: a["place"] < F.col("place")), -1)["text"]
    return found.where("kind = 'record'").join(F.broadcast(arrays), "path").select("path", own.alias("name"), "place", "text")
