"""N-gram Jaccard join by prefix trees: documents whose sets of word shingles have a similarity of `percent` or more, exactly, and their components.

Sets are ordered by their shingles' hashes, one order for all. Of n shingles a linked set may miss s = n - ceil(n * percent / 100).

1. Equal sets are one class. Of each class the first 2 s + 1 shingles are dealt out. Two linked sets share more than the smaller one's s among those, so a
   class goes unless that many of its own occur in another class too.
2. Of the classes left, all shingles are counted. One with more than s shingles of its own alone goes, as it can't be linked. Of another one with u such
   shingles, the s - u + 1 rarest of the shared ones are its buckets: linked sets meet in one of them at least.
3. A bucket's classes are compared with its hub, the class with the least share of own shingles, and what that leaves outside a bucket's main component with that component and the other
   leftovers, block by block (neardup.closed_links). So no bucket's pairs are all made and no link between components is missed.

A task stores one block of sets in a prefix tree: a run of sorted sets and the lengths of the beginnings that neighbours share. A set of the other block walks
it; what it shares with a beginning is counted once for all sets of the subtree, and a subtree is left as soon as the remaining lengths can't make up for what is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import few, written
from reelspark.llm.neardup import BROADCAST_IDS, Shingler, closed_links, evenly

STEP = 128  # shingles of a path that are looked up at once, at first


class PrefixTree:
    """Sets as sorted arrays, by their common beginnings."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.names, self.sets = [names[i] for i in order], [sets[i] for i in order]
        self.shared = [0] if sets else []  # with the set before
        for a, b in zip(self.sets, self.sets[1:]):
            n = min(len(a), len(b))
            other = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(other[0]) if len(other) else n)
        self.met = np.zeros(max(map(len, sets), default=0) + 1, np.int64)
        self.steps = 0  # shingles looked up

    def linked(self, y: np.ndarray, percent: int) -> Iterator[int]:
        """Names of the sets with 100 * intersection >= percent * union."""
        n = len(y)
        least, most = -(-percent * n // 100), 100 * n // percent
        needed = lambda m: -(-percent * (m + n) // (100 + percent))
        may_miss, y_may_miss = most - needed(most), n - needed(least)  # of the largest, and for the smallest set that can be linked
        met, known, left = self.met, 0, None  # met[d] is right for d <= known; left: from this depth on the path can't be linked
        for name, x, shared in zip(self.names, self.sets, self.shared, strict=True):
            if left is not None and shared >= left:
                continue
            left, known = None, min(known, shared)
            if not least <= len(x) <= most:
                continue
            step = STEP
            while known < len(x) and left is None:
                part = x[known : known + step]
                at = np.searchsorted(y, part)
                hit = y[np.minimum(at, n - 1)] == part
                sums = met[known] + np.cumsum(hit)
                self.steps += len(part)
                depth = np.arange(known + 1, known + len(part) + 1)
                lost = np.flatnonzero((depth - sums > may_miss) | (at + hit - sums > y_may_miss))
                met[known + 1 : known + len(part) + 1] = sums
                known += len(part)
                step *= 2
                if len(lost):
                    left = int(depth[lost[0]])
            if left is None and 100 * met[len(x)] >= percent * (len(x) + n - met[len(x)]):
                yield name


def linked(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """tasks (task, side, id): the linked pairs (a, b) between sides 0, whose sets stand in a tree, and 1, whose sets walk it one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, tree, pairs = None, [], None, []
        for batch in few(batches):
            items = batch.column(3)
            for i, (t, side, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if t != task:
                    task, held, tree = t, [], None
                x = items[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if side == 0:
                    held.append((name, x.copy()))
                    continue
                if tree is None:
                    tree = PrefixTree([h[0] for h in held], [h[1] for h in held])
                pairs += [(found, name) for found in tree.linked(x, percent) if found != name]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])
            pairs = []

    return evenly(tasks, sets).mapInArrow(run, "a long, b long")


def may_miss(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100)


def _sets(docs: DataFrame, k: int, percent: int | None) -> DataFrame:
    """(doc_id, n, sig, items): the shingles in their order, the first 2 s + 1 where percent is given; sig is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for batch in few(batches):
            got = [of(t.as_py()) for t in batch.column(1)]
            n = [len(x) for x in got]
            sigs = [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in got]
            firsts = got if percent is None else [x[: 2 * (len(x) - (percent * len(x) + 99) // 100) + 1] for x in got]
            cuts = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            items = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0, np.uint64), *firsts]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), items], ["doc_id", "n", "sig", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, sig binary, items array<long>")


def _frequent(rows: DataFrame, label: str) -> DataFrame:
    """(token, c) of the tokens that several rows have; written, so that the join with it can split a hot token."""
    return written(rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), label)


def similar_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    A document of fewer than k words has its word sequence as its one shingle; null, empty and blank texts have none and link with nothing. A text of any length is read
    as a whole. Rows of one doc_id are compared by their own texts. A null doc_id takes no part and has no component. An empty table gives no rows. Other columns,
    whatever their names, are not read."""
    own = written(_sets(docs, k, percent), "firsts")
    first = own.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "n", "items")).alias("x"))
    classes = written(first.select(F.monotonically_increasing_id().alias("id"), "sig", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.items").alias("items")), "classes")
    n = F.col("n")
    dealt = classes.select("id", "n", F.explode("items").alias("token"))
    near = dealt.join(_frequent(dealt, "frequent"), "token", "left_semi").groupBy("id", "n").agg(F.count("*").alias("m"))
    near = near.where(F.col("m") > may_miss(F.ceil(n * percent / 100), percent)).select("id")
    near = written(classes.join(near, "id", "left_semi").select("id", "sig", "rep"), "near")
    small = near.count() <= BROADCAST_IDS
    near = F.broadcast(near) if small else near
    texts = docs.select("doc_id", "text").join(near.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(_sets(texts, k, None).join(near.select("id", "sig"), "sig").select("id", "n", "items").dropDuplicates(["id"]), "sets")
    rows = sets.select("id", "n", F.explode("items").alias("token"))
    rows = rows.join(_frequent(rows, "counted"), "token")
    by = W.partitionBy("id")  # a set's own shingles
    rows = rows.withColumn("u", n - F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy("c", "token")))
    rows = written(rows.where(F.col("place") <= may_miss(n, percent) - F.col("u") + 1).select("id", "n", "token", (F.col("u") / n).alias("loose")), "rows")
    hub = rows.groupBy("token").agg(F.min(F.struct("loose", "id", "n")).alias("x"), F.count("*").alias("c")).where("c > 1")
    hub = written(hub.select("token", F.col("x.id").alias("hub"), F.col("x.n").alias("hub_n")), "hubs")
    shared = written(rows.join(hub, "token").select(F.col("token").alias("h"), F.col("id").alias("rep"), "n", "hub", "hub_n"), "buckets")
    roots = closed_links(shared, sets.select("id", "items"), percent, linked)
    comps = classes.select("id", "sig", "rep").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = written(comps.groupBy("root").agg(F.min("rep").alias("component")), "least")
    comps = comps.join(least, "root").select("sig", "component")
    out = own.select("doc_id", "n", "sig").join(comps, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
