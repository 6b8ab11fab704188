"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

A sketch has BINS bins. In round i each shingle is hashed to a bin and a value; a bin keeps the value
of the first round that reaches it, the least one of that round. BINS more rounds serve one bin each, so every bin
fills, and equal bins of two sketches are as frequent as their sets' Jaccard similarity, with the
concentration of independent trials. BANDS bands of ROWS bins: a pair at 0.8 shares no
band with probability (1 - 0.8**5)**40 = 1.3e-7, and two texts at 0.05 share one with 1.3e-5.

Documents of equal shingle sets are one class from the start, stood for by their least doc_id. A
bucket's members are checked against its least member. What that leaves outside the bucket's main component is checked
against all of that component and the other leftovers, block by block: a task compares two blocks of sets and gives back links only.
So a bucket's pairs inside a component are never made, and no link between components is missed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import discard, few, quoted, written
from reelspark.operators.ranks import row_numbers

BINS, ROWS = 200, 5
BANDS = BINS // ROWS
_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 48) - 1)
WORDS_KEPT = 100_000
BROADCAST_IDS = 500_000
BLOCK_ROWS, BLOCK_ITEMS = 128, 2_000_000  # sets, and shingles of them (8 bytes each), that a task holds of a side


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's k-word shingles."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        ws = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
        if not ws:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            h = np.array([known[w] for w in ws], np.uint64)
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in ws], np.uint64)
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, np.uint64(k))
        for i in range(k):
            out = _mixed(out * _K + h[i : i + n])
        return np.unique(out)


def _hashes(x: np.ndarray, first: int, rounds: int) -> np.ndarray:
    """rounds x len(x) hashes, other ones in each round."""
    seeds = _mixed(np.arange(first + 1, first + rounds + 1, dtype=np.uint64) * _M2)
    return _mixed(x[None, :] ^ seeds[:, None])


def sketch(x: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty set of hashes."""
    out = np.full(BINS, np.iinfo(np.uint64).max)
    i = 0
    while i < BINS and (out == np.iinfo(np.uint64).max).any():
        rounds = min(BINS - i, max(1, 1024 // len(x)))
        h = _hashes(x, i, rounds)
        value = (np.arange(i, i + rounds, dtype=np.uint64)[:, None] << np.uint64(48)) | (h & _LOW)
        np.minimum.at(out, ((h >> np.uint64(48)) * np.uint64(BINS) >> np.uint64(16)).astype(np.int64).ravel(), value.ravel())
        i += rounds
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[b] = (np.uint64(BINS + b) << np.uint64(48)) | (_hashes(x, BINS + int(b), 1) & _LOW).min()
    return out


def bands(s: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in s.reshape(BANDS, ROWS).T:
        h = _mixed(h * _K + row)
    return h.view(np.int64)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sig, bands) of each document; no sig and no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for batch in few(batches):
            n, sigs, rows = [], [], []
            for text in batch.column(1):
                x = of(text.as_py())
                n.append(len(x))
                sigs.append(hashlib.md5(x.tobytes()).digest() if len(x) else None)
                rows.append(bands(sketch(x)) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n", "sig", "bands"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, items): the full sets of the listed documents, written."""
    small = ids.count() <= BROADCAST_IDS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for batch in few(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "items"])

    own = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary"))
    return written(own.join(F.broadcast(ids) if small else ids, "id", "left_semi").mapInArrow(sets, "id long, items binary").dropDuplicates(["id", "items"]), "sets")


def meeting(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of the sets that meet 100 * intersection >= percent * union, by counting how often a right set's items occur in each left set."""
    sizes = np.array([len(x) for x in left])
    every, owner = np.concatenate(left), np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    for j, y in enumerate(right):
        first, last = np.searchsorted(every, y, "left"), np.searchsorted(every, y, "right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(left))
        out += [(int(i), j) for i in np.flatnonzero(100 * same >= percent * (sizes + len(y) - same))]
    return out


def linked(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """tasks (task, side, id): the linked pairs (a, b) between sides 0 and 1 of each task. A side has about BLOCK_ROWS sets and BLOCK_ITEMS shingles at most, a longer set alone apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])

        def found() -> pa.RecordBatch:
            pairs = []
            if sides[0] and sides[1]:
                names = [[i for i, _ in side] for side in sides]
                items = [[np.frombuffer(x, np.uint64) for _, x in side] for side in sides]
                pairs = [(names[0][i], names[1][j]) for i, j in meeting(*items, percent) if names[0][i] != names[1][j]]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for t, side, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    yield found()
                    task, sides = t, ([], [])
                sides[side].append((i, x))
        yield found()

    return evenly(tasks, sets).mapInArrow(run, "a long, b long")


def evenly(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """(task, side, id, items), a task's rows next to each other, side 0 first: tasks in the order of their sizes are dealt to the partitions in turn, so that all get equal shares."""
    tasks = written(tasks, "tasks")
    sizes = tasks.groupBy("task").agg(F.count("*").alias("n"))
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = written(row_numbers(sizes, F.desc("n"), "task").select("task", F.pmod("rn", F.lit(n)).cast("int").alias("turn")), "turns")
    turns = F.broadcast(turns) if turns.count() <= BROADCAST_IDS else turns
    rows = tasks.join(turns, "task").join(sets, "id").select("task", "side", "id", "items", "turn")
    return rows.repartitionById(n, F.col("turn")).sortWithinPartitions("task", "side").drop("turn")


def in_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tasks (task, side, id) that bring every left id of a group (g, id, n) together with every right id of it, in blocks by hash; n is the set's size."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select("g", one.alias("side"), "n").unionByName(right.select("g", none.alias("side"), "n"))

    def blocks(side: int) -> Column:
        own = F.col("side") == side
        return F.greatest(F.ceil(F.count_if(own) / BLOCK_ROWS), F.ceil(F.sum(F.when(own, F.col("n")).otherwise(0)) / BLOCK_ITEMS))

    n = both.groupBy("g").agg(blocks(1).alias("l"), blocks(0).alias("r")).where("l > 1 or r > 1")
    n = written(n, "blocks")  # groups of several blocks
    n = F.broadcast(n) if n.count() <= BROADCAST_IDS else n
    block = F.xxhash64("id")

    def dealt(side: DataFrame, number: int, own: str, other: str) -> DataFrame:
        rows = side.join(n, "g", "left").withColumn("own", F.pmod(block, F.greatest(one, F.coalesce(own, one))))
        rows = rows.withColumn("other", F.explode(F.sequence(none, F.greatest(one, F.coalesce(other, one)) - 1)))
        task = F.xxhash64("g", *(("own", "other") if number == 0 else ("other", "own")))
        return rows.select(task.alias("task"), F.lit(number).alias("side"), "id")

    return dealt(left, 0, "l", "r").unionByName(dealt(right, 1, "r", "l"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, root) of every id in edges (a, b), root being the least id of its component, by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.where("v < u")
        least = written(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        moved = near.join(least, "u")  # least was read back, so that the join can split a hot root
        moved = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        moved = moved.where("a < b")
        return moved if large else moved.distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every id hangs on one root, and roots on none."""
        ends = e.select(F.col("b").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(e.select(F.col("a").alias("v"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        seen = ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        return not seen.where("hangs > 1 or (hangs > 0 and holds > 0)").limit(1).count()

    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), label)
    while not settled(e):
        e, done = written(star(star(e, True), False), label), e
        discard(done)
    return e.select(F.col("b").alias("id"), F.col("a").alias("root"))


def closed_links(shared: DataFrame, sets: DataFrame, percent: int, link: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """(id, root) of the components of linked sets. shared (h, rep, n, hub, hub_n): each bucket's members, whose sets have n items, and its hub, one of them; linked sets share a
    bucket. link(tasks, sets, percent) gives the links of blocks."""
    # first each bucket's members against its hub
    near = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent  # sets of other sizes can't be linked
    pairs = shared.where("hub <> rep").where(near).select(F.col("hub").alias("g"), F.col("rep").alias("id"), "n", "hub_n").distinct()
    edges = written(link(in_blocks(pairs.select("g", F.col("g").alias("id"), F.col("hub_n").alias("n")).distinct(), pairs.drop("hub_n")), sets, percent), "edges")
    stars = components(edges, "stars")
    # then the members of other components than a bucket's main one (the largest) against all of the main one and each other
    r = shared.join(stars.withColumnRenamed("id", "rep"), "rep", "left").select("h", "rep", "n", F.coalesce("root", "rep").alias("comp"))
    r = written(r, "members")
    sizes = r.select("rep", "comp").distinct().groupBy("comp").agg(F.count("*").alias("size"))
    main = r.select("h", "comp").distinct().join(sizes, "comp").groupBy("h").agg(F.max(F.struct("size", (-F.col("comp")).alias("less"))).alias("x"), F.count("*").alias("comps")).where("comps > 1")
    main = written(main.select("h", (-F.col("x").getField("less")).alias("g")), "main")
    others = written(r.join(main, "h").where("comp <> g").select("g", F.col("rep").alias("id"), "n").distinct(), "others")
    members = r.select(F.col("comp").alias("g"), F.col("rep").alias("id"), "n").distinct().join(others.select("g").distinct(), "g", "left_semi")
    # sets can be linked only in one size class or in neighbouring ones, as a class spans the widest ratio of linked sizes
    size = F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-9)) if percent < 100 else F.col("n")
    classed = lambda t, c: t.withColumn("c", c).select(F.xxhash64("g", "c").alias("g"), "id", "n")
    around = F.explode(F.array(size - 1, size, size + 1))
    more = link(in_blocks(classed(others, size), classed(members.unionByName(others), around)), sets, percent)
    return components(stars.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(more), "components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (it is that document).

    A document of fewer than k words has its word sequence as its one shingle; null, empty and blank texts have none, link with nothing and are
    kept. A text of any length is read as a whole. Rows of one doc_id are one document with the links of all their texts. A null doc_id takes no part and is
    kept, with no component. An empty table gives no rows. Other columns, whatever their names, are not read."""
    own = written(sketched(docs, k), "sketches")
    real = own.where("sig is not null and doc_id is not null")
    # a class's rows agree in n and bands
    classes = written(real.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "bands")).alias("x")).select("sig", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.bands").alias("bands")), "classes")
    rows = classes.select("rep", "n", F.explode("bands").alias("h"))
    hubs = rows.groupBy("h").agg(F.min(F.struct("rep", "n")).alias("x"), F.count("*").alias("c")).where("c > 1").select("h", F.col("x.rep").alias("hub"), F.col("x.n").alias("hub_n"))
    hubs = written(hubs, "hubs")  # read back, so that the join can split the rows of a hot bucket
    shared = written(rows.join(hubs, "h"), "buckets")
    sets = shingle_sets(docs, shared.select(F.col("rep").alias("id")).distinct(), k)
    roots = closed_links(shared, sets, percent, linked)
    ends = classes.select("sig", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("root", "rep").alias("component"))
    out = own.join(ends, "sig", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of near duplicates, that of the least doc_id, with its columns.

    Rows of one doc_id are told apart by their texts: of repeated rows one stays, and another text falls or stands by itself. Rows without doc_id,
    and null, empty or blank texts, stay (of repeated ones with a doc_id, one). An empty table gives no rows; columns may have any names."""
    keys = docs.where("doc_id is not null").groupBy("doc_id", F.md5(F.col("text").cast("binary")).alias("__tkey")).agg(F.count("*").alias("__n"))
    keys = written(keys, "keys")
    if keys.groupBy("doc_id").agg(F.sum("__n").alias("n")).where("n > 1").isEmpty():
        gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    # some doc_id has several rows: distinct pairs of doc_id and text get numbers of their own, in the order of doc_id
    ids = row_numbers(keys.select("doc_id", "__tkey"), "doc_id", F.col("__tkey").asc_nulls_first(), name="__row")
    ids = ids.select(F.col("doc_id").alias("__id"), F.col("__tkey").alias("__key"), "__row")
    own = docs.where("doc_id is not null").withColumn("__tkey", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "__tkey"])
    own = written(own.join(ids, (F.col("doc_id") == F.col("__id")) & F.col("__tkey").eqNullSafe(F.col("__key"))).drop("__id", "__key", "__tkey"), "rows")
    gone = near_duplicates(own.select(F.col("__row").alias("doc_id"), "text"), k, percent).where("not kept").select(F.col("doc_id").alias("__gone"))
    left = own.join(gone, own["__row"] == gone["__gone"], "left_anti").select(*map(quoted, docs.columns))
    return left.unionByName(docs.where("doc_id is null"))
