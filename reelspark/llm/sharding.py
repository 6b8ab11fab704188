"""Sharding by minimax contiguous partition (native DataFrame code).

Groups of equal texts are atomic and stand in the order of the text's MD5, so a document's shard
follows from its own digest and fifteen cut digests: no join, and no group is ever gathered.

The smallest feasible capacity is found by binary search with a greedy check. The check runs over a
skeleton of the order: the bytes of digest prefixes. A prefix that holds several groups can be
cut at an unknown place inside; taking it as one piece gives an upper bound of the capacity,
taking it as fluid gives a lower one. Prefixes in which a cut may fall are split by two more
digits until both bounds agree. A round is one aggregation of at most a few ten thousand rows,
whatever the table's size.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import quoted, written

FIRST_DIGITS, MORE_DIGITS, DIGEST = 3, 2, 32


def text_key(text: Column) -> Column:
    """Order and identity of a group of equal texts; null texts are a group of their own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("0" * DIGEST))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


class Skeleton:
    """Bytes of digest prefixes in order; a leaf is atomic if all its rows have one digest."""

    def __init__(self, leaves: dict[str, tuple[int, bool]], shards: int):
        self.leaves, self.n = leaves, shards
        self.names = sorted(leaves)
        self.weight = [leaves[k][0] for k in self.names]
        self.atomic = [leaves[k][1] for k in self.names]
        self.ends = [0]
        for w in self.weight:
            self.ends.append(self.ends[-1] + w)
        self.total = self.ends[-1]

    def cuts(self, capacity: int, fluid: bool) -> list[int]:
        """Greedy cuts in bytes, at most one a shard; the last is the total if the capacity is feasible."""
        at, out = 0, []
        for _ in range(self.n):
            if at == self.total:
                break
            i = bisect_right(self.ends, at + capacity) - 1
            whole = self.ends[i]
            at = at + capacity if fluid and i < len(self.weight) and not self.atomic[i] else max(at, whole)
            out.append(at)
        return out + [self.total] * (self.n - len(out))

    def smallest(self, fluid: bool) -> int:
        lo = max([-(-self.total // self.n), *(w for w, a in zip(self.weight, self.atomic, strict=True) if a)])
        hi = max(lo, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, fluid)[-1] == self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def leaf_at(self, x: int) -> int:
        return min(bisect_right(self.ends, x) - 1, len(self.weight) - 1)

    def open_leaves(self, low: int, high: int) -> list[str]:
        """Leaves to split while the bounds low < high of the capacity differ."""
        heavy = [k for k, w, a in zip(self.names, self.weight, self.atomic, strict=True) if not a and w * 8 * self.n > self.total]
        if heavy:
            return heavy
        found: set[int] = set()
        for a, b in zip(self.cuts(low, False), self.cuts(high, True), strict=True):
            found.update(range(self.leaf_at(min(a, b)), self.leaf_at(max(a, b)) + 1))
        return [self.names[i] for i in sorted(found) if not self.atomic[i]]

    def even_cuts(self, capacity: int) -> tuple[list[int], list[str]]:
        """Leaf numbers at which shards 1.. begin: no shard above the capacity, sizes as even as that allows; and the
        leaves that would have to be split for a more even cut."""
        last = [len(self.weight)]  # last[j]: the least leaf from which j shards hold the rest
        for _ in range(self.n - 1):
            i = last[-1]
            while i > 0 and self.ends[last[-1]] - self.ends[i - 1] <= capacity:
                i -= 1
            last.append(i)
        at, out, wanted = 0, [], []
        for left in range(self.n, 1, -1):
            want = self.ends[at] + (self.total - self.ends[at]) / left
            i = bisect_right(self.ends, want) - 1
            if i < len(self.weight) and self.ends[i + 1] - want < want - self.ends[i]:
                i += 1
            leaf = self.leaf_at(int(want))
            if not self.atomic[leaf] and self.weight[leaf] * 1000 * self.n > self.total:
                wanted.append(self.names[leaf])
            at = min(max(i, last[left - 1], at), bisect_right(self.ends, self.ends[at] + capacity) - 1)
            out.append(at)
        return out, wanted


def _split(sized: DataFrame, prefixes: list[str]) -> dict[str, tuple[int, bool]]:
    """The leaves below the prefixes ('' for all), two digits deeper."""
    out: dict[str, tuple[int, bool]] = {}
    for depth in sorted({len(p) for p in prefixes}):
        own = [p for p in prefixes if len(p) == depth]
        rows = sized.where(F.substring("__key", 1, depth).isin(own)) if depth else sized
        deeper = min(DIGEST, depth + MORE_DIGITS) if depth else FIRST_DIGITS
        found = rows.groupBy(F.substring("__key", 1, deeper).alias("p")).agg(F.sum("__size").alias("w"), F.min("__key").alias("a"), F.max("__key").alias("b")).collect()
        out.update({r.p: (r.w, r.a == r.b) for r in found})
    return out


def minimax_cuts(sized: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, digests at which shards 1.. begin) of rows (__key, __size)."""
    leaves = _split(sized, [""])
    if not leaves:
        return 0, ["g"] * (shards - 1)
    while True:
        s = Skeleton(leaves, shards)
        low, high = s.smallest(True), s.smallest(False)
        todo = s.open_leaves(low, high) if low < high else s.even_cuts(high)[1]
        if not todo:
            break
        deeper = _split(sized, todo)
        leaves = {k: v for k, v in leaves.items() if k not in set(todo)} | deeper
    return high, [s.names[i] if i < len(s.names) else "g" for i in s.even_cuts(high)[0]]


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with size, text_crc32, law, shard, slot and grown_shard, and the columns in `keep`.

    The largest shard is as small as equal texts in one shard allow. Null texts have size 1, no checksum, and form
    one group; empty texts are ordinary, and a text of any length is one row of one shard. Repeated rows each get a slot; ties in doc_id stand in any order. An empty
    table gives an empty result. Other columns are left alone, whatever their names."""
    t = F.col(text_col)
    sized = written(docs.select(F.col(id_col).alias("doc_id"), text_key(t).alias("__key"), text_size(t).alias("__size"), F.crc32(t.cast("binary")).alias("__crc"), *(quoted(c).alias(f"k_{c}") for c in keep)), "sized")
    _, starts = minimax_cuts(sized, shards)
    shard = sum(((F.col("__key") >= F.lit(k)).cast("int") for k in starts), F.lit(0)) if starts else F.lit(0)
    # slots: rows in (shard, doc_id) order over range partitions, then each partition's offset
    placed = sized.withColumn("shard", shard.cast("int")).repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id")
    placed = written(placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "placed")
    parts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("shard", "__part", (before - F.col("__first")).alias("__off"))  # a row per partition and shard border
    return placed.join(F.broadcast(offsets), ["shard", "__part"]).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("__at") + F.col("__off")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *(quoted(f"k_{c}").alias(c) for c in keep if c not in ("doc_id", "size", "shard", "slot", "law", "text_crc32", "grown_shard")),
    )
