"""Nearest neighbours and the quality of an embedding space.

Vectors are dealt to blocks, a row each, and pairs of blocks are multiplied as matrices by tiles: a tile gives back partial sums, and never all its pairs. The number of pairs is
quadratic; what is sent, held and given back is not, up to the size that tiles.py states.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.functions.columns import l2_normalize
from reelspark.operators import tiles
from reelspark.operators.nearest import knn
from reelspark.sources.work import written

__all__ = ["knn", "knn_similarity", "pairwise_similarity", "retrieval_at_k", "similarity_histogram", "similarity_rows", "similarity_stats", "similarity_sums", "uniformity", "unit"]

BLOCK_ROWS = 4_000
LEAST_ROWS = 256  # of a block, where there are fewer blocks than strips
GATHERED = 100_000


class Blocks(NamedTuple):
    rows: DataFrame  # (at, ids, v, dim): the rows of a block packed into one, whole-number ids in order and vectors as bytes
    n: int
    size: int  # bytes of all vectors


def _blocks(df: DataFrame, key: str, col: str) -> Blocks:
    """Rows without id or vector take no part; equal ids share a block."""
    own = df.select(F.col(key).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v")).where("v is not null and id is not null")
    rows, dim = own.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n = max(1, math.ceil(rows / BLOCK_ROWS), min(tiles.MOST_STRIPS, math.ceil(rows / LEAST_ROWS)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.stack(part.v.to_numpy()).astype(float)
        return pd.DataFrame({"at": part["at"].iloc[:1], "ids": [part.id.to_numpy(np.int64).tobytes()], "v": [x.tobytes()], "dim": [x.shape[1]]})

    placed = own.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return Blocks(written(placed.groupBy("at").applyInPandas(pack, "at int, ids binary, v binary, dim int"), "blocks"), n, rows * dim * 8)


def _by_tiles(blocks: Blocks, tile: Callable[[], tiles.Tile], schema: str) -> DataFrame:
    return tiles.all_pairs(blocks.rows, blocks.n, blocks.size, tile, schema)


class _Pairs(tiles.Tile):
    def __init__(self, least: float, upper: bool):
        self.least, self.upper = least, upper

    def pair(self, q: tiles.Block, c: tiles.Block) -> Iterator[pd.DataFrame]:
        for at, s in tiles.slabs(q, c):
            i, j = np.nonzero(s >= self.least)
            a, b, sim = q.ids[at + i], c.ids[j], s[i, j]
            for x, y in ((a, b), (b, a))[: 1 + (q.at != c.at)]:
                good = x < y if self.upper else x != y
                yield pd.DataFrame({"a": x[good], "b": y[good], "sim": sim[good]})


def pairwise_similarity(df: DataFrame, least: float, upper: bool = False, key: str = "id", col: str = "embedding") -> DataFrame:
    """(a, b, sim) of the pairs of different ids, or of a < b only, with a similarity of `least` or more. J8: for -1 the result is quadratic."""
    return _by_tiles(_blocks(df, key, col), lambda: _Pairs(least, upper), "a long, b long, sim double")


class _Rows(tiles.Tile):
    """Number, sum and maximum of each row's similarities to rows of larger ids."""

    def __init__(self):
        self.found: dict[int, tuple[np.ndarray, ...]] = {}

    def of(self, b: tiles.Block) -> tuple[np.ndarray, ...]:
        if b.at not in self.found:
            n = len(b.ids)
            self.found[b.at] = b.ids, np.zeros(n, np.int64), np.zeros(n), np.full(n, -np.inf)
        return self.found[b.at][1:]

    def add(self, q: tiles.Block, c: tiles.Block) -> None:
        """Numbers and sums of q's rows over c, of which only each row's place among c's ids is needed: the sum of its products is its product with the sum of the vectors behind."""
        n, total, _ = self.of(q)
        place = np.searchsorted(c.ids, q.ids, "right")
        n += len(c.ids) - place
        total += np.einsum("ij,ij->i", q.v, c.behind[place])

    def pair(self, q: tiles.Block, c: tiles.Block) -> Iterator[pd.DataFrame]:
        """Ids are in order: of a slab's columns only those between its ids need a mask; those before have smaller ids than all of its rows, those behind larger ones."""
        self.add(q, c)
        if q.at != c.at:
            self.add(c, q)
        best, cbest = self.of(q)[2], self.of(c)[2]
        for at, s in tiles.slabs(q, c):
            rows = slice(at, at + len(s))
            ids = q.ids[rows]
            before, behind = np.searchsorted(c.ids, ids[0], "left"), np.searchsorted(c.ids, ids[-1], "right")
            mid, among = c.ids[before:behind], s[:, before:behind]
            more = np.where(ids[:, None] < mid[None, :], among, -np.inf).max(axis=1, initial=-np.inf)
            best[rows] = np.maximum(best[rows], np.maximum(s[:, behind:].max(axis=1, initial=-np.inf), more))
            if q.at == c.at:
                continue
            less = np.where(ids[:, None] > mid[None, :], among, -np.inf).max(axis=0, initial=-np.inf)
            cbest[:before] = np.maximum(cbest[:before], s[:, :before].max(axis=0, initial=-np.inf))
            cbest[before:behind] = np.maximum(cbest[before:behind], less)
        return iter(())

    def end(self) -> Iterator[pd.DataFrame]:
        for ids, n, total, best in self.found.values():
            yield pd.DataFrame({"a": ids, "n": n, "total": total, "best": best})[n > 0]


def similarity_rows(df: DataFrame, key: str = "id", col: str = "embedding") -> DataFrame:
    """(a, n, total, best): number, sum and maximum of each row's similarities to the rows of larger ids. J8 without its pairs."""
    parts = _by_tiles(_blocks(df, key, col), _Rows, "a long, n long, total double, best double")
    return parts.groupBy("a").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))


def _upper(q: tiles.Block, c: tiles.Block) -> Iterator[np.ndarray]:
    """The similarities of each pair of different ids once, some at a time."""
    for at, s in tiles.slabs(q, c):
        yield s[q.ids[at : at + len(s), None] < c.ids[None, :]] if q.at == c.at else s.ravel()


class _Kernel(tiles.Tile):
    """The sum of exp(4 sim)."""

    def __init__(self):
        self.u = 0.0

    def pair(self, q: tiles.Block, c: tiles.Block) -> Iterator[pd.DataFrame]:
        for s in _upper(q, c):
            s *= 4.0
            self.u += float(np.exp(s, out=s).sum())
        return iter(())

    def end(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"u": [self.u]})


class _Distribution(tiles.Tile):
    def __init__(self, bins: int, lo: float, hi: float, kernel: bool):
        self.bins, self.lo, self.hi, self.kernel = bins, lo, hi, kernel
        self.n, self.s, self.ss, self.least, self.most, self.u, self.counts = 0, 0.0, 0.0, np.inf, -np.inf, 0.0, np.zeros(bins, np.int64)

    def pair(self, q: tiles.Block, c: tiles.Block) -> Iterator[pd.DataFrame]:
        for s in _upper(q, c):
            self.n, self.s, self.ss = self.n + len(s), self.s + float(s.sum()), self.ss + float(s @ s)
            self.least, self.most = min(self.least, s.min(initial=np.inf)), max(self.most, s.max(initial=-np.inf))
            if self.kernel:
                t = np.multiply(s, 4.0)
                t -= 4.0
                self.u += float(np.exp(t, out=t).sum())
            if self.bins:
                self.counts += np.bincount(_bin(s, self.lo, self.hi, self.bins), minlength=self.bins)
        return iter(())

    def end(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"bin": [0], "n": [self.n], "s": [self.s], "ss": [self.ss], "lo": [self.least], "hi": [self.most], "u": [self.u]})
        at = np.flatnonzero(self.counts)
        yield pd.DataFrame({"bin": at + 1, "n": self.counts[at], "s": 0.0, "ss": 0.0, "lo": 0.0, "hi": 0.0, "u": 0.0})


def _distribution(blocks: Blocks, bins: int = 0, lo: float = -1.0, hi: float = 1.0, kernel: bool = False) -> DataFrame:
    """One pass over the pairs a < b: in bin 0 their number, sum, sum of squares, ends, and, if `kernel`, the sum of exp(-2 (2 - 2 sim)); in bins from 1 on the
    numbers of the similarities in equal bins of [lo, hi], what lies outside in the end bins."""
    parts = _by_tiles(blocks, lambda: _Distribution(bins, lo, hi, kernel), "bin long, n long, s double, ss double, lo double, hi double, u double")
    return parts.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("u").alias("usum"))


def _sums(distribution: DataFrame) -> DataFrame:
    var = F.greatest(F.lit(0.0), F.col("ss") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1)
    return distribution.where("bin = 0").select("n", (F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(var)).alias("std"), "min", "max", "usum")


def similarity_sums(df: DataFrame, key: str = "id", col: str = "embedding") -> DataFrame:
    """One row over pairs a < b: n, mean, std (sample), min, max, and usum, the sum of exp(-2 (2 - 2 sim))."""
    return _sums(_distribution(_blocks(df, key, col), kernel=True))


def similarity_histogram(df: DataFrame, bins: int, lo: float, hi: float, key: str = "id", col: str = "embedding") -> DataFrame:
    """(bin from 1, n) of the similarities of pairs a < b over equal bins of [lo, hi]; what lies outside counts in the end bins."""
    return _distribution(_blocks(df, key, col), bins, lo, hi).where("bin > 0").select("bin", "n")


def _bin(s: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    t = s - lo
    t *= bins / (hi - lo)
    np.maximum(t, 0.0, out=t)
    np.minimum(t, bins - 1.0, out=t)
    return t.astype(np.int64)


class _Bracket(tiles.Tile):
    """Counts of the similarities in the last of nested brackets (lo, hi, bins, bin of the next one): by bins, or if `last`, by value."""

    def __init__(self, path: list[tuple[float, float, int, int]], lo: float, hi: float, bins: int, last: bool):
        self.path, self.lo, self.hi, self.bins, self.last = path, lo, hi, bins, last
        self.counts, self.values = np.zeros(bins, np.int64), []
        # most values are far outside; those of the brackets' end bins have no end
        self.least = max((a + i * (b - a) / m for a, b, m, i in path if i > 0), default=-np.inf) - 1e-9
        self.most = min((a + (i + 1) * (b - a) / m for a, b, m, i in path if i < m - 1), default=np.inf) + 1e-9

    def pair(self, q: tiles.Block, c: tiles.Block) -> Iterator[pd.DataFrame]:
        for s in _upper(q, c):
            s = s[(s >= self.least) & (s <= self.most)]
            for bracket in self.path:
                s = s[_bin(s, *bracket[:3]) == bracket[3]]
            if self.last:
                self.values.append(np.unique(s, return_counts=True))
            else:
                self.counts += np.bincount(_bin(s, self.lo, self.hi, self.bins), minlength=self.bins)
            if len(self.values) >= 1_000:
                self.values = [self.merged()]
        return iter(())

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        value, at = np.unique(np.concatenate([v for v, _ in self.values] or [np.zeros(0)]), return_inverse=True)
        return value, np.bincount(at, np.concatenate([n for _, n in self.values] or [np.zeros(0)]), len(value)).astype(np.int64)

    def end(self) -> Iterator[pd.DataFrame]:
        at = np.flatnonzero(self.counts)
        value, n = self.merged() if self.last else (at + 1.0, self.counts[at])
        yield pd.DataFrame({"value": value, "n": n})


def _order_statistic(blocks: Blocks, rank: int, histogram: list, lo: float, hi: float, bins: int) -> DataFrame:
    """One row (value): the rank-th least similarity of pairs a < b, given their histogram, rows (bin from 1, n), over [lo, hi].

    The bin that holds it is divided again, until at most GATHERED values or a width of rounding errors are left; those are counted one by one. A pass takes values by their bins in the
    passes before, so all agree. What a pass gathers is a row a bin."""
    path: list[tuple[float, float, int, int]] = []
    while True:
        below = 0
        for b, n in sorted(histogram):
            if below + n >= rank:
                break
            below += n
        rank -= below
        width = (hi - lo) / bins
        path.append((lo, hi, bins, b - 1))
        lo, hi = lo + (b - 1) * width, lo + b * width
        last = n <= GATHERED or width < 1e-12
        tile = lambda path=tuple(path), lo=lo, hi=hi, last=last: _Bracket(path, lo, hi, bins, last)
        counted = _by_tiles(blocks, tile, "value double, n long").groupBy("value").agg(F.sum("n").alias("n"))
        if last:
            upto = F.sum("n").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, 0))  # GATHERED values, or the few doubles of a width of 1e-12
            return counted.withColumn("upto", upto).where(F.col("upto") >= rank).agg(F.min("value").alias("value"))
        histogram = [(int(r.value), r.n) for r in counted.collect()]


def similarity_stats(df: DataFrame, key: str = "id", col: str = "embedding", bins: int = 20_000) -> DataFrame:
    """mean, sample std, min, max and lower median of the similarities of distinct pairs of unit vectors. A19."""
    blocks = _blocks(df, key, col)
    both = written(_distribution(blocks, bins), "similarities")  # at most bins + 1 rows
    histogram = [(r.bin, r.n) for r in both.where("bin > 0").select("bin", "n").collect()]
    pairs = sum(n for _, n in histogram)
    if not pairs:
        return _sums(both).select("mean", "std", "min", "max", F.lit(None).cast("double").alias("median"))
    median = _order_statistic(blocks, (pairs + 1) // 2, histogram, -1.0, 1.0, bins)
    return _sums(both).select("mean", "std", "min", "max").crossJoin(F.broadcast(median.withColumnRenamed("value", "median")))


def uniformity(df: DataFrame, key: str = "id", col: str = "embedding", diagonal: bool = True) -> DataFrame:
    """log of the mean of exp(-2 (2 - 2 sim)) over all ordered pairs; with the diagonal, whose n entries count at sim = -1. A22."""
    n = df.agg(F.count("*").alias("rows"))
    sums = _by_tiles(_blocks(df, key, col), _Kernel, "u double").agg(F.sum("u").alias("u"))
    t = sums.crossJoin(F.broadcast(n))
    rows = F.col("rows")
    whole = (2 * math.exp(-4.0) * F.col("u") + (rows * math.exp(-8.0) if diagonal else 0.0)) / (rows * rows if diagonal else rows * (rows - 1))
    return t.select(F.log(whole).alias("uniformity"))


def retrieval_at_k(neighbours: DataFrame, labels: DataFrame, ks: Sequence[int], key: str = "id", label: str = "label", least: int = 10) -> DataFrame:
    """(k, recall, precision): over queries whose label has two members or more, whether one of the k nearest shares the label, and the
    share of them that do. No rows with fewer than `least` such queries. A20."""
    lab = labels.select(F.col(key).alias("id"), F.col(label).alias("own"))
    members = lab.groupBy("own").agg(F.count("*").alias("m")).where("m >= 2")
    q = lab.join(members, "own").select("id", "own")
    other = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("theirs"))
    hits = neighbours.join(q, "id").join(other, "neighbour").withColumn("hit", (F.col("own") == F.col("theirs")).cast("int"))
    flags = hits.groupBy("id").agg(*(x for k in ks for x in (F.max(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"r{k}"), (F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / k).alias(f"p{k}"))))
    m = flags.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for k in ks for c in (f"r{k}", f"p{k}"))).where(F.col("n") >= least)
    return m.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall"), F.col(f"p{k}").alias("precision")) for k in ks))))


def knn_similarity(neighbours: DataFrame, k: int = 10) -> DataFrame:
    """Mean similarity to the nearest neighbour and to the k nearest. A21."""
    return neighbours.where(F.col("rank") <= k).agg(F.avg(F.when(F.col("rank") == 1, F.col("sim"))).alias("nn1"), F.avg("sim").alias("nn10"))


def unit(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, l2_normalize(F.col(col)))
