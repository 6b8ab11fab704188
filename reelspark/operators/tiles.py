"""Pairs of blocks of vectors, dealt as tiles: a task holds a strip of blocks and lets the blocks of another pass by.

A block is a row: whole-number ids, ascending, and their vectors as bytes. Blocks make up MOST_STRIPS strips, more if a strip would exceed STRIP_BYTES, so each block is sent
MOST_STRIPS times, in proportion to the table, until it has MOST_STRIPS * STRIP_BYTES. A task's memory is a strip, the batch that Spark sends, and SLAB rows of products.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STRIPS = 16
LEAST_STRIPS = 8  # 36 tiles, for some dozen cores
TILE_PRODUCTS = 250_000_000  # about a second's, several times what a task costs itself
STRIP_BYTES = 32 << 20
SLAB = 64  # products that fit a core's cache


class Block:
    """Ids and vectors of a row, and its further columns."""

    def __init__(self, row: dict):
        self.row, self.at = row, row["at"]
        self.ids, self.v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"], float).reshape(-1, row["dim"])

    @cached_property
    def single(self) -> tuple[np.ndarray, float]:
        """The vectors as single floats in proportion to the largest length, and that length."""
        length = float(np.linalg.norm(self.v, axis=1).max(initial=0.0))
        return (self.v / (length or 1.0)).astype(np.float32), length

    @cached_property
    def behind(self) -> np.ndarray:
        """The sums of the vectors from each place on, and zeros for the end."""
        sums = np.zeros((len(self.ids) + 1, self.v.shape[1]))
        np.cumsum(self.v[::-1], axis=0, out=sums[-2::-1])
        return sums


class Tile:
    """What a task makes of the pairs of one tile. Each pair of blocks comes once, in either order, a block with itself too."""

    def pair(self, q: Block, c: Block) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def end(self) -> Iterator[pd.DataFrame]:
        return iter(())


def slabs(q: Block, c: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of q, products with c) of SLAB rows at a time, in one buffer: the same shapes in each pass, and so the same roundings."""
    turned, out = c.v.T, np.empty((min(SLAB, len(q.ids)), len(c.ids)))
    for i in range(0, len(q.ids), SLAB):
        part = q.v[i : i + SLAB]
        yield i, np.matmul(part, turned, out=out[: len(part)])


def number_of_strips(blocks: int, size: int, products: float = math.inf) -> int:
    """For blocks of `size` bytes together. For a known number of products of their rows fewer, if tiles would have under TILE_PRODUCTS, but LEAST_STRIPS."""
    most = min(MOST_STRIPS, max(LEAST_STRIPS, math.ceil(math.sqrt(2 * min(products, MOST_STRIPS**2 * TILE_PRODUCTS) / TILE_PRODUCTS))))
    return max(1, min(blocks, most), math.ceil(size / STRIP_BYTES))


def strip(at: Column, blocks: int, strips: int) -> Column:
    """Of the at-th block, from 0."""
    return F.floor(at * strips / blocks).cast("int")


def number(low: Column, high: Column, strips: int) -> Column:
    """Of the tile of two strips, low <= high, from 0."""
    return (low * strips - F.floor(low * (low - 1) / 2) + high - low).cast("int")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {name: col[i].as_py() for name, col in zip(batch.schema.names, batch.columns, strict=True)}


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    return (pa.RecordBatch.from_pandas(frame, preserve_index=False) for frame in frames if len(frame))


def run(dealt: DataFrame, strips: int, tile: Callable[[], Tile], schema: str) -> DataFrame:
    """Rows that tiles make of dealt: blocks with tile, side (0: held, 1: passes by), within (whether the held ones are also paired among themselves) and partners
    (the held blocks that it is paired with; null for all). Only strips of different numbers have rows of side 1."""

    def made(sent: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        now, own, held = None, None, {}
        for row in rows(sent):
            if row["tile"] != now:
                if own:
                    yield from own.end()
                now, own, held = row["tile"], tile(), {}
            b = Block(row)
            if row["side"] == 0:
                held[b.at] = b
            if row["side"] == 1 or row["within"]:
                for at in held if row["partners"] is None else row["partners"]:
                    yield from own.pair(held[at], b)
        if own:
            yield from own.end()

    n = strips * (strips + 1) // 2
    return dealt.repartitionById(n, "tile").sortWithinPartitions("tile", "side", "at").mapInArrow(lambda sent: batches(made(sent)), schema)


def all_pairs(blocks: DataFrame, n: int, size: int, tile: Callable[[], Tile], schema: str) -> DataFrame:
    """Rows that tiles make of all pairs of n blocks (at, ids, v, dim)."""
    strips = number_of_strips(n, size)
    own, other = strip(F.col("at"), n, strips), F.col("other")
    each = blocks.withColumn("strip", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    low, high = F.least("strip", other), F.greatest("strip", other)
    dealt = each.select(number(low, high, strips).alias("tile"), (F.col("strip") > other).cast("int").alias("side"), (F.col("strip") == other).alias("within"), F.lit(None).cast("array<long>").alias("partners"), F.col("at").cast("long").alias("at"), "ids", "v", "dim")
    return run(dealt, strips, tile, schema)
