"""Language identification with a bit-sliced Bloom filter of character trigrams.

A slot of the filter holds one bit a language, so one look-up of a trigram gives the set of all
languages whose profile contains it. A text's trigrams are looked up in bulk; each language's
count of hits is corrected for the false positives that its share of filled slots implies, and
the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import few, quoted, written

SLOTS = 1 << 18
PIECE = 500_000  # code points handled at once
_A, _B, _C, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of each text's hashes) of the trigrams around each letter; anything else counts as a blank."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    cp = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[cp], cp, 0).astype(np.uint64)
    at = np.flatnonzero(c[1:-1]) + 1
    h = c[at - 1] * _A + c[at] * _B + c[at + 1] * _C
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h, np.diff(np.searchsorted(at, ends, "right"), prepend=0)


def slots_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two slots a hash."""
    return (h >> np.uint64(20)) & np.uint64(SLOTS - 1), (h >> np.uint64(42)) & np.uint64(SLOTS - 1)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PIECE code points; a longer text is a run of its own."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > PIECE:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield first, run


@dataclass
class Model:
    """languages: sorted; usual: index of the commonest. masks[word, slot]: 64 languages' bits. false: each language's false-positive rate."""

    languages: list[str]
    usual: int
    masks: np.ndarray
    false: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of trigrams a text, corrected share of them in each language's profile)."""
        h, n = trigram_hashes(texts)
        a, b = slots_of(h)
        hits = np.zeros((len(texts), len(self.languages)))
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        some = n > 0
        for word in range(len(self.masks)):
            m = self.masks[word][a] & self.masks[word][b]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                if some.any():
                    hits[some, 64 * word + bit] = np.add.reduceat((m >> np.uint64(bit)) & np.uint64(1), starts[some])
        share = hits / np.maximum(n, 1)[:, None]
        return n, np.clip((share - self.false) / (1 - self.false), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, docs_per_language: int = 2000, close: float = 0.25, least: int = 3) -> Model:
    """The filter from labelled rows outside the held-out third.

    The fit reads about `docs_per_language` documents of each language, the same at every size: those of the least
    hashes. A trigram joins the profile of each language in which it occurs `least` times or more and at least
    `close` times as often, in proportion, as in the language where it is commonest."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(sizes)
    if not names:
        return Model([], 0, np.zeros((1, SLOTS), np.uint64), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for k in names for x in (k, min(1.0, docs_per_language / sizes[k])))), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            langs = batch.column("lang").to_pylist()
            for first, run in pieces(batch.column("text").to_pylist()):
                h, n = trigram_hashes(run)
                own = np.repeat(np.arange(first, first + len(run)), n)
                for lang in sorted({langs[i] for i in range(first, first + len(run))}):
                    of = np.array([x == lang for x in langs], bool)[own]
                    keys, counts = np.unique(h[of], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    grams = known.where(draw < share).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = written(grams, "grams")
    every = F.broadcast(grams.groupBy("lang").agg(F.sum("n").alias("of")))  # a row a language
    rate = grams.join(every, "lang").withColumn("rate", F.col("n") / F.col("of")).where(F.col("n") >= least)
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))  # at most a row a language meets at a gram
    kept = rate.join(top, "gram").where(F.col("rate") >= F.lit(close) * F.col("top"))
    number = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(names) for x in (k, i))), F.col("lang"))
    gram = F.col("gram")
    both = F.array(*(F.shiftrightunsigned(gram, s).bitwiseAND(F.lit(SLOTS - 1)) for s in (20, 42)))
    bits = kept.select(F.explode(both).alias("slot"), F.floor(number / 64).cast("int").alias("word"), F.pmod(number, F.lit(64)).cast("int").alias("place"))
    bits = bits.select("slot", "word", F.expr("shiftleft(1L, place)").alias("bit")).groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
    masks = np.zeros((-(-len(names) // 64), SLOTS), np.uint64)
    t = bits.toArrow()  # at most SLOTS rows a word
    masks[t.column("word").to_numpy(), t.column("slot").to_numpy()] = t.column("mask").to_numpy().view(np.uint64)
    filled = np.array([((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    return Model(names, names.index(max(names, key=lambda k: sizes[k])), masks, np.minimum(filled**2, 0.99))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score (share of the text's trigrams in that language's profile).

    `und` with score 0: null texts, texts without a letter, every text if nothing was learned. A text of unknown
    trigrams gets the commonest language with score 0; ties go to the language that sorts first. A text of any length is read as a whole, PIECE code points'
    worth of texts at a time. Repeated rows get equal answers; an empty table gives no rows; columns in `keep` may have any names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS * 8 bytes for 64 languages
    fields, at = docs.select(*map(quoted, keep)).schema, keep.index("text") if "text" in keep else -1  # a kept text goes to Python once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in few(batches):
            texts = batch.column(at if at >= 0 else batch.num_columns - 1).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if m.languages:
                for first, some in pieces(texts):
                    n, share = m.scores(some)
                    best = share.argmax(axis=1)
                    for i, (k, j) in enumerate(zip(n, best, strict=True)):
                        if k:
                            s = float(share[i, j])
                            langs[first + i], scores[first + i] = m.languages[j if s > 0 else m.usual], s
            kept = batch.num_columns - (at < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:kept], "lang_pred", "score"])

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*map(quoted, keep), *([F.col("text").alias("__read")] if at < 0 else [])).mapInArrow(run, schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return predict(docs, learn(docs), list(keep))
