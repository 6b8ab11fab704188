"""Token counts as delta-maintained rollups.

A change is a signed row: +1 for an inserted count, -1 for a deleted one; a revision is both. A batch is
summed by source, language and tokenizer version and published under its batch id by one rename, so a
batch that is sent again, or sent twice at once, counts once. Totals are the sums over the published batches. The rename
has to be atomic and to fail where the target is there, as on HDFS and local disks; plain object stores don't promise that.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import few, n_words, table, work_dir, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once a Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def bpe_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text, none for null."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(vocabulary)
        for texts in batches:
            yield pa.array([len(e.encode_ordinary(t)) if t else 0 for part in few([texts]) for t in part.to_pylist()], pa.int64())

    return count(text)


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, copy_key, bpe, words) of each document: one read of the texts."""
    t = F.col("text")
    return docs.select("doc_id", "source", "lang", F.md5(t.cast("binary")).alias("copy_key"), bpe_count(t, vocabulary).alias("bpe"), n_words(t).alias("words"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """A signed row for each document and tokenizer version."""
    versions = F.array(*(F.struct(F.lit(v).alias("tokenizer"), F.col(c).alias("tokens")) for v, c in (("byte_bpe_50k", "bpe"), ("words-1", "words"))))
    return counts.select("source", "lang", F.inline(versions)).withColumn("sign", F.lit(sign))


class Rollup:
    """A ledger of published batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._store.mkdirs(self._path(f"{folder}/batches"))
        self._files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(folder).toUri(), spark._jsc.hadoopConfiguration())
        self._no_options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def published(self, batch: str) -> bool:
        return self._store.exists(self._path(f"{self.folder}/batches/{batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Publishes signed rows (source, lang, tokenizer, tokens, sign) as `batch`; False and no change if it is there already."""
        if self.published(batch):
            return False
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        sums.write.parquet(staged)
        source, target = self._path(staged), self._path(f"{self.folder}/batches/{batch}")
        try:
            self._files.rename(source, target, self._no_options)  # fails if another writer has published the batch meanwhile
        except Py4JJavaError:
            if not self.published(batch):
                raise
            self._store.delete(source, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups that come to nothing go."""
        found = [s.getPath().toString() for s in self._store.listStatus(self._path(f"{self.folder}/batches"))]
        if not found:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        every = self.spark.read.parquet(*found)
        t = every.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return t.where("n_docs <> 0 or n_tokens <> 0")


def later_copies(counts: DataFrame) -> DataFrame:
    """Documents whose text an earlier doc_id has too."""
    first = counts.where("copy_key is not null").groupBy("copy_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("copy_key", "first")
    first = written(first, "first")  # read back, so that the join can split a hot text
    return counts.join(first, "copy_key").where(F.col("doc_id") > F.col("first"))


def revisions(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each document in which a line occurs twice: doc_id, source, lang, copy_key, the counts bpe and words of its text, and
    new_bpe and new_words of the text with the first of each line only."""
    lines = F.split(F.col("text"), "\n")
    once = F.array_distinct(lines)
    found = docs.where(F.size(once) < F.size(lines)).select("doc_id", "source", "lang", "text", F.array_join(once, "\n").alias("new"))
    counts = [f(F.col(c)).alias(p + name) for c, p in (("text", ""), ("new", "new_")) for name, f in (("bpe", lambda t: bpe_count(t, vocabulary)), ("words", n_words))]
    return found.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("copy_key"), *counts)


def maintained(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rollup over documents after three batches: all are loaded; later exact copies are deleted; counts of
    documents with repeated lines are revised to those of the text without them. The second batch is sent twice.

    Null and empty texts count as a document without tokens, and a text of any length is counted as a whole; null sources and languages are groups. Every row is a document of
    its own, whichever rows share its doc_id: old and revised counts are taken from the row. A null doc_id is no later copy. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, work_dir(spark, "rollup"))
    counts = written(counted(docs, vocabulary), "counts")
    gone = written(later_copies(counts), "copies")
    rollup.commit("load", signed(counts, 1))
    rollup.commit("copies", signed(gone, -1))
    rollup.commit("copies", signed(gone, -1))
    changed = written(revisions(docs, vocabulary), "revised").join(gone.select("doc_id", "copy_key").distinct(), ["doc_id", "copy_key"], "left_anti")
    new = changed.select("source", "lang", F.col("new_bpe").alias("bpe"), F.col("new_words").alias("words"))
    rollup.commit("lines", signed(changed, -1).unionByName(signed(new, 1)))
    return rollup.totals()
