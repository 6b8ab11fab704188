"""Line dedup: repeated runs of lines, found in a suffix array by distributed prefix doubling (native DataFrame code).

A document is its sequence of line IDs: a line that occurs again has the place of its digest in their order, any other line and the end
of a text have an ID of their own. A doubling step ranks the pairs (rank here, rank 2^j lines on)
by a range-partitioned sort of the distinct pairs, where the increasing row id is the new rank, until all
ranks are unique: that is the suffix array of all places with a repeated line. A suffix keeps its ranks at all widths.

The longest common prefix (LCP) of neighbours in the array is found by these ranks, from the widest down, for irreducible places only: where
the lines before differ too. At the other places it is one less than at the place before. Suffixes between two
boundaries with an LCP below w are an interval that shares w lines, for any w; overlapping intervals of neighbouring places are a maximal
repeated run. Runs of `min_lines` lines count, and shorter ones of `min_words` words. The earliest suffix of
an interval stays, and the lines of the others go.

Of documents with equal texts the first one stands in the array; the others lose all lines (texts under min_lines lines stand in it each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import discard, n_words, written
from reelspark.operators.ranks import prefix_sums, row_numbers

DOC = ["did"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tkey", F.md5(F.col("text").cast("binary")))


def _line_words(line: Column) -> Column:
    """n_words() of a line: spaces are counted where words have one space between them, as a pattern takes far longer."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == "")
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, n_words(line)).otherwise((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long"))


def documents(docs: DataFrame, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """(standing, others) of the distinct documents: standing has (did, doc_id, tkey, n, copies), did being the place in the order of doc_id, nulls
    last, then of the text's digest; others (doc_id, tkey, n) repeat the text of an earlier one and have min_lines lines or more."""
    texts = _keyed(docs.select("doc_id", "text")).where("text is not null").select("doc_id", "tkey", F.size(F.split("text", "\n")).alias("n")).distinct()
    texts = written(texts, "texts")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    classes = texts.groupBy("tkey").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1")
    classes = written(classes, "classes")  # read back, so that the join can split a hot text
    t = texts.join(classes, "tkey", "left").withColumn("again", F.col("m").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("n") >= min_lines))
    copies = F.when(F.col("n") >= min_lines, F.coalesce("m", F.lit(1))).otherwise(F.lit(1)).cast("long")
    standing = row_numbers(t.where("not again").select("doc_id", "tkey", "n", copies.alias("copies")), F.col("doc_id").asc_nulls_last(), F.col("tkey"), name="did")
    return written(standing, "standing"), t.where("again").select("doc_id", "tkey", "n")


def _refined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (rank, keys, ..) with `new`, the rank within its group of equal ranks moved on by the number of the group's rows of lesser keys, and c, the number of rows of equal rank and keys."""
    counts = rows.groupBy("rank", *keys).agg(F.count("*").alias("c"))
    counts = prefix_sums(counts, {"c": "upto"}, ["rank", *keys]).withColumn("upto", F.col("upto") - F.col("c"))
    counts = written(counts, "counts")
    starts = counts.groupBy("rank").agg(F.min("upto").alias("start"))
    counts = written(counts.join(starts, "rank").withColumn("new", F.col("rank") + F.col("upto") - F.col("start")).drop("upto", "start"), "ranks")  # read back, so that the join can split a hot rank
    return rows.join(counts, ["rank", *keys])


def suffixes(docs: DataFrame, standing: DataFrame) -> DataFrame:
    """(did, pos, words, before, copies, hist, sa): the suffix array of all places whose line occurs again. sa counts from 1; hist has the suffix's ranks
    at 1, 2, 4 .. lines up to the one that is its own, equal for suffixes that share so many; before is the rank of the line before, if that occurs again; words are the line's.

    A rank is the first place of its suffixes in the array, so a suffix that no other shares its rank with is settled: it is set aside, and read again only where its document has others."""
    lines = _keyed(docs.select("doc_id", "text")).where("text is not null").select("doc_id", "tkey", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.select("doc_id", "tkey", "pos", _line_words(F.col("text")).alias("words"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("line"))
    d = standing.select(F.col("doc_id").alias("d_id"), F.col("tkey").alias("d_key"), "did", "copies")
    again = written(lines.groupBy("line").agg(F.count("*").alias("c")).where("c > 1").select("line"), "again")
    rows = lines.join(again, "line").join(d, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("tkey") == F.col("d_key")))
    rows = rows.select("did", "pos", "words", "copies", "line").dropDuplicates(["did", "pos"])  # rows that repeat a document count once
    rows = written(rows.withColumn("rank", F.lit(1).cast("long")), "lines")
    own = W.partitionBy(*DOC).orderBy("pos")
    before = F.lag(F.struct("pos", "new")).over(own)
    now = _refined(rows, ["line"]).withColumn("b", before).withColumn("before", F.when(F.col("b.pos") == F.col("pos") - 1, F.col("b.new"))).drop("b", "line", "rank").withColumnRenamed("new", "rank")
    now = written(now.withColumn("hist", F.array("rank")), "ranked")
    settled, active, width, done = now.where("c = 1").drop("c"), now.where("c > 1").drop("c"), 1, []
    while not active.isEmpty():
        # where all `width` lines from here are repeated ones, the place `width` lines on is `width` rows on; a suffix with another line differs from all that share its rank by its document and place
        some = active.select("did").distinct()
        near = settled.join(some, DOC, "left_semi").select("did", "pos", "rank", F.lit(False).alias("on"))
        near = near.unionByName(active.withColumn("on", F.lit(True)), allowMissingColumns=True)
        ahead = near.withColumn("a", F.lead(F.struct("pos", "rank"), width).over(own)).where("on").drop("on")
        there = F.coalesce(F.col("a.pos") == F.col("pos") + width, F.lit(False))
        pairs = ahead.withColumn("h", F.when(there, F.col("a.rank")).otherwise(-F.col("did"))).withColumn("g", F.when(there, F.lit(-1)).otherwise(F.col("pos"))).drop("a")
        pairs = written(pairs, "pairs")
        new = _refined(pairs, ["h", "g"]).drop("rank", "h", "g").withColumnRenamed("new", "rank")
        new = written(new.withColumn("hist", F.concat("hist", F.array("rank"))), "doubled")
        discard(pairs)
        settled, active = settled.unionByName(new.where("c = 1").drop("c")), new.where("c > 1").drop("c")
        done.append(new)
        width *= 2
    out = written(settled.withColumnRenamed("rank", "sa"), "array")
    discard(rows, now, *done)
    return out


def _shared(a: Column, b: Column, most: Column | None = None) -> Column:
    """Number of widths, of the first `most`, at which two suffixes have equal ranks: they share 2^(that less 1) lines, if any."""
    n = F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda n, x: n + x), F.lit(0))
    return n if most is None else F.least(n, most)


def with_lcp(array: DataFrame) -> DataFrame:
    """suffixes() with lcp, the lines that a suffix shares with the one before it in the array, and next_lcp, with the one after it."""
    back = array.select((F.col("sa") + 1).alias("sa"), F.col("did").alias("p_did"), F.col("pos").alias("p_pos"), F.col("before").alias("p_before"), F.col("hist").alias("p_hist"))
    same = F.coalesce(F.col("before") == F.col("p_before"), F.lit(False))
    step = lambda k: F.when(k > 0, F.expr("shiftleft(1, k - 1)")).otherwise(0)
    every = array.join(back, "sa", "left").withColumn("reducible", same).withColumn("k", F.when(F.col("reducible"), 0).otherwise(_shared(F.col("hist"), F.col("p_hist"))))
    every = written(every.drop("hist", "p_hist", "before", "p_before"), "neighbours")
    pairs = every.where("k > 0").select("did", "pos", "p_did", "p_pos", step(F.col("k")).alias("lcp"), "k")
    found, todo = pairs.where("k < 2").select("did", "pos", "lcp"), pairs.where("k > 1")
    there = array.select(F.col("did").alias("x"), F.col("pos").alias("y"), "hist")
    while not todo.isEmpty():
        one = todo.join(there, (F.col("did") == F.col("x")) & (F.col("pos") + F.col("lcp") == F.col("y")), "left").drop("x", "y").withColumnRenamed("hist", "hist1")
        two = one.join(there, (F.col("p_did") == F.col("x")) & (F.col("p_pos") + F.col("lcp") == F.col("y")), "left")
        two = two.withColumn("k", _shared(F.col("hist1"), F.col("hist"), F.col("k") - 1)).withColumn("lcp", F.col("lcp") + step(F.col("k")))
        two = written(two.select("did", "pos", "p_did", "p_pos", "lcp", "k"), "longer")
        found, todo = found.unionByName(two.where("k < 2").select("did", "pos", "lcp")), two.where("k > 1")
    rows = every.drop("p_did", "p_pos", "k").join(found, ["did", "pos"], "left").withColumn("end", F.when(~F.col("reducible"), F.coalesce("lcp", F.lit(0)) + F.col("pos")))
    upto = W.partitionBy(*DOC).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = written(rows.withColumn("lcp", F.greatest(F.lit(0), F.last("end", ignorenulls=True).over(upto) - F.col("pos")).cast("int")).drop("end", "reducible"), "lcp")
    after = rows.select((F.col("sa") - 1).alias("sa"), F.col("lcp").alias("next_lcp"))
    return rows.join(after, "sa", "left").withColumn("next_lcp", F.coalesce("next_lcp", F.lit(0)))


def removed_runs(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """(doc_id, tkey, runs): disjoint [first, end) line runs of each document to delete, with longest, the most lines that a suffix in the run
    shares with another one, and copies, the most documents' places that share lines of it."""
    standing, others = documents(docs, min_lines)
    widths = [2**i for i in range(min_lines.bit_length()) if 2**i < min_lines] + [min_lines]
    array = with_lcp(suffixes(docs, standing))
    own = W.partitionBy(*DOC).orderBy("pos")
    cols = [F.sum("words").over(own.rowsBetween(0, w - 1)).alias(f"words{w}") for w in widths[:-1]]
    array = array.select("did", "pos", "copies", "sa", F.greatest("lcp", "next_lcp").alias("longest"), *cols, *((F.col("lcp") < w).cast("long").alias(f"new{w}") for w in widths))
    rows, spans = written(prefix_sums(array, {f"new{w}": f"interval{w}" for w in widths}, ["sa"]), "intervals"), None
    for w in widths:
        some = rows.where(F.col("longest") >= w)
        some = some if w >= min_lines else some.where(F.col(f"words{w}") >= min_words)
        some = some.withColumnRenamed(f"interval{w}", "interval").select("did", "pos", "copies", "longest", "interval")
        first = some.groupBy("interval").agg(F.min(F.struct("did", "pos")).alias("f"), F.sum("copies").alias("all"))
        later = some.join(written(first, "first"), "interval").where(F.struct("did", "pos") != F.col("f"))  # first was read back, so that the join can split a hot interval
        # a later copy that overlaps the first one in its own document loses only what lies beyond it
        start = F.when(F.col("did") == F.col("f.did"), F.greatest(F.col("pos"), F.col("f.pos") + w)).otherwise(F.col("pos"))
        found = later.select("did", start.alias("a"), (F.col("pos") + w).alias("b"), "longest", "all").where("a < b")
        spans = found if spans is None else spans.unionByName(found)
    by = W.partitionBy(*DOC).orderBy("a", "b")
    spans = spans.withColumn("reach", F.max("b").over(by.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(by))
    runs = spans.groupBy(*DOC, "run").agg(F.min("a").alias("first"), F.max("b").alias("end"), F.max("longest").alias("longest"), F.max("all").alias("copies"))
    runs = runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "end", "longest", "copies"))).alias("runs"))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("end"), F.col("n").alias("longest"), F.lit(None).cast("long").alias("copies")))
    return standing.join(runs, DOC).select("doc_id", "tkey", "runs").unionByName(others.select("doc_id", "tkey", whole.alias("runs")))


def _kept_lines(lines: Column, runs: Column) -> Column:
    """lines without the runs: the slices between them."""
    n, runs = F.size(lines), F.transform(runs, lambda r: F.struct(r["first"].alias("first"), r["end"].alias("end")))
    bounds = F.concat(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("end"))), runs, F.array(F.struct(n.alias("first"), n.alias("end"))))
    gaps = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.slice(lines, F.element_at(bounds, i)["end"] + 1, F.element_at(bounds, i + 1)["first"] - F.element_at(bounds, i)["end"]))
    return F.flatten(gaps)


def deduplicated_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """doc_id, text without the deleted runs, n_lines, n_removed, runs (array of first, end, longest, copies) for every row of docs.

    Documents stand in the order of doc_id, nulls last, then of the text's digest. Runs of min_lines equal lines or more, and of 1, 2, 4 .. lines with min_words
    words or more, are deleted wherever they occur again; shorter repeats stay. A null text has no lines and stays null; an empty text is one empty line. Rows that repeat a doc_id and text are one document and get
    equal answers. A text of any length is read as a whole. An empty table gives no rows. Other columns, whatever their names, are not read."""
    runs = removed_runs(docs, min_lines, min_words).alias("r")
    d = _keyed(docs.select("doc_id", "text")).alias("d")
    got = d.join(runs, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.tkey") == F.col("r.tkey")), "left").select("d.doc_id", "d.text", "r.runs")
    lines = F.split("text", "\n")
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["end"] - r["first"]), F.lit(0)).cast("long")
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(lines, F.col("runs")), "\n"))
    return got.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_lines"), gone.alias("n_removed"), "runs")
