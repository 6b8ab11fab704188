"""Mixing sources to target weights by entropy balancing (native DataFrame code).

Among all document rates r with sum(r * size) = target in each source, the ones of least relative
entropy to 1 are r = exp(lambda * size), here kept at most `most` (3). The dual is convex and
splits by source; its Newton steps need only sums over (source, size) counts, so documents are
counted once. A step is one aggregation of that histogram: every task adds up its own rows, a row a source
is shuffled, and the new lambdas are written for the next step, until all sources meet their targets. Sums are
of decimals, so the order of adding changes nothing and reruns agree to the last bit. Rates become
copies by floor plus a hashed draw; one threshold a source, read off prefix sums over a histogram of the draws,
brings the copies' words to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import n_words, uniform, written
from reelspark.operators.ranks import prefix_sums, row_numbers

BINS = 1 << 16
EDGE = 1e6
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """sizes (source, source_size, ...): adds target. Sources by code point, null last, take the weights in turn; shares of
    the whole stop at `most` times a source's size, and the excess goes to the others by weight. One row a source; sources are ordered and summed in range partitions."""
    turn = F.array(*map(F.lit, weights))
    s = row_numbers(sizes, F.col("source").asc_nulls_last(), name="turn").withColumn("w", F.element_at(turn, (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    every = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("weight"))
    s = prefix_sums(s, {"cap": "cap_upto", "w": "w_upto"}, ["full_at", "turn"]).crossJoin(F.broadcast(every))
    s = s.withColumn("level", (F.col("total") - F.col("cap_upto") + F.col("cap")) / (F.col("weight") - F.col("w_upto") + F.col("w")))
    # a source is full if its own cap comes before the level that the sources still open share
    s = written(s.withColumn("is_full", F.col("full_at") <= F.col("level")), "levels")
    level = s.where("not is_full").agg(F.min_by("level", F.struct("full_at", "turn")).alias("open_level"))
    target = F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("w") * F.col("open_level"))
    return s.crossJoin(F.broadcast(level)).select(*sizes.columns, target.alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    return F.when(lam >= EDGE, F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(lam * x, F.lit(50.0)))))


def _small(t: DataFrame, rows: int) -> DataFrame:
    """A table of a row a source: broadcast up to BROADCAST_SOURCES rows, so that a hot source's rows stay where they are; beyond, the adaptive join splits hot sources."""
    return F.broadcast(t) if rows <= BROADCAST_SOURCES else t


def _kept(t: DataFrame, rows: int, label: str) -> DataFrame:
    """A table of a row a source, made once: on the driver up to BROADCAST_SOURCES rows, which are broadcast in any case, else in the shared folder."""
    return t.sparkSession.createDataFrame(t.toArrow()) if rows <= BROADCAST_SOURCES else written(t, label)


def solve(counts: DataFrame, goal: DataFrame, most: float = 3.0, steps: int = 100, close: float = 1e-9) -> DataFrame:
    """counts (source, size, n), goal (source, source_size, n_docs, target): goal with lam, the tilt of each source, and unit, so that a rate is
    exp(lam * unit * size) up to `most`. Guarded Newton steps on the logarithm, until each source is within `close` of its target; an error after `steps`."""
    exact = lambda c: F.sum(c.cast("decimal(38, 12)"))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    unit = F.coalesce(F.try_divide(F.col("n_docs").cast("double"), F.col("source_size")), F.lit(0.0))
    state = goal.withColumn("unit", unit).withColumn("lam", F.when(full, F.lit(EDGE)).otherwise(F.lit(0.0))).withColumn("lo", F.lit(-EDGE)).withColumn("hi", F.lit(EDGE))
    rows, tokens, x = goal.count(), F.col("n") * F.col("size"), F.col("size") * F.col("unit")
    state = _kept(state.withColumn("done", full | (F.col("source_size") <= 0)), rows, "tilts")
    for _ in range(steps):
        if state.where("not done").isEmpty():
            return state.select(*goal.columns, "lam", "unit")
        todo = state.where("not done").select(F.col("source").alias("__source"), "lam", "unit")
        e = _rate(F.col("lam"), x, most)
        sums = counts.where("size > 0").join(_small(todo, rows), F.col("source").eqNullSafe(F.col("__source")))
        sums = sums.groupBy("__source").agg(exact(tokens * e).cast("double").alias("f"), exact(F.when(e < most, tokens * x * e).otherwise(0.0)).cast("double").alias("slope"))
        s = state.join(sums, state["source"].eqNullSafe(sums["__source"]) & ~state["done"], "left").drop("__source")
        short = F.col("f") < F.col("target")
        lo, hi = F.when(short, F.col("lam")).otherwise(F.col("lo")), F.when(short, F.col("hi")).otherwise(F.col("lam"))
        s = s.withColumn("lo", F.when(F.col("done"), F.col("lo")).otherwise(lo)).withColumn("hi", F.when(F.col("done"), F.col("hi")).otherwise(hi))
        step = F.col("lam") + F.log(F.try_divide("target", "f")) * F.try_divide("f", "slope")
        middle = F.when(F.col("hi") >= EDGE, F.abs(F.col("lo")) * 2 + 1).when(F.col("lo") <= -EDGE, -F.abs(F.col("hi")) * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")), F.lit(False))
        met = F.col("done") | (F.abs(F.col("f") - F.col("target")) <= F.col("target") * close) | (F.col("hi") - F.col("lo") <= F.abs(F.col("lam")) * 1e-15)
        s = s.withColumn("met", met).withColumn("lam", F.when(F.col("met"), F.col("lam")).when(inside, step).otherwise(middle))
        state = _kept(s.select(*goal.columns, "unit", "lam", "lo", "hi", F.col("met").alias("done")), rows, "tilts")
    raise RuntimeError(f"no tilts within {close} of the targets after {steps} steps for {state.where('not done').count()} sources")


def _extra_bin(seed: int, rate: Column, key: Column) -> Column:
    """Bin of the draw for one more copy, from 0: the smaller, the sooner; null where no copy may be added."""
    z = uniform(seed, key) - (rate - F.floor(rate))
    return F.floor((z + 1) * (BINS // 2)).cast("int")


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """sized (doc_id, source, size), read several times: one row a source with source_size, target, lam, unit, last_bin."""
    counts = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"))
    plan = solve(counts, written(targets(written(sizes, "sources"), weights, most), "targets"), most)
    sources = plan.count()
    rated = with_rate(sized, plan, most)
    whole = F.col("size") * F.floor("rate")
    bins = rated.groupBy(F.col("source"), F.when((F.col("rate") < most) & (F.col("size") > 0), _extra_bin(seed, F.col("rate"), F.col("doc_id"))).alias("bin"))
    bins = written(bins.agg(F.sum("size").alias("tokens"), F.sum(whole).alias("whole")), "bins")
    sums = bins.groupBy("source").agg(F.sum("whole").alias("whole"))
    need = plan.join(sums, plan["source"].eqNullSafe(sums["source"])).select(plan["source"].alias("__source"), (F.col("target") - F.col("whole")).alias("need"))
    upto = prefix_sums(bins.where("bin is not null").select("source", "bin", "tokens"), {"tokens": "upto"}, ["bin"], ["source"])
    taken = upto.join(_small(need, sources), F.col("source").eqNullSafe(F.col("__source"))).where(F.col("upto") - F.col("tokens") / 2 <= F.col("need"))
    last = taken.groupBy("__source").agg(F.max("bin").alias("last_bin"))
    done = plan.join(last, plan["source"].eqNullSafe(last["__source"]), "left")
    return _kept(done.select(plan["*"], F.coalesce("last_bin", F.lit(-1)).alias("last_bin")), sources, "plan")


def with_rate(sized: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Adds the plan's columns and rate to rows with source and size."""
    p = _small(plan.withColumnRenamed("source", "__source"), plan.count())
    rate = F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("unit") * F.col("size"), most)).otherwise(F.lit(1.0))
    return sized.join(p, sized["source"].eqNullSafe(p["__source"]), "left").drop("__source").withColumn("rate", rate)


def apply_mix(sized: DataFrame, plan: DataFrame, most: float = 3.0, seed: int = 7) -> DataFrame:
    """Adds rate and copies (0 to `most`) to rows with doc_id, source and size."""
    rated = with_rate(sized, plan, most)
    more = (F.col("rate") < most) & (F.col("size") > 0) & (_extra_bin(seed, F.col("rate"), F.col("doc_id")) <= F.col("last_bin"))
    return rated.withColumn("copies", (F.floor("rate") + F.coalesce(more.cast("int"), F.lit(0))).cast("int"))


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, rate, copies and taken = copies * size.

    Null, empty and blank texts have size 0 and are taken as they are, with one copy and no words; a text of any length counts as a whole. A null
    source is a source. Repeated rows get the same number of copies, rows without doc_id in one source too; reruns agree, as draws hash doc_id. An empty
    table gives no rows. Columns of other names, whatever they are, are not read."""
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    got = apply_mix(sized, plan_mix(sized, weights, most, seed), most, seed)
    return got.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as its copies, with the columns of docs, whatever their names; rows as in mix_sizes()."""
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    plan = plan_mix(sized, weights, most, seed)
    own = docs.select(F.struct("*").alias("__doc"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    got = apply_mix(own, plan, most, seed).where("copies > 0")
    return got.select("__doc", F.explode(F.sequence(F.lit(1), "copies")).alias("__copy")).select("__doc.*")
