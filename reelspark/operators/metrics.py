"""Metrics of predictions.

Every metric takes the columns to group by and an optional weight column and returns a row a group, so one
definition serves the point estimate (no group) and the bootstrap (grouped by replicate, weighted by draws).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.functions.columns import erfc, hash_int, softmax
from reelspark.operators.ranks import avg_rank, curve

By = Sequence[str]


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def _ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(other))


def class_counts(df: DataFrame, *cols: str) -> DataFrame:
    """A1."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, kind: str = "balanced", col: str = "label") -> DataFrame:
    """A weight a class: 'inverse' is 1 / (count + 1e-6) scaled to sum to C, 'balanced' n / (C * count). A2."""
    c = df.groupBy(col).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row a class
    if kind == "balanced":
        return c.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
    inverse = 1 / (F.col("n") + 1e-6)
    return c.withColumn("weight", inverse / F.sum(inverse).over(every) * F.count("*").over(every))


def label_stats(df: DataFrame, col: str = "label") -> DataFrame:
    """Mean, population std, min, max and n, one row. A3."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))


def confusion(df: DataFrame, classes: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """(y, pred, n, share) over the whole grid of classes; share is by row, with 1e-10 added to its sum. A5."""
    spark = df.sparkSession
    grid = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("y"), F.pmod("id", F.lit(classes)).cast("int").alias("pred"))
    counts = df.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    out = grid.join(counts, ["y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("share", F.col("n") / (F.sum("n").over(W.partitionBy("y")) + 1e-10))


def class_report(df: DataFrame, classes: int | None = None, by: By = (), weight: str | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """A row a class: tp, fp, fn, tn, support, precision, recall, f1, specificity. Classes are those in truth or
    prediction, or 0 .. classes-1. Zero divisions give 0. A6, A8."""
    counts = df.groupBy(*by, F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.sum(_w(weight)).alias("n"))
    both = counts.select(*by, "y", "pred", "n", F.explode(F.array_distinct(F.array("y", "pred"))).alias("class"))
    t = both.groupBy(*by, "class").agg(
        F.sum(F.when((F.col("y") == F.col("class")) & (F.col("pred") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") != F.col("class")) & (F.col("pred") == F.col("class")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == F.col("class")) & (F.col("pred") != F.col("class")), F.col("n")).otherwise(0)).alias("fn"),
    )
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    if classes is not None:
        grid = total.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
        t = grid.join(t, [*by, "class"], "left").fillna(0, ["tp", "fp", "fn"])
    else:
        t = t.join(total, list(by)) if by else t.crossJoin(F.broadcast(total))
    tn = F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")
    t = t.withColumn("tn", tn).withColumn("support", F.col("tp") + F.col("fn"))
    t = t.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    t = t.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return t.withColumn("specificity", _ratio(F.col("tn"), F.col("tn") + F.col("fp")))


def classification_metrics(df: DataFrame, average: str = "macro", by: By = (), weight: str | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """accuracy, precision, recall, f1: of class 1 ('binary') or the mean over classes in truth or prediction ('macro'). A6."""
    w = _w(weight)
    acc = df.groupBy(*by).agg((F.sum(w * (F.col(y) == F.col(pred)).cast("int")) / F.sum(w)).alias("accuracy"))
    if average == "binary":
        r = class_report(df, 2, by, weight, y, pred).where("class = 1").select(*by, "precision", "recall", "f1")
    else:
        r = class_report(df, None, by, weight, y, pred).groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    return acc.join(r, list(by)) if by else acc.crossJoin(F.broadcast(r))


def balanced_accuracy(df: DataFrame, by: By = (), weight: str | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean recall over the classes in truth. A7."""
    return class_report(df, None, by, weight, y, pred).where("support > 0").groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def specificity(df: DataFrame, classes: int = 2, by: By = (), weight: str | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """tn / (tn + fp): of class 1 for two classes, else the mean over all classes, 0 where undefined. A8."""
    r = class_report(df, classes, by, weight, y, pred)
    return (r.where("class = 1") if classes == 2 else r).groupBy(*by).agg(F.avg("specificity").alias("specificity"))


def _area(cols: Column, c: DataFrame, by: By, name: str) -> DataFrame:
    return c.groupBy(*by).agg(cols.alias(name))


def roc_auc(df: DataFrame, by: By = (), weight: str | None = None, score: str = "score", y: str = "y", name: str = "auc") -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class only. A9."""
    c = curve(df, score, y, weight, list(by))
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return _area(F.when((p > 0) & (n > 0), won / (p * n)), c, by, name)


def average_precision(df: DataFrame, by: By = (), weight: str | None = None, score: str = "score", y: str = "y", name: str = "ap") -> DataFrame:
    """Sum of precision over the steps of recall; null without positives. A10."""
    c = curve(df, score, y, weight, list(by)).where("tp + fp > 0")
    p = F.sum("pos")
    return _area(F.when(p > 0, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p), c, by, name)


def auprc_trapezoid(df: DataFrame, by: By = (), weight: str | None = None, score: str = "score", y: str = "y", name: str = "auprc") -> DataFrame:
    """Trapezoids under the precision-recall curve, points in the order of falling thresholds after (recall 0, precision 1). A11."""
    c = curve(df, score, y, weight, list(by)).where("tp + fp > 0").withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    # the point before has this one's counts taken away
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    p = F.sum("pos")
    return _area(F.when(p > 0, F.sum(F.col("pos") * (F.col("precision") + before) / 2) / p), c, by, name)


def one_vs_rest(df: DataFrame, probs: str = "probs", y: str = "y") -> DataFrame:
    """A row per row and class: class, score, hit (1 for the true class); columns of these names are replaced."""
    return df.drop("class", "score", "hit").select("*", F.posexplode(probs).alias("class", "score")).withColumn("hit", (F.col(y) == F.col("class")).cast("int"))


def macro(metric: Callable[..., DataFrame], df: DataFrame, name: str, by: By = (), weight: str | None = None, probs: str = "probs", y: str = "y", need_all: bool = True) -> DataFrame:
    """The mean of a binary metric over classes, one against the rest; null if it is undefined for a class (need_all)."""
    per = metric(one_vs_rest(df, probs, y), [*by, "class"], weight, "score", "hit", name=name)
    value = F.when(F.count(F.col(name)) == F.count("*"), F.avg(name)) if need_all else F.avg(name)
    return per.groupBy(*by).agg(value.alias(name))


def confidence(df: DataFrame, probs: str | None = None, score: str | None = None, from_logits: bool = True, y: str = "y") -> DataFrame:
    """Adds conf and correct: the largest probability and whether it is the true class's; for scores p or 1 - p after clipping to [0, 1]."""
    if probs:
        p = softmax(F.col(probs)) if from_logits else F.col(probs)
        out = df.withColumn("__p", p)
        return out.withColumn("conf", F.array_max("__p")).withColumn("correct", (F.array_position("__p", F.array_max("__p")) - 1 == F.col(y)).cast("int")).drop("__p")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score)))
    pred = (p >= 0.5).cast("int")
    return df.withColumn("conf", F.when(pred == 1, p).otherwise(1 - p)).withColumn("correct", (pred == F.col(y)).cast("int"))


def ece(df: DataFrame, n_bins: int = 15, by: By = (), weight: str | None = None) -> DataFrame:
    """Expected calibration error of conf and correct over equal bins, the first closed on the left, the others (lo, hi]. A12."""
    w = _w(weight)
    b = F.greatest(F.lit(1), F.ceil(F.col("conf") * n_bins)).cast("int")
    bins = df.groupBy(*by, b.alias("bin")).agg(F.sum(w).alias("n"), F.sum(w * F.col("conf")).alias("conf"), F.sum(w * F.col("correct")).alias("hits"))
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("hits") - F.col("conf"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, by: By = (), weight: str | None = None, probs: str | None = None, score: str | None = None, y: str = "y") -> DataFrame:
    """Mean squared error of probabilities: summed over classes, or of a binary score. A13."""
    if probs:
        one = F.transform(F.col(probs), lambda p, i: F.pow(p - (i == F.col(y)).cast("double"), F.lit(2.0)))
        err = F.aggregate(one, F.lit(0.0), lambda s, x: s + x)
    else:
        err = F.pow(F.col(score) - F.col(y), F.lit(2.0))
    return df.groupBy(*by).agg((F.sum(_w(weight) * err) / F.sum(_w(weight))).alias("brier"))


def accuracy_pvalue(df: DataFrame, classes: int = 2, by: By = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Two-sided z-test of accuracy against 1 / classes; NaN for no rows. A14."""
    null = 1.0 / classes
    a = df.groupBy(*by).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("acc"), F.count("*").alias("n"))
    z = (F.col("acc") - null) / F.sqrt(F.lit(null * (1 - null)) / F.col("n"))
    return a.withColumn("__z", F.when(F.col("n") > 0, F.abs(z) / F.sqrt(F.lit(2.0)))).withColumn("p_value", F.coalesce(erfc("__z"), F.lit(float("nan")))).drop("__z", "acc", "n")


def regression_metrics(df: DataFrame, by: By = (), weight: str | None = None, y: str = "y", pred: str = "pred", safe: bool = True, eps: float = 0.0) -> DataFrame:
    """mae, rmse, r2, pearson; safe: 0 where undefined, else null. eps is added to denominators. A15."""
    w, a, b = _w(weight), F.col(y).cast("double"), F.col(pred).cast("double")
    m = df.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * F.abs(a - b)).alias("ae"), F.sum(w * (a - b) * (a - b)).alias("se"),
        F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n")
    va, vb, cab = F.col("saa") - F.col("sa") ** 2 / n, F.col("sbb") - F.col("sb") ** 2 / n, F.col("sab") - F.col("sa") * F.col("sb") / n
    r2, r = F.when(va + eps > 0, 1 - F.col("se") / (va + eps)), F.when((va > 0) & (vb > 0), cab / (F.sqrt(va * vb) + eps))
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if safe else (lambda c: c)
    return m.select(*by, (F.col("ae") / n).alias("mae"), F.sqrt(F.col("se") / n).alias("rmse"), fill(r2).alias("r2"), fill(r).alias("pearson"))


def spearman(df: DataFrame, y: str = "y", pred: str = "pred", by: By = ()) -> DataFrame:
    """Pearson correlation of average ranks. A16."""
    ranked = avg_rank(avg_rank(df, y, "__ry", list(by)), pred, "__rp", list(by))
    return ranked.groupBy(*by).agg(F.corr("__ry", "__rp").alias("spearman"))


def draws(df: DataFrame, replicates: int, seed: int = 42, key: str = "row") -> DataFrame:
    """(replicate, row, weight): how often each row 1 .. n is drawn in each bootstrap replicate of n draws. A17.

    A draw is a portable hash of (seed, replicate, draw number); all metrics share the table. It makes replicates * n draws: poisson_draws() is for large tables."""
    n = df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("n")).first().n
    every = df.sparkSession.range(replicates * n).select(F.floor(F.col("id") / max(1, n)).alias("replicate"), (F.pmod("id", F.lit(max(1, n))) + 1).alias("draw"))
    return every.groupBy("replicate", (F.pmod(hash_int(seed, F.col("replicate"), F.col("draw")), F.lit(n)) + 1).alias(key)).agg(F.count("*").alias("weight"))


def poisson_draws(df: DataFrame, replicates: int, seed: int = 42, key: str = "row") -> DataFrame:
    """As draws(), with independent Poisson(1) weights: no count of rows and no shuffle, for large tables."""
    u = hash_int(seed, F.col("replicate"), F.col(key)) / F.lit(float(1 << 32))
    # the number of Poisson(1) steps below the draw; 12 more would have a chance of 1e-10
    total, term, weight = 0.0, 2.718281828459045**-1, None
    for i in range(13):
        total += term
        weight = F.when(u < total, F.lit(i)) if weight is None else weight.when(u < total, F.lit(i))
        term /= i + 1
    out = df.select(key).withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    return out.withColumn("weight", weight.otherwise(F.lit(13))).where("weight > 0")


def bootstrap_ci(df: DataFrame, metric: Callable[..., DataFrame], values: Sequence[str], replicates: int = 1000, level: float = 0.95, seed: int = 42, key: str = "row", weights: DataFrame | None = None) -> DataFrame:
    """(metric, value, lower, upper) of each of the metric's columns: the point from all rows, percentile bounds from the
    replicates in which it is defined. df has its rows numbered 1 .. n in `key`. No replicate: (point, point). A17, M9."""
    w = weights if weights is not None else draws(df, replicates, seed, key)
    reps = metric(df.join(w, key), ["replicate"], "weight")
    point = metric(df, [], None)
    out = []
    for v in values:
        p = F.percentile(v, [(1 - level) / 2, (1 + level) / 2])
        bounds = reps.where(F.col(v).isNotNull() & ~F.isnan(v)).agg(p.alias("p"))
        one = point.select(F.col(v).cast("double").alias("value")).crossJoin(F.broadcast(bounds))
        out.append(one.select(F.lit(v).alias("metric"), "value", F.coalesce(F.col("p")[0], "value").alias("lower"), F.coalesce(F.col("p")[1], "value").alias("upper")))
    return reduce(DataFrame.unionByName, out)


def calibrate_threshold(df: DataFrame, metric: str = "f1", score: str = "score", y: str = "y") -> DataFrame:
    """(threshold, value): of 0.01 .. 0.99 the first with the largest f1, accuracy, precision or recall; (0.5, 0.0) if none is above 0. A18.

    Rows are counted by the number of thresholds they reach, so at most 100 rows meet."""
    ts = F.array(*(F.lit(i / 100) for i in range(1, 100)))
    reached = F.size(F.filter(ts, lambda t: F.col(score) >= t))
    h = df.groupBy(reached.alias("reached")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    at = df.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(h))
    hit = F.col("reached") >= F.col("i")
    m = at.groupBy("i").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    value = {
        "f1": _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), "accuracy": _ratio(F.col("tp") + F.col("n") - F.col("fp"), F.col("p") + F.col("n")),
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("p")),
    }[metric]
    m = m.withColumn("value", value.cast("double")).where("value > 0")
    best = m.agg(F.max_by(F.struct((F.col("i") / 100).alias("threshold"), "value"), F.struct("value", -F.col("i"))).alias("b"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"), F.coalesce(F.col("b.value"), F.lit(0.0)).alias("value"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin from 1, lo, hi, n) of equal bins between the least and largest value, the last closed; empty bins are left out. A27."""
    s = df.agg(F.min(col).cast("double").alias("lo0"), F.max(col).cast("double").alias("hi0"))
    width = (F.col("hi0") - F.col("lo0")) / bins
    b = F.when(F.col("hi0") > F.col("lo0"), F.least(F.lit(bins), F.floor((F.col(col) - F.col("lo0")) / width) + 1)).otherwise(F.lit(1)).cast("int")
    out = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(s)).groupBy(b.alias("bin"), "lo0", "hi0").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("lo0") + (F.col("bin") - 1) * width).alias("lo"), (F.col("lo0") + F.col("bin") * width).alias("hi"), "n")
