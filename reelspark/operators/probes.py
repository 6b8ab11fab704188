"""Linear probes and batch inference (M2 to M6, M8). Models are fitted by Spark ML on distributed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.operators import joins, labels, metrics, splits, vectors
from reelspark.operators.ranks import best_run, row_numbers
from reelspark.sources.work import written


def _featured(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(col).cast("array<double>")))


def fit_classifier(df: DataFrame, c: float = 1.0, balanced: bool = True, col: str = "embedding", target: str = "target", weights: DataFrame | None = None) -> LogisticRegressionModel:
    """L2 logistic probe: the minimum of c * sum(weight * loss) + |w|^2 / 2, intercept free. M2.

    Spark divides the loss by the sum of weights, so its penalty is 1 / (c * that sum)."""
    data = _featured(df, col)
    if weights is None and balanced:
        weights = metrics.class_weights(df, "balanced", target).select(target, "weight")
    data = data.join(F.broadcast(weights), target) if weights is not None else data.withColumn("weight", F.lit(1.0))  # a row a class
    total = data.agg(F.sum("weight").alias("w")).first().w
    model = LogisticRegression(labelCol=target, weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10)
    return model.fit(data)


def classify(model: LogisticRegressionModel, df: DataFrame, col: str = "embedding") -> DataFrame:
    """Adds probs, score (probability of class 1 of two) and pred."""
    out = model.transform(_featured(df, col)).withColumn("probs", vector_to_array("probability"))
    return out.withColumn("score", F.element_at("probs", 2)).withColumn("pred", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def fit_ridge(df: DataFrame, alpha: float = 1.0, col: str = "embedding", target: str = "target") -> LinearRegressionModel:
    """Ridge probe: the minimum of |y - Xw - b|^2 + alpha |w|^2. M3.

    Spark scales the label by its deviation before it adds the penalty, hence the population deviation in regParam."""
    s = df.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("sd")).first()
    model = LinearRegression(labelCol=target, solver="normal", regParam=alpha * (s.sd or 0.0) / s.n, elasticNetParam=0.0, standardization=False)
    return model.fit(_featured(df, col))


def regress(model: LinearRegressionModel, df: DataFrame, col: str = "embedding") -> DataFrame:
    """Adds pred."""
    return model.transform(_featured(df, col)).withColumn("pred", F.col("prediction")).drop("features", "prediction")


@dataclass
class RidgePath:
    """Ridge probes of several alphas: a row of weights and an intercept each."""

    alphas: Sequence[float]
    weights: np.ndarray
    intercepts: np.ndarray

    def errors(self, df: DataFrame, col: str = "embedding", target: str = "target") -> DataFrame:
        """(position, mae) of each alpha, in one pass over the rows that have a vector and a target."""
        weights, intercepts = self.weights, self.intercepts

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(weights)), 0
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                total += np.abs(x @ weights.T + intercepts - batch.column(1).to_numpy()[:, None]).sum(axis=0)
                n += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], ["position", "total", "n"])

        rows = df.select(F.col(col).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).dropna()
        parts = rows.mapInArrow(sums, "position int, total double, n long")
        return parts.groupBy("position").agg((F.sum("total") / F.sum("n")).alias("mae"))


def ridge_path(df: DataFrame, alphas: Sequence[float], col: str = "embedding", target: str = "target") -> RidgePath:
    """fit_ridge() for every alpha from one pass: one Gram matrix of vectors and target, centred, and its one eigendecomposition. M3, M4.

    What the driver gets is D + 3 rows of D + 1 numbers. Rows without a vector or target are left out."""
    both = df.select(F.col(col).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).dropna().select(F.array_append("x", F.col("y")).alias("xy"))
    n, sums, g = vectors.gram(both, "xy")
    if not n:
        raise ValueError("no rows to fit")
    mean = sums / n
    g = g - n * np.outer(mean, mean)
    values, axes = np.linalg.eigh(g[:-1, :-1])
    turned = axes.T @ g[:-1, -1]
    shrunk = np.clip(values, 0, None)[None, :] + np.asarray(alphas, float)[:, None]
    coefficients = np.divide(turned, shrunk, out=np.zeros_like(shrunk), where=shrunk > 1e-12 * max(1e-300, values[-1]))
    weights = coefficients @ axes.T
    return RidgePath(tuple(alphas), weights, mean[-1] - weights @ mean[:-1])


def grid_probe(train: DataFrame, val: DataFrame, grid: Sequence[float], kind: str = "classification", col: str = "embedding", target: str = "target") -> tuple[float, DataFrame]:
    """(winner, (position, param, value)): the first best of a grid of C (accuracy) or alpha (mae) on validation rows. M4.

    All alphas share one pass over train and one over val."""
    rows = []
    if kind != "classification":
        rows = [(r.position, float(grid[r.position]), r.mae) for r in ridge_path(train, grid, col, target).errors(val, col, target).orderBy("position").collect()]  # a row an alpha
    else:
        inverse = metrics.class_weights(train, "inverse", target).select(target, "weight")
        for i, g in enumerate(grid):
            got = classify(fit_classifier(train, g, col=col, target=target, weights=inverse), val, col).withColumn("y", F.col(target))
            rows.append((i, float(g), float(metrics.classification_metrics(got).first().accuracy)))
    table = train.sparkSession.createDataFrame(rows, "position int, param double, value double")
    return best_run(table, "value", "position", "max" if kind == "classification" else "min").first().param, table


def grid_heads(
    train: DataFrame, val: DataFrame, rates: Sequence[float], decays: Sequence[float], epochs: int = 20, kind: str = "classification", col: str = "embedding", target: str = "target"
) -> tuple[dict, DataFrame]:
    """(winner, (position, rate, decay, epoch, value)): linear heads trained by gradients for each learning rate and weight decay, all in the same passes.
    A row has a head's first epoch of the best validation value (accuracy, or mae for kind 'regression'); the winner is the first best row. M4.

    An epoch is one step of Adam with decoupled decay on the whole of train, classes weighted by inverse counts. Tasks add up the heads' gradients and validation sums;
    a row a head comes back. Targets are classes 0 .. K-1, or numbers."""
    spark, regression = train.sparkSession, kind == "regression"
    both = train.select(col, target, F.lit(1).alias("fit")).unionByName(val.select(col, target, F.lit(0).alias("fit")))
    rows = written(both.select(F.col(col).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), "fit").dropna(), "heads")
    dim = rows.select(F.size("x").alias("d")).first().d
    weight = np.ones(1) if regression else np.zeros(int(rows.agg(F.max("y").alias("k")).first().k) + 1)
    if not regression:
        for r in metrics.class_weights(rows.where("fit = 1"), "inverse", "y").select("y", "weight").collect():  # a row a class
            weight[int(r.y)] = r.weight
    grid, k = [(a, b) for a in rates for b in decays], len(weight)
    heads = np.zeros((len(grid), dim + 1, k))
    first, second, best = np.zeros_like(heads), np.zeros_like(heads), [(0, -np.inf)] * len(grid)
    for epoch in range(epochs + 1):
        sent = spark.sparkContext.broadcast(heads)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now = sent.value
            total = np.zeros((len(now), now[0].size + 3))  # gradient; weight, validation value and rows
            for batch in batches:
                x = np.c_[batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), np.ones(len(batch))]
                y, fit = batch.column(1).to_numpy(), batch.column(2).to_numpy() == 1
                for g, w in enumerate(now):
                    out = x @ w
                    if regression:
                        error, value, own = out - y[:, None], -np.abs(out[:, 0] - y), np.ones(len(y))
                    else:
                        p = np.exp(out - out.max(axis=1, keepdims=True))
                        error, value, own = p / p.sum(axis=1, keepdims=True), out.argmax(axis=1) == y, weight[y.astype(int)]
                        error[np.arange(len(y)), y.astype(int)] -= 1
                    own = own * fit
                    total[g] += np.r_[(x.T @ (error * own[:, None])).ravel(), own.sum(), value[~fit].sum(), (~fit).sum()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["g", "v"])

        got = rows.mapInArrow(sums, "g int, v array<double>").groupBy("g").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
        sent.unpersist()
        for r in got:
            v, g = r.v.toArray(), r.g
            if epoch and v[-2] / max(1.0, v[-1]) > best[g][1]:
                best[g] = epoch, v[-2] / max(1.0, v[-1])
            grad = v[:-3].reshape(dim + 1, k) / max(v[-3], 1e-12)
            first[g], second[g] = 0.9 * first[g] + 0.1 * grad, 0.999 * second[g] + 0.001 * grad * grad
            step = first[g] / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(second[g] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
            heads[g] -= grid[g][0] * (step + grid[g][1] * heads[g])
    sign = -1.0 if regression else 1.0
    table = spark.createDataFrame([(i, float(a), float(b), best[i][0], float(sign * best[i][1])) for i, (a, b) in enumerate(grid)], "position int, rate double, decay double, epoch int, value double")
    return best_run(table, "value", "position", "min" if regression else "max").first().asDict(), table


@dataclass
class Task:
    """name; kind: binary, multiclass or regression; positives of a binary task."""

    name: str
    kind: str
    desc: str = ""
    positives: Sequence[str] = field(default_factory=tuple)


def run_task(task: Task, labelled: DataFrame, emb: DataFrame, key: str = "study", fraction: float = 1.0, replicates: int = 0, seed: int = 42) -> DataFrame | None:
    """A long report (task, split, metric, value, lower, upper, n_train, n_fit) of one probe, or None without train or test rows. M5.

    labelled: (study, label, split in TRAIN, VAL, TEST); emb: (study, embedding), several rows a study are pooled."""
    data = joins.labelled_embeddings(vectors.mean_pool(emb, key), labelled, key)
    if task.kind == "binary":
        data = labels.binary_target(data, task.positives)
    elif task.kind == "multiclass":
        codes = labels.label_codes(data)
        data = labels.encode_labels(data, codes).withColumnRenamed("code", "target")
    else:
        data = data.withColumn("target", F.col("label").cast("double"))
    data = written(row_numbers(data, key, name="row"), "task")
    train, n_train = data.where("split = 'TRAIN'"), data.where("split = 'TRAIN'").count()
    if not n_train or not data.where("split = 'TEST'").count():
        return None
    fit_rows = splits.take_fraction(train, fraction, seed, key) if fraction < 1 else train
    stats = vectors.vector_stats(fit_rows)
    fit_rows, data = vectors.standardize(fit_rows, stats), vectors.standardize(data, stats)
    regression = task.kind == "regression"
    model = fit_ridge(fit_rows) if regression else fit_classifier(fit_rows)
    got = (regress(model, data) if regression else classify(model, data)).withColumn("y", F.col("target"))
    out = None
    for split in ("VAL", "TEST"):
        rows = row_numbers(got.where(F.col("split") == split).drop("row"), key, name="row")
        if not rows.limit(1).count():
            continue
        if regression:
            names, metric = ["mae", "rmse", "r2", "pearson"], metrics.regression_metrics
        elif task.kind == "binary":
            names = ["accuracy", "precision", "recall", "f1", "auc"]
            metric = _with_auc
        else:
            names, metric = ["accuracy", "precision", "recall", "f1"], metrics.classification_metrics
        one = metrics.bootstrap_ci(rows, metric, names, max(1, replicates), seed=seed) if replicates else _points(metric(rows), names)
        one = one.select(F.lit(task.name).alias("task"), F.lit(split).alias("split"), "metric", "value", "lower", "upper", F.lit(n_train).alias("n_train"), F.lit(fit_rows.count()).alias("n_fit"))
        out = one if out is None else out.unionByName(one)
    return out


def _with_auc(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    a, b = metrics.classification_metrics(df, "binary", by, weight), metrics.roc_auc(df, by, weight)
    return a.join(b, list(by), "left") if by else a.crossJoin(F.broadcast(b))


def _points(row: DataFrame, names: Sequence[str]) -> DataFrame:
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.col(n).cast("double").alias("lower"), F.col(n).cast("double").alias("upper")) for n in names))))


def embed(df: DataFrame, make_predict_fn: Callable, clip: str = "clip", key: str = "id", batch: int = 128) -> DataFrame:
    """(id, embedding): the encoder's vectors of an item's clips, averaged. make_predict_fn() returns a function from a batch of arrays to a matrix. M6."""
    f = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return vectors.mean_pool(df.withColumn("embedding", f(F.col(clip))), key)


def hashing_encoder(dim: int = 16) -> Callable:
    """A deterministic encoder for tests: byte counts of a clip's text folded into `dim` buckets."""

    def make():
        def predict(texts):
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                raw = np.frombuffer(str(t).encode(), np.uint8)
                np.add.at(out[i], raw % dim, 1)
            return out

        return predict

    return make


def vote_clips(df: DataFrame, key: str = "id", pred: str = "pred", mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """The mean prediction of an item's clips, turned back from z-scores. M8."""
    return df.groupBy(key).agg((F.avg(pred) * std + mean).alias(pred))
