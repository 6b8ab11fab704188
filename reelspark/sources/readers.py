"""Scans (S1 to S8, S12 to S15)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.columns import clean_null, numeric
from reelspark.sources.bigjson import CHUNK_BYTES, json_records

# The study fields that are kept, as text.
STUDY_FIELDS = (
    "study_designation", "age_at_visit", "height", "height_units", "weight", "weight_units", "bmi", "ejection_fraction",
    "conditions", "characterizations", "stratifications", "left_ventricle_diastolic_diameter", "left_ventricle_systolic_diameter",
    "left_atrium_dimensions", "left_ventricle", "right_ventricle", "left_atrium", "right_atrium", "aortic_valve", "mitral_valve",
    "tricuspid_valve", "pulmonic_valve", "pericardium", "aortic_root", "aortic_arch", "pulmonary_artery", "conclusions",
)
MANIFEST_SCHEMA = "dicom_uuid string, study_uuid string, disk_path string, view string, type string, n_frames double, physical_delta_x double"


def read_annotations(spark: SparkSession, path: str, fields: Sequence[str] = STUDY_FIELDS, items: tuple[str, str, str] = ("dicoms", "dicom_uuid", "type"), studies: tuple[str, str] = ("studies", "study_uuid"), chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(items, studies) of an annotation document: missing fields are null, lists and objects JSON text, the first row of a key wins. S1.

    A task reads a whole document where none is larger than chunk_bytes; else the records of all are found and parsed by ranges of so many bytes."""
    text = T.MapType(T.StringType(), T.VariantType())
    large = not spark.read.format("binaryFile").load(path).select("length").where(F.col("length") > chunk_bytes).isEmpty()
    if large:
        records = json_records(spark, path, chunk_bytes).withColumn("m", F.from_json("text", text))
    else:
        schema = T.StructType([T.StructField(items[0], T.ArrayType(text)), T.StructField(studies[0], T.ArrayType(text))])
        doc = spark.read.schema(schema).json(path, multiLine=True)

    def value(c: str):
        v = F.col("m")[c]
        plain = F.try_variant_get(v, "$", "string")
        return plain

    def rows(name: str, key: str, cols: dict[str, str]) -> DataFrame:
        own = records.where(F.col("name") == name).select(F.col("place").alias("pos"), "m") if large else doc.select(F.posexplode(name).alias("pos", "m"))
        every = own.select("pos", *(value(c).alias(a) for c, a in cols.items()))
        first = W.partitionBy(key).orderBy("pos")
        return every.where(F.col(key).isNotNull()).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "pos")

    return rows(items[0], items[1], {items[1]: items[1], items[2]: f"{items[0][:-1]}_{items[2]}"}), rows(studies[0], studies[1], {c: c for c in (studies[1], *fields)})


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """Manifest CSV with declared types, ids as text; the text nan in views becomes null. S2."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return df.withColumn("view", clean_null(F.col("view"))) if "view" in df.columns else df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): pos grows with a line's place, files in the order of their names. Row ids grow in a file and over its splits."""
    df = spark.read.text(path).select(F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos"), F.trim("value").alias("line"))
    return df.where("line <> ''")


def read_label_list(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """(id, label) of lines `id label`, the last line of an id wins; blank lines are skipped. Lines without exactly two
    tokens are an error (strict) or dropped (lenient); mode ids takes the first token of any line. S3."""
    tokens = _lines(spark, path).withColumn("t", F.split("line", r"\s+"))
    if mode == "ids":
        return tokens.select(F.col("t")[0].alias("id")).distinct()
    if mode == "lenient":
        tokens = tokens.where(F.size("t") == 2).withColumn("label", F.element_at("t", 2).try_cast("double")).where("label is not null")
    else:
        bad = F.raise_error(F.concat(F.lit("not `id label`: "), F.col("line")))
        tokens = tokens.withColumn("label", F.when(F.size("t") == 2, F.element_at("t", 2).cast("double")).otherwise(bad.cast("double")))
    return tokens.groupBy(F.col("t")[0].alias("id")).agg(F.max_by("label", "pos").alias("label"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line. S4."""
    return _lines(spark, path).select(F.col("line").alias("id")).distinct()


def read_site_map(spark: SparkSession, path: str, study: str = "study_icid", site: str = "site_id") -> DataFrame:
    """(study, site) of a CSV, the last row of a study wins. S5."""
    df = spark.read.schema(f"{study} string, {site} string").csv(path, header=True)
    df = df.withColumn("pos", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return df.where(F.col(study).isNotNull()).groupBy(study).agg(F.max_by(site, "pos").alias(site))


def task_labels(df: DataFrame, split: str = "study designation") -> DataFrame:
    """Renames the split column, makes it upper case, drops null labels. S6."""
    return df.withColumnRenamed(split, "split").withColumn("split", F.upper("split")).dropna(subset=["label"])


def read_task_labels(spark: SparkSession, path: str) -> DataFrame:
    return task_labels(spark.read.csv(path, header=True))


def read_item_manifest(spark: SparkSession, path: str, cols: Sequence[str] = ("dicom_uuid", "study_uuid", "n_frames")) -> DataFrame:
    """The columns asked for of a Parquet manifest. S7."""
    return spark.read.parquet(path).select(*cols)


def list_shards(spark: SparkSession, dirs: Sequence[str], min_bytes: int = 10_000, inclusive: bool = False, glob: str = "shard-*.tar") -> DataFrame:
    """(path, length) of the shard files above (or at) a size, without reading them. S8."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(list(dirs)).select("path", "length")
    return df.where(F.col("length") >= min_bytes if inclusive else F.col("length") > min_bytes)


def predictions(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """y, pred, score or logits of a predictions table under any of the usual names. S12."""

    def found(*names: str) -> str | None:
        return next((n for n in names if n in df.columns), None)

    y, score, pred = found("label", "y_true"), found("score", "prob", "probability", "y_prob"), found("prediction", "pred", "y_pred")
    if y is None:
        raise ValueError(f"no truth column in {df.columns}")
    out = df.withColumn("y", F.col(y).cast("double"))
    if score and dict(df.dtypes)[score] == "string":
        as_list = F.from_json(F.col(score), "array<double>")
        out = out.withColumn("logits", as_list).withColumn("score", F.when(F.col("logits").isNull(), numeric(F.col(score))))
    elif score:
        out = out.withColumn("score", F.col(score).cast("double"))
    if pred:
        return out.withColumn("pred", F.col(pred).cast("double"))
    return out.withColumn("pred", (F.col("score") >= threshold).cast("double"))


def read_predictions(spark: SparkSession, path: str, threshold: float = 0.5) -> DataFrame:
    return predictions(spark.read.csv(path, header=True, escape='"'), threshold)


def train_log(df: DataFrame) -> DataFrame:
    """Text columns epoch, itr, loss, ... as numbers; rows whose epoch isn't a number (repeated headers) go. S13."""
    kinds = {"epoch": "int", "itr": "int", "loss": "double"}
    return df.select(*(F.trim(c).try_cast(kinds.get(c, "int")).alias(c) for c in df.columns)).where("epoch is not null")


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    return train_log(spark.read.schema("epoch string, itr string, loss string, iter_ms string, gpu_ms string, data_ms string").csv(path))


def read_embeddings(spark: SparkSession, path: str, key: str = "id", col: str = "embedding") -> DataFrame:
    """S14."""
    return spark.read.parquet(path).select(key, col)


def load_dataset(spark: SparkSession, kind: str, **options) -> DataFrame:
    """The source of a name, in any case. S15."""
    from reelspark.sources import tar

    kinds: dict[str, Callable[..., DataFrame]] = {
        "webdataset": tar.read_samples, "shard_index": tar.index_shards, "shards": list_shards, "labels": read_label_list, "ids": read_id_list,
        "embeddings": read_embeddings, "manifest": read_manifest, "predictions": read_predictions, "train_log": read_train_log, "task_labels": read_task_labels,
    }
    if kind.lower() not in kinds:
        raise ValueError(f"unknown dataset {kind!r}; known: {', '.join(sorted(kinds))}")
    return kinds[kind.lower()](spark, **options)
