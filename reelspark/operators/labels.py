"""Eligibility, label rules, encodings and texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reelspark.functions.columns import clean_null, numeric

# Field names, phrases and views that results must agree on.
FREE_TEXT_FIELDS = (
    "left_ventricle", "right_ventricle", "left_atrium", "right_atrium", "aortic_valve", "mitral_valve", "tricuspid_valve",
    "pulmonic_valve", "pericardium", "aortic_root", "aortic_arch", "pulmonary_artery", "conclusions",
)
TAG_FIELDS = ("conditions", "characterizations", "stratifications")
VIEW_FIELDS = {
    "A4C": ("left_ventricle", "right_ventricle", "left_atrium", "right_atrium", "mitral_valve", "tricuspid_valve", "pericardium", "conclusions"),
    "A4C Zoomed LV": ("left_ventricle", "left_atrium", "mitral_valve", "conclusions"),
    "A4C Zoomed RV": ("right_ventricle", "right_atrium", "tricuspid_valve", "conclusions"),
    "A4C Zoomed Mitral": ("mitral_valve", "left_ventricle", "left_atrium", "conclusions"),
    "A2C": ("left_ventricle", "left_atrium", "mitral_valve", "pericardium", "conclusions"),
    "A2C Zoomed Mitral": ("mitral_valve", "left_ventricle", "left_atrium", "conclusions"),
    "A3C": ("left_ventricle", "aortic_valve", "mitral_valve", "aortic_root", "conclusions"),
    "A5C": ("left_ventricle", "aortic_valve", "aortic_root", "left_atrium", "conclusions"),
    "A5C Zoomed Aorta": ("aortic_valve", "aortic_root", "left_ventricle", "conclusions"),
    "PLAX Standard": ("left_ventricle", "right_ventricle", "aortic_valve", "mitral_valve", "aortic_root", "pericardium", "conclusions"),
    "PLAX Mitral Cusps": ("mitral_valve", "left_ventricle", "left_atrium", "conclusions"),
    "PLAX Aortic Cusps": ("aortic_valve", "aortic_root", "left_ventricle", "conclusions"),
    "PLAX Pericardial": ("pericardium", "left_ventricle", "right_ventricle", "conclusions"),
    "PSAX Mitral": ("mitral_valve", "left_ventricle", "pericardium", "conclusions"),
    "PSAX Papillary": ("left_ventricle", "pericardium", "conclusions"),
    "PSAX Apex": ("left_ventricle", "pericardium", "conclusions"),
    "PSAX Zoomed Out": ("left_ventricle", "right_ventricle", "pericardium", "conclusions"),
    "PSAXA Zoomed Aorta": ("aortic_valve", "aortic_root", "pulmonic_valve", "tricuspid_valve", "conclusions"),
    "Subcostal Standard": ("right_ventricle", "right_atrium", "pericardium", "left_ventricle", "conclusions"),
    "SUB IVC": ("right_atrium", "pulmonary_artery", "conclusions"),
    "SUB Short Axis": ("right_ventricle", "right_atrium", "pericardium", "conclusions"),
    "RVIT": ("right_ventricle", "right_atrium", "tricuspid_valve", "conclusions"),
    "Suprasternal Notch": ("aortic_arch", "pulmonary_artery", "aortic_root", "conclusions"),
}
FALLBACK_TEXT = "No clinical information available."
UNINFORMATIVE_VIEWS = ("nan", "Line Graph", "Other", "Unclear Noisy", "Unclear Dark")
GRADE_RULES = ((r"moderate|severe", 2), (r"\bmild\b", 1), (r"no significant|no regurgitation|trace|trivial|normal", 0))
ABSENT = r"no significant effusion|no effusion|without effusion"
UNREMARKABLE, PRESENT = r"normal|appears normal|not well seen", "effusion"


def eligible_items(df: DataFrame, kind: str = "type", frames: str = "n_frames", wanted: str = "Standard", least: float = 8) -> DataFrame:
    """Items of the wanted kind with a numeric frame count of `least` or more. P8."""
    return df.where((F.col(kind) == wanted) & (numeric(F.col(frames)) >= least))


def has_path(df: DataFrame, col: str = "disk_path") -> DataFrame:
    """Rows whose path is neither null nor blank. P9."""
    return df.where(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))


def informative(df: DataFrame, col: str = "view", excluded: Sequence[str] = UNINFORMATIVE_VIEWS) -> DataFrame:
    """Rows with a view that isn't excluded. P10."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*excluded))


def numeric_label(df: DataFrame, col: str, lo: float = 2.0, hi: float = 8.0) -> DataFrame:
    """Adds label, the number in a text column; rows outside [lo, hi] and without a number go. P11."""
    return df.withColumn("label", numeric(F.col(col))).where(F.col("label").between(lo, hi))


def first_rule(rules: Sequence[tuple[Column, object]]) -> Column:
    """The value of the first rule that holds, else null."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for holds, value in rules[1:]:
        out = out.when(holds, F.lit(value))
    return out


def grade_text(df: DataFrame, col: str, rules: Sequence[tuple[str, int]] = GRADE_RULES) -> DataFrame:
    """Adds label by the first pattern found in the lower-cased text; rows of no rule go. P12."""
    t = F.lower(F.col(col))
    return df.withColumn("label", first_rule([(t.rlike(p), v) for p, v in rules])).where(F.col("label").isNotNull())


def presence_text(df: DataFrame, col: str, absent: str = ABSENT, plain: str = UNREMARKABLE, present: str = PRESENT) -> DataFrame:
    """Adds label 0 (absent, or plain and no mention) or 1 (a mention); rows of no rule go. P13."""
    t = F.lower(F.col(col))
    rules = [(t.rlike(absent), 0), (t.rlike(plain) & ~t.contains(present), 0), (t.rlike(present), 1)]
    return df.withColumn("label", first_rule(rules)).where(F.col("label").isNotNull())


def sum_first_two(df: DataFrame, col: str, unit: str = r"(?:mmHg|mm\s*Hg)") -> DataFrame:
    """Adds label, the sum of the first two whole numbers before the unit, or the only one; rows without go. P14."""
    flat = F.translate(F.col(col), "\n", " ")
    nums = F.regexp_extract_all(flat, F.lit(r"(?i)(\d+)\s*" + unit), F.lit(1))
    total = F.aggregate(F.slice(nums, 1, 2), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return df.withColumn("label", F.when(F.size(nums) > 0, total)).where(F.col("label").isNotNull())


def standardize_label(df: DataFrame, stats: DataFrame, col: str = "label") -> DataFrame:
    """Adds z from a one-row table with mean and std. P15."""
    return df.crossJoin(F.broadcast(stats.select("mean", "std"))).withColumn("z", (F.col(col) - F.col("mean")) / F.col("std"))


def destandardize(df: DataFrame, stats: DataFrame, col: str = "z") -> DataFrame:
    """Adds label from z. P15."""
    return df.crossJoin(F.broadcast(stats.select("mean", "std"))).withColumn("label", F.col(col) * F.col("std") + F.col("mean"))


def binary_target(df: DataFrame, positives: Sequence[str], col: str = "label") -> DataFrame:
    """Adds target: 1 for the positive labels. P16."""
    return df.withColumn("target", F.col(col).isin(*positives).cast("int"))


def label_codes(df: DataFrame, col: str = "label") -> DataFrame:
    """A row a label with its code, 0 .. C-1 in the order of the labels."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().withColumn("code", (F.row_number().over(W.orderBy(col)) - 1).cast("int"))


def encode_labels(df: DataFrame, codes: DataFrame, col: str = "label") -> DataFrame:
    """Adds code; rows of unknown or null labels go. P17."""
    return df.join(codes, col)


def parse_member(df: DataFrame, col: str = "member") -> DataFrame:
    """Adds key and fmt (npy, npz or json) of a sample member's name; other names go. P18."""
    name = F.element_at(F.split(F.col(col), "/"), -1)
    pattern = r"^(.+?)\.(?:frames\.(npy|npz)|metadata\.(json))$"
    fmt = F.concat(F.regexp_extract(name, pattern, 2), F.regexp_extract(name, pattern, 3))
    return df.withColumn("key", F.regexp_extract(name, pattern, 1)).withColumn("fmt", fmt).where(F.col("key") != "")


def build_text(df: DataFrame, view: str = "view", age: str = "age_at_visit", fraction: str = "ejection_fraction", fields: Sequence[str] = FREE_TEXT_FIELDS,
               tags: Sequence[str] = TAG_FIELDS, view_fields: Mapping[str, Sequence[str]] = VIEW_FIELDS, fallback: str = FALLBACK_TEXT) -> DataFrame:
    """Adds text: age, ejection fraction, the fields seen in the row's view (all if the view is unknown, or if those are
    blank), and the tags, one blank apart; the fallback if there is nothing. P19."""

    def some(names: Sequence[str]) -> Column:
        return F.array_compact(F.array(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names))) if names else F.array().cast("array<string>")

    own = None
    for name, seen in view_fields.items():
        holds = clean_null(F.col(view)) == name
        own = F.when(holds, some(seen)) if own is None else own.when(holds, some(seen))
    every = some(fields)
    anatomy = F.when(F.size(own) > 0, own).otherwise(every) if own is not None else every
    years = F.when(numeric(F.col(age)).isNotNull(), F.format_string("Age: %d years.", numeric(F.col(age)).cast("long")))
    ef = F.when(F.col(fraction).isNotNull(), F.concat(F.lit("Ejection fraction: "), F.col(fraction).cast("string"), F.lit(".")))
    parts = F.concat(F.array_compact(F.array(years, ef)), anatomy, some(tags))
    return df.withColumn("text", F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.lit(fallback)))


def predict_at(df: DataFrame, threshold: float = 0.5, col: str = "score") -> DataFrame:
    """Adds pred: score >= threshold. P22."""
    return df.withColumn("pred", (F.col(col) >= threshold).cast("int"))


def group_key(df: DataFrame, cols: Sequence[str], name: str = "group_key", default: str = "unknown") -> DataFrame:
    """Adds the first column that isn't null, else the default. P24."""
    return df.withColumn(name, F.coalesce(*(F.col(c).cast("string") for c in cols), F.lit(default)))


def sample_metadata(df: DataFrame, technical: Sequence[str], study: Sequence[str], unknown_if_zero: Sequence[str] = ()) -> DataFrame:
    """Adds metadata, the JSON of the technical and study fields; fields where 0 means unknown become null. P25."""
    cols = [F.when(F.col(c) > 0, F.col(c)).alias(c) if c in unknown_if_zero else F.col(c) for c in (*technical, *study)]
    return df.withColumn("metadata", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def flatten_report(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """A long report (keys, metric, value, lower, upper) as one row a key with rounded columns metric, metric_lo, metric_hi. P26."""
    wide = df.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value").alias("v"), F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    cols = [F.round(F.col(f"`{m}_{a}`"), digits).alias(m + b) for m in metrics for a, b in (("v", ""), ("lo", "_lo"), ("hi", "_hi"))]
    return wide.select(*keys, *cols)
