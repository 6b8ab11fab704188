"""Column functions: resolution of technical fields, vectors, scores, and portable seeded draws."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def resolve_fps(fps: Column) -> Column:
    """Frames a second; 0 (unknown) for null, NaN and values that aren't positive. P1."""
    return F.when(~F.isnan(fps) & (fps > 0), fps.cast("double")).otherwise(F.lit(0.0))


def resolve_spacing(cm: Column) -> Column:
    """Pixel spacing in mm from cm; 0 (unknown) for null, NaN and values that aren't positive. P2."""
    return F.when(~F.isnan(cm) & (cm > 0), cm.cast("double") * 10).otherwise(F.lit(0.0))


def hash_int(*parts: Column | str | int) -> Column:
    """The first 32 bits of the MD5 of the parts joined by ':', as a long: any engine with MD5 draws the same."""
    text = F.concat_ws(":", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row, however often f or lambdas in it refer to it."""
    return F.transform(F.array(value), f)[0]


def softmax(logits: Column) -> Column:
    """Stable softmax of an array. P20. The maximum and the sum are taken once a row."""

    def with_total(e: Column) -> Column:
        return F.struct(e.alias("v"), F.aggregate(e, F.lit(0.0), lambda s, y: s + y).alias("by"))

    e = once(F.struct(logits.alias("v"), F.array_max(logits).alias("by")), lambda s: F.transform(s["v"], lambda x: F.exp(x - s["by"])))
    return once(once(e, with_total), lambda s: F.transform(s["v"], lambda x: x / s["by"]))


def argmax(values: Column) -> Column:
    """Index from 0 of the largest entry, the lowest on ties. P21."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def topk_hit(values: Column, truth: Column, k: int = 5) -> Column:
    """Whether the true entry is among the min(k, n) largest, counting only entries above it. P21."""
    own = F.element_at(values, (truth + 1).cast("int"))
    return F.size(F.filter(values, lambda x: x > own)) < F.least(F.lit(k), F.size(values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero. P23."""
    normed = F.struct(v.alias("v"), F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)).alias("by"))
    return once(normed, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["by"]))


def erfc(x: Column | str) -> Column:
    """Complementary error function, which the built-in functions lack."""

    @F.arrow_udf("double")
    def run(xs: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.erfc(v) for v in xs.to_pylist()], pa.float64())

    return run(x)


def numeric(text: Column) -> Column:
    """Number in a text, null if there is none."""
    return F.trim(text.cast("string")).try_cast("double")


def clean_null(text: Column) -> Column:
    """Null for blank texts and for the literal nan."""
    t = F.trim(text.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)
