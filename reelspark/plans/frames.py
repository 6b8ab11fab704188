"""Row-level plans of frame work: which size, and which frames, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.columns import hash_int, resolve_fps, resolve_spacing


def _long(c: Column) -> Column:
    return c.cast("long")


def _sequence(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), _long(F.greatest(n, F.lit(1))) - 1)).otherwise(F.array().cast("array<long>"))


def spacing_plan(df: DataFrame, target: float = 0.36, height: str = "height", width: str = "width", spacing: str = "spacing") -> DataFrame:
    """Adds scale, new_h, new_w; sizes stay if the spacing is unknown (0) or within 1 % of the target. P3."""
    src = F.col(spacing)
    scale = F.when(src > 0, src / F.lit(target)).otherwise(F.lit(1.0))
    same = (src <= 0) | (F.abs(scale - 1) < 0.01)
    new = lambda c: F.when(same, _long(F.col(c))).otherwise(_long(F.bround(F.col(c) * scale, 0)))
    return df.withColumn("scale", scale).withColumn("new_h", new(height)).withColumn("new_w", new(width))


def resample_plan(df: DataFrame, target_fps: float = 24.0, frames: str = "n_frames", fps: str = "fps") -> DataFrame:
    """Adds t_out and frame_idx, the source frame of each output frame. P4."""
    n, src = _long(F.col(frames)), F.col(fps)
    known = src > 0
    t = F.when(known, F.greatest(F.lit(1).cast("long"), _long(F.bround(n / F.when(known, src) * target_fps, 0)))).otherwise(n)
    step = F.when(known, src / F.lit(target_fps)).otherwise(F.lit(1.0))
    idx = F.transform(_sequence(t), lambda i: F.greatest(F.lit(0).cast("long"), F.least(_long(F.bround(i * step, 0)), n - 1)))
    return df.withColumn("t_out", t).withColumn("frame_idx", F.when(known, idx).otherwise(_sequence(n)))


def _linspace(n: Column, k: int) -> Column:
    """k evenly spaced places in 0 .. n-1, cut to whole numbers."""
    return F.transform(_sequence(F.lit(k)), lambda i: _long(F.floor(i * (n - 1) / F.lit(float(max(1, k - 1))))))


def clip_plan(df: DataFrame, n: int, stride: int = 1, mode: str = "center", seed: int = 0, clips: int = 1, short: str = "pad", frames: str = "n_frames", key: str = "id") -> DataFrame:
    """Adds clip and clip_idx.

    center (P5): n frames about the middle; a short item repeats its last frame, an empty one has none and `empty` true.
    random (P6): n frames at `stride` from a start drawn from (seed, id, clip), `clips` rows an item; an item shorter
    than n * stride is spread evenly (short='pad'), dropped ('drop') or repeated from the start ('tile').
    first: as random, from frame 0."""
    t = _long(F.col(frames))
    if mode == "center":
        start = F.greatest(F.lit(0).cast("long"), F.floor((t - n) / 2))
        own = F.sequence(start, F.greatest(start, F.least(start + n, t) - 1))
        idx = F.when(t >= n, own).otherwise(F.concat(own, F.array_repeat(t - 1, (F.lit(n) - t).cast("int"))))
        out = df.withColumn("clip", F.lit(0)).withColumn("empty", t < 1)
        if short == "drop":
            return out.where(t >= n).withColumn("clip_idx", idx)
        return out.withColumn("clip_idx", F.when(t < 1, F.array().cast("array<long>")).otherwise(idx))
    out = df.withColumn("clip", F.explode(F.sequence(F.lit(0), F.lit(clips - 1))))
    room = t - n * stride
    start = F.pmod(hash_int(seed, F.col(key), F.col("clip")), F.greatest(room, F.lit(0)) + 1) if mode == "random" else F.lit(0).cast("long")
    whole = F.sequence(start, start + (n - 1) * stride, F.lit(stride).cast("long"))
    if short == "drop":
        return out.where(room >= 0).withColumn("clip_idx", whole)
    other = F.transform(_sequence(F.lit(n)), lambda i: F.pmod(i * stride, F.greatest(t, F.lit(1)))) if short == "tile" else _linspace(t, n)
    return out.withColumn("clip_idx", F.when(room >= 0, whole).when(t > 0, other).otherwise(F.array().cast("array<long>")))


def stored_stride(stored: Column, sample: int) -> Column:
    """Stride of a clip of `sample` frames in one of `stored`: at least 1. P6."""
    return F.greatest(F.lit(1), F.floor(stored / sample).cast("int"))


def sliding_windows(df: DataFrame, window: int, stride: int, frames: str = "n_frames") -> DataFrame:
    """A row per window with start and window_idx; a last window ends at the last frame; a short item has one window, evenly spread. P7."""
    t = _long(F.col(frames))
    last = t - window
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)), F.lit(stride).cast("long")), F.array(F.greatest(last, F.lit(0).cast("long"))))
    out = df.where(t > 0).withColumn("start", F.explode(F.when(last >= 0, starts).otherwise(F.array(F.lit(0).cast("long")))))
    idx = F.sequence(F.col("start"), F.col("start") + (window - 1))
    return out.withColumn("window_idx", F.when(last >= 0, idx).otherwise(_linspace(t, window)))


def technical(df: DataFrame, fps: str, spacing_cm: str) -> DataFrame:
    """Adds the resolved fps and spacing. P1, P2."""
    return df.withColumn("fps", resolve_fps(F.col(fps))).withColumn("spacing", resolve_spacing(F.col(spacing_cm)))
