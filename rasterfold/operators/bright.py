"""Brightness: means, gains against the first frame, equalising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RGB = ["r", "g", "b"]
SAMPLED = "y % 4 = 0 and x % 4 = 0"


def means(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.filter(SAMPLED).groupBy(*keys, "frame").agg(*[F.avg(c).alias(c) for c in RGB])


def gains_whole(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Ratio of whole-frame means to those of frame 0, within [1/4, 4]."""
    m = means(frames, keys)
    first = m.filter("frame = 0").select(*keys, *[F.col(c).alias(f"_{c}") for c in RGB])
    at = m.join(F.broadcast(first), keys) if keys else m.crossJoin(F.broadcast(first))
    return at.select(*keys, "frame", *[_clamped(F.col(f"_{c}"), F.col(c)).alias(c) for c in RGB])


def _clamped(a, b):
    return F.when(b > 0, F.least(F.greatest(a / F.when(b > 0, b), F.lit(0.25)), F.lit(4.0))).otherwise(1.0)


def gains_aligned(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Ratio of sums over the sampled pixels that a frame's warp covers (valid); fewer than 64 give 1."""
    some = frames.filter(SAMPLED).filter("valid")
    first = frames.filter(SAMPLED).filter("frame = 0").select(*keys, "y", "x", *[F.col(c).alias(f"_{c}") for c in RGB])
    s = some.join(first, [*keys, "y", "x"]).groupBy(*keys, "frame").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in (*RGB, *[f"_{c}" for c in RGB])])
    return s.select(*keys, "frame", *[F.when(F.col("n") < 64, 1.0).otherwise(_clamped(F.col(f"_{c}"), F.col(c))).alias(c) for c in RGB])


def apply(frames: DataFrame, gains: DataFrame, keys: list[str]) -> DataFrame:
    """Multiplied, not clamped; gains within 1e-6 of 1 change nothing."""
    g = gains.select(*keys, "frame", *[F.col(c).alias(f"_{c}") for c in RGB])
    unity = (F.abs(F.col("_r") - 1) < 1e-6) & (F.abs(F.col("_g") - 1) < 1e-6) & (F.abs(F.col("_b") - 1) < 1e-6)
    return frames.join(F.broadcast(g), [*keys, "frame"]).select(*keys, "frame", "y", "x", *[F.when(unity, F.col(c)).otherwise(F.col(c) * F.col(f"_{c}")).alias(c) for c in RGB])
