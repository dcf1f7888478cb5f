"""Depth from focus as a whole: slices of the focus volume, their aggregation, regularised depth, upsampling along the image."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.functions.kernels import bilinear_taps
from rasterfold.functions.pixels import clamp
from rasterfold.operators import depth
from rasterfold.operators.keep import kept
from rasterfold.operators.solvers import smooth_depth
from rasterfold.operators.stencil import block_mean, convolve, guided, guided_coefficients, median3, modified_laplacian, ring_taps, separable


@dataclass
class DepthSettings:
    """scale: the working grid is 1 / 2^scale. measure: ("ring", inner, outer) or ("laplacian", step). A radius, strength or gate of 0 leaves its step out."""

    scale: int = 1
    measure: tuple = ("ring", 1, 3)
    radius: int = 3
    eps: float = 1e-4
    strength: float = 3.0
    sigma: float = 0.04
    median: bool = True
    up_radius: int = 2
    up_eps: float = 1e-2
    gate: float = 1.0
    robust: float = 1.0


def focus_slices(frames: DataFrame, h: int, w: int, measure: tuple, k: int, keys: list[str]) -> DataFrame:
    """The focus measure of each frame's luma v, averaged over blocks of k x k."""
    each = [*keys, "frame"]
    if measure[0] == "ring":
        sharp = convolve(frames, ring_taps(*measure[1:]), h, w, "v", each).withColumn("v", F.abs("v"))
    else:
        sharp = modified_laplacian(frames, max(measure[1], 1), h, w, "v", each)
    return block_mean(sharp, k, ["v"], each)


def aggregated(slices: DataFrame, guide: DataFrame, r: int, eps: float, keys: list[str]) -> DataFrame:
    """Slices smoothed along the guide's edges (guide has g); what the filter leaves below 0 counts as 0."""
    each = [*keys, "frame"]
    out = guided(slices.join(guide, [*keys, "y", "x"]), "g", "v", r, eps, each)
    return out.select(*each, "y", "x", F.greatest("out", F.lit(0.0)).alias("v"))


def guided_upsample(small: DataFrame, full: DataFrame, value: str, h: int, w: int, k: int, r: int, eps: float, keys: list[str]) -> DataFrame:
    """A plane of the 1 / k grid (with its guide g) on the full grid: the filter's coefficients are upsampled and applied to the full guide g."""
    ab = guided_coefficients(small, "g", value, r, eps, keys)
    ab = separable(ab, bilinear_taps(-(-h // k), h, k), bilinear_taps(-(-w // k), w, k), ["a", "b"], keys)
    return full.join(ab, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col("a") * F.col("g") + F.col("b")).alias(value))


def depth_from_focus(frames: DataFrame, fused: DataFrame, h: int, w: int, s: DepthSettings | None = None, stack: str = "stack") -> DataFrame:
    """stack, y, x, depth (in frames, within the stack), conf: from aligned frames (stack, frame, y, x, v) along the fused luma (stack, y, x, v).

    All but the least-squares solve is relational; the solve takes a stack's working grid (1 / 4^scale of a frame) in a task.
    """
    s, keys = s or DepthSettings(), [stack]
    k = 2**s.scale
    dh, dw = -(-h // k), -(-w // k)
    cell = [*keys, "y", "x"]
    guide = block_mean(fused, k, ["v"], keys).withColumnRenamed("v", "g")
    slices = focus_slices(frames, h, w, s.measure, k, keys)
    last = frames.groupBy(*keys).agg(F.max("frame").alias("_last"))
    if s.radius:
        slices = aggregated(slices, guide, s.radius, s.eps, keys)
    found = kept(depth.peaks(slices, keys))
    guide = kept(guide)
    at = depth.finish(found, depth.noise_floor(found, keys, dw), s.gate, keys).select(*cell, "depth", "conf")
    if s.median:
        at = median3(at, dh, dw, "depth", keys).join(at.select(*cell, "conf"), cell)
    at = depth.normalise(at, keys, dw).join(guide, cell)
    if s.strength > 0:
        solved = smooth_depth(at.select(F.col(stack).alias("stack"), "y", "x", "depth", "conf", F.col("g").alias("guide")), s.strength, s.sigma, s.robust)
        at = solved.withColumnRenamed("stack", stack).join(guide, cell)
    at = kept(at)
    conf = separable(at, bilinear_taps(dh, h, k), bilinear_taps(dw, w, k), ["conf"], keys)
    if s.up_radius:
        up = guided_upsample(at, fused.withColumnRenamed("v", "g"), "depth", h, w, k, s.up_radius, s.up_eps, keys)
    else:
        up = separable(at, bilinear_taps(dh, h, k), bilinear_taps(dw, w, k), ["depth"], keys)
    up = up.join(conf, cell).join(last, keys)
    return up.select(*cell, F.least(F.greatest("depth", F.lit(0.0)), F.col("_last").cast("double")).alias("depth"), clamp(F.col("conf")).alias("conf"))
