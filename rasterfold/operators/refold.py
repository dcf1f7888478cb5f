"""Views from other places: every frame is moved by its depth for each view, and all views are folded at once, keyed by view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.functions.kernels import KERNELS
from rasterfold.operators.fuse import RGB, auto_levels, fuse


def proxy_factor(h: int, w: int, out_h: int, out_w: int) -> int:
    """The whole factor that brings a frame nearest to the size asked for; 1 where none is."""
    return max(math.floor(max(w / out_w, h / out_h) + 0.5), 1) if out_w and out_h else 1


def shift_of(view: Column, frame: Column, frames: int, w: int, near_first: bool) -> Column:
    """Pixels that a frame moves to the right in a view: the far end of the stack moves by the view's share of the width, the middle stays."""
    z = frame / (frames - 1) if frames > 1 else F.lit(0.5)
    return view * w * (z - 0.5) * (1 if near_first else -1)


def moved(frames: DataFrame, views: list[float], count: int, h: int, w: int, k: int, values: list[str], keys: list[str], near_first: bool = True, kernel: str = "spline4x4") -> DataFrame:
    """keys, view, frame, y, x, values, inside: the frames as each view has them, averaged over blocks of k x k.

    For k over 1 shifts are whole pixels; else they are resampled by `kernel` (spline4x4 or bilinear). A pixel at the left or right border also stands for
    those beyond it; `inside` is the share of an output that comes from within the frame. Each pixel is read once for all views and goes
    where it is wanted; rows of a block are summed before they are shuffled.
    """
    shift = shift_of(F.get(F.array(*[F.lit(float(v)) for v in views]), F.col("view")), F.col("frame"), count, w, near_first)
    if k > 1:
        taps = F.array(F.struct(F.rint(shift).cast("int").alias("d"), F.lit(1.0).alias("weight")))
    else:
        if kernel not in ("spline4x4", "bilinear"):
            raise ValueError("views move by spline4x4 or bilinear")
        n, weights = KERNELS[kernel]
        whole = F.floor(-shift).cast("int")
        parts = weights(-shift - F.floor(-shift))
        taps = F.array(*[F.struct((n // 2 - 1 - j - whole).alias("d"), (q if isinstance(q, Column) else F.lit(q)).alias("weight")) for j, q in enumerate(parts)])
    out_w = -(-w // k)
    last = F.when(F.col("_t.d") == 0, F.lit(w - 1)).otherwise(F.lit(out_w * k - 1))
    at = F.col("x") + F.col("_t.d")
    first, final = F.when(F.col("x") == 0, F.least(at, F.lit(0))).otherwise(at), F.when(F.col("x") == w - 1, F.greatest(at, last)).otherwise(at)
    sent = frames.select(*keys, "frame", "y", "x", *values, F.explode(F.sequence(F.lit(0), F.lit(len(views) - 1))).alias("view")).withColumn("_t", F.explode(taps))
    sent = sent.withColumns({"_a": F.greatest(first, F.lit(0)), "_b": F.least(final, last), "_at": at}).filter("_a <= _b")
    sent = sent.withColumn("_o", F.explode(F.sequence(F.floor(F.col("_a") / k), F.floor(F.col("_b") / k))))
    low, high = F.greatest(F.col("_a"), F.col("_o") * k), F.least(F.col("_b"), F.col("_o") * k + k - 1)
    sent = sent.withColumns({"_n": (high - low + 1) * F.col("_t.weight"), "_in": F.when(F.col("_at").between(low, high), F.col("_t.weight")).otherwise(0.0)})
    cell = [*keys, "view", "frame", F.floor(F.col("y") / k).cast("int").alias("y"), F.col("_o").cast("int").alias("x")]
    return sent.groupBy(*cell).agg(*[(F.sum(F.col(v) * F.col("_n")) / F.sum("_n")).alias(v) for v in values], (F.sum("_in") / F.sum("_n")).alias("inside"))


def proxy_area(x: int, y: int, w: int, h: int, k: int) -> tuple[int, int, int, int]:
    """The whole blocks within an area: x, y, width and height on the grid of blocks."""
    x0, y0 = -(-x // k), -(-y // k)
    return x0, y0, max((x + w) // k - x0, 1), max((y + h) // k - y0, 1)


def refold(frames: DataFrame, views: list[float], count: int, h: int, w: int, k: int = 1, keys: list[str] | None = None, near_first: bool = True, kernel: str = "spline4x4", levels: int | None = None, rule: str = "de", **more) -> DataFrame:
    """keys, view, y, x, r, g, b, covered: the fold of frames (keys, frame, y, x, r, g, b) once for each view.

    The fold's keys have the view beside the stack, so all views are one job over frames read once. `covered` counts the
    frames that reach a pixel from within.
    """
    keys = keys or []
    out_h, out_w = -(-h // k), -(-w // k)
    at = moved(frames, views, count, h, w, k, RGB, keys, near_first, kernel)
    image = fuse(at.drop("inside"), out_h, out_w, levels or auto_levels(out_h, out_w), rule=rule, keys=[*keys, "view"], **more)["image"]
    reached = at.groupBy(*keys, "view", "y", "x").agg(F.count(F.when(F.col("inside") > 0.999, 1)).alias("covered"))
    return image.join(reached, [*keys, "view", "y", "x"])
