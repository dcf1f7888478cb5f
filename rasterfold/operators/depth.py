"""Depth from focus: peaks of focus profiles, confidence, order statistics, and renders by depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.functions.pixels import clamp
from rasterfold.operators.order import order_statistic
from rasterfold.operators.stencil import box, guided

CELL = ["y", "x"]


def peaks(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Of each cell's profile v over frames: c1 (highest local maximum) with neighbours l and r and frame i1, c2 (the next), mean and lowest.

    A maximum is no lower than what precedes it and higher than what follows; beyond the ends is nothing (-1).
    """
    cell = [*keys, *CELL]
    order = Window.partitionBy(*cell).orderBy("frame")
    at = profiles.select(*cell, "frame", "v", F.coalesce(F.lag("v").over(order), F.lit(-1.0)).alias("l"), F.coalesce(F.lead("v").over(order), F.lit(-1.0)).alias("r"))
    top = F.when((F.col("v") >= F.col("l")) & (F.col("v") > F.col("r")), F.struct(F.col("v"), (-F.col("frame")).alias("f"), "l", "r"))
    both = at.groupBy(*cell).agg(F.slice(F.sort_array(F.collect_list(top), asc=False), 1, 2).alias("p"), F.avg("v").alias("mean"), F.min("v").alias("low"))
    first, second = F.get("p", 0), F.get("p", 1)
    return both.select(*cell, first["v"].alias("c1"), first["l"].alias("l"), first["r"].alias("r"), (-first["f"]).alias("i1"), second["v"].alias("c2"), "mean", "low")


def every_seventh(df: DataFrame, value: str, share_num: int, share_den: int, keys: list[str], width: int) -> DataFrame:
    """One order statistic of every 7th cell in row-major order: the element at index n * num div den (0-based)."""
    some = df.withColumn("_i", F.col("y") * width + F.col("x")).filter("_i % 7 = 0")
    if not keys:
        return order_statistic(some, value, lambda n: F.least(F.floor(n * share_num / share_den), n - 1), CELL)
    stack = Window.partitionBy(*keys)
    ranked = some.select(*keys, value, F.row_number().over(stack.orderBy(value)).alias("_r"), F.count("*").over(stack).alias("_n"))
    at = ranked.filter(F.col("_r") - 1 == F.least(F.floor(F.col("_n") * share_num / share_den), F.col("_n") - 1))
    return at.select(*keys, F.col(value).alias("stat"))


def noise_floor(found: DataFrame, keys: list[str], width: int) -> DataFrame:
    return every_seventh(found, "low", 1, 2, keys, width).withColumnRenamed("stat", "floor")


def finish(found: DataFrame, floor: DataFrame, gate: float, keys: list[str]) -> DataFrame:
    """depth (frame and Gaussian offset, at most half a frame) and conf (prominence, peak ratio, gate)."""
    c1, l, r = F.col("c1"), F.col("l"), F.col("r")
    ll, lc, lr = F.ln(F.greatest(l, F.lit(1e-12))), F.ln(F.greatest(c1, F.lit(1e-12))), F.ln(F.greatest(r, F.lit(1e-12)))
    den = ll - 2 * lc + lr
    inner = (l >= 0) & (r >= 0) & (c1 > 0) & (den < 0)
    offset = F.when(inner, clamp(0.5 * (ll - lr) / F.when(inner, den), -0.5, 0.5)).otherwise(0.0)
    safe = F.when(c1 > 0, c1)
    ratio = clamp(1 - F.coalesce(F.col("c2"), F.lit(0.0)) / safe)
    gated = F.when((F.lit(gate) > 0) & (F.col("floor") > 0), clamp((c1 - F.col("floor")) / F.when(F.col("floor") > 0, gate * F.col("floor")))).otherwise(1.0) if gate > 0 else F.lit(1.0)
    at = found.join(F.broadcast(floor), keys) if keys else found.crossJoin(F.broadcast(floor))
    return at.select(*keys, *CELL, (F.col("i1") + offset).alias("depth"), F.coalesce(clamp(1 - F.col("mean") / safe) * ratio * gated, F.lit(0.0)).alias("conf"), "low")


def normalise(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """conf scaled so that its 90th percentile is 1."""
    p90 = F.broadcast(every_seventh(df, "conf", 9, 10, keys, width))
    at = df.join(p90, keys) if keys else df.crossJoin(p90)
    return at.withColumn("conf", F.when(F.col("stat") > 1e-6, F.least(F.col("conf") / F.when(F.col("stat") > 1e-6, F.col("stat")), F.lit(1.0))).otherwise(F.col("conf"))).drop("stat")


def edge_weights(guide: DataFrame, sigma: float, keys: list[str]) -> DataFrame:
    """wx and wy: exp(-|step| / sigma) to the right and downward; null at the border."""
    right = F.lead("v").over(Window.partitionBy(*keys, "y").orderBy("x"))
    down = F.lead("v").over(Window.partitionBy(*keys, "x").orderBy("y"))
    return guide.select(*keys, *CELL, F.exp(-F.abs(right - F.col("v")) / sigma).alias("wx"), F.exp(-F.abs(down - F.col("v")) / sigma).alias("wy"))


def huber(d: Column, u: Column, tau: float) -> Column:
    return F.least(F.lit(1.0), F.lit(tau) / F.greatest(F.abs(d - u), F.lit(1e-12)))


# ---- averages by contrast, depth or slab ------------------------------------------------------


def contrast_weight(c: Column, floor: Column, gate: float, power: float) -> Column:
    return F.pow(F.greatest(c - (1 + gate) * floor, F.lit(0.0)), F.lit(power)) + F.pow(0.01 * floor, F.lit(power)) + 1e-30


def weighted_average(frames: DataFrame, contrast: DataFrame, floor: DataFrame, keys: list[str], power: float = 2.0, gate: float = 0.5, smooth: int = 0, guide: DataFrame | None = None, eps: float = 1e-4) -> DataFrame:
    """Frames averaged by contrast (v) over the cell's floor; weights smoothed by a box or, with a guide (g), by the guided filter."""
    each = [*keys, "frame"]
    c = box(contrast, smooth, ["v"], each) if smooth else contrast
    w = c.join(floor, [*keys, *CELL]).select(*each, *CELL, contrast_weight(F.col("v"), F.col("floor"), gate, power).alias("w"))
    if smooth and guide is not None:
        w = guided(w.join(guide, [*keys, *CELL]), "g", "w", smooth, eps, each).select(*each, *CELL, F.greatest("out", F.lit(1e-30)).alias("w"))
    elif smooth:
        w = box(w, smooth, ["w"], each)
    at = frames.join(w, [*each, *CELL])
    return at.groupBy(*keys, *CELL).agg(*[(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v) for v in ("r", "g", "b")])


def slab_ranges(count: int, size: int, overlap: int) -> list[tuple[int, int]]:
    if count < 1:
        return []
    size = min(max(size, 1), count)
    overlap = min(overlap, size - 1)
    out = [(0, size - 1)]
    while out[-1][1] < count - 1:
        low = out[-1][1] + 1 - overlap
        out.append((low, min(low + size - 1, count - 1)))
    return out


def in_slabs(frames: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Adds slab: a frame is in each range that holds it."""
    rows = [(s, f) for s, (a, b) in enumerate(ranges) for f in range(a, b + 1)]
    return frames.join(F.broadcast(frames.sparkSession.createDataFrame(rows, "slab int, frame int")), "frame")


def render_by_depth(layers: DataFrame, depth: DataFrame, keys: list[str]) -> DataFrame:
    """Layers with lo and hi, averaged with weights that fall from 1 within [lo, hi] to 0 one frame away."""
    t = clamp(1 - F.greatest(F.col("lo") - F.col("depth"), F.col("depth") - F.col("hi"), F.lit(0.0)))
    at = layers.join(depth, [*keys, *CELL]).withColumn("_t", t)
    return at.groupBy(*keys, *CELL).agg(*[(F.sum(F.col("_t") * F.col(v)) / F.greatest(F.sum("_t"), F.lit(1e-6))).alias(v) for v in ("r", "g", "b")])


def peaking(energy: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """Frames in focus at a cell: e at least share^2 of the cell's largest, where that is over 2 % of its 99.5th percentile."""
    top = energy.groupBy(*keys, *CELL).agg(F.max("e").alias("top"))
    if keys:
        stack = Window.partitionBy(*keys)
        ranked = top.withColumn("_r", F.row_number().over(stack.orderBy("top"))).withColumn("_n", F.count("*").over(stack))
        p = ranked.filter(F.col("_r") - 1 == F.least(F.floor(F.col("_n") * 0.995), F.col("_n") - 1)).select(*keys, F.col("top").alias("p995"))
        cells = top.join(p, keys).select(*keys, *CELL, "top", "p995")
    else:
        p = order_statistic(top, "top", lambda n: F.least(F.floor(n * 0.995), n - 1), CELL).select(F.lit(0).alias("_all"), F.col("stat").alias("p995"))
        cells = top.withColumn("_all", F.lit(0)).join(F.broadcast(p), "_all").select(*CELL, "top", "p995")
    at = energy.join(cells, [*keys, *CELL])
    return at.select(*keys, "frame", *CELL, ((F.col("e") >= share * share * F.col("top")) & (F.col("top") > 0.02 * F.col("p995"))).alias("sharp"))


def slice_of(depth: DataFrame, frame: int) -> DataFrame:
    return depth.filter(F.floor(F.col("depth") + 0.5) == frame)


def pick_frame(winners: DataFrame, h: int, w: int, keys: list[str]) -> DataFrame:
    """The frame that most of a pixel's 3 x 3 neighbours took; the centre counts 1.5, the smallest frame wins ties."""
    votes = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1.0 if dy or dx else 1.5).alias("n")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    sent = winners.select(*keys, *CELL, "winner", votes.alias("_v")).select(*keys, (F.col("y") + F.col("_v.dy")).alias("y"), (F.col("x") + F.col("_v.dx")).alias("x"), "winner", F.col("_v.n").alias("n"))
    sums = sent.filter((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)).groupBy(*keys, *CELL, "winner").agg(F.sum("n").alias("n"))
    return sums.groupBy(*keys, *CELL).agg(F.max_by("winner", F.struct("n", (-F.col("winner")).alias("f"))).alias("frame"))


def in_focus(frame: DataFrame, depth: DataFrame, contrast: DataFrame, index: int, dim: float, near: float, far: float, keys: list[str]) -> DataFrame:
    """A frame dimmed where the depth lies further from it than near..far, unless there is local contrast."""
    away = clamp((F.abs(F.col("depth") - index) - near) / max(far - near, 1e-6))
    k = 1 - dim * away * (1 - clamp(F.col("contrast")))
    at = frame.join(depth, [*keys, *CELL]).join(contrast, [*keys, *CELL])
    return at.select(*keys, *CELL, *[(F.col(v) * k).alias(v) for v in ("r", "g", "b")])
