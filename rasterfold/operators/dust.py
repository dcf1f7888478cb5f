"""Sensor dust: spots of a dust map found against its own background, and frames filled or flattened under them.

A map is a plane (keys..., y, x, v) of luma, the same for all frames of its key. Everything up to the spots is relational; a fill
takes one spot's window of one frame in a task, and all of them at once: no fill reads what lies under any spot, so the
order of spots only decides which one a pixel under several of them takes, the last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.functions.kernels import expand_taps, reduce_taps
from rasterfold.operators.keep import kept
from rasterfold.operators.regions import CELL, cells, regions, windows_meeting
from rasterfold.operators.stencil import dilate_square, expand_linear, reduce

MOMENTS = ["s", "sx", "sy", "sv", "sxv", "syv", "sxx", "sxy", "syy"]


@dataclass
class DustSettings:
    """Darker than the background by a share over `threshold` is dust; spots grow by `margin` pixels; under `min_area` pixels is noise."""

    threshold: float = 0.03
    margin: int = 3
    min_area: int = 16


@dataclass
class DustMap:
    """spots (keys, spot from 1 by area, x, y, w, h, area), pixels (keys, spot, y, x, gain), rejected (keys, rejected): blobs too wide."""

    h: int
    w: int
    settings: DustSettings
    spots: DataFrame
    pixels: DataFrame
    rejected: DataFrame


def coarse_levels(h: int, w: int, cell: int) -> int:
    """Levels up to cells of about `cell` pixels, as far as both sides keep two cells."""
    levels, size = 0, 1
    while size < cell and min((h + 1) // 2, (w + 1) // 2) >= 2:
        h, w, size, levels = (h + 1) // 2, (w + 1) // 2, 2 * size, levels + 1
    return levels


def _halves(n: int, levels: int) -> list[int]:
    out = [n]
    for _ in range(levels):
        out.append((out[-1] + 1) // 2)
    return out


def plane_at(u: Column, t: Column) -> Column:
    """The value at (u, t) of the plane that fits the weighted moments best; their mean where they lie on a line, null without weight."""
    s = F.col("s")
    mean = {c: F.col(f"s{c}") / s for c in ("x", "y", "v", "xv", "yv", "xx", "xy", "yy")}
    xx, yy, xy = mean["xx"] - mean["x"] * mean["x"], mean["yy"] - mean["y"] * mean["y"], mean["xy"] - mean["x"] * mean["y"]
    xv, yv = mean["xv"] - mean["x"] * mean["v"], mean["yv"] - mean["y"] * mean["v"]
    du, dt = u - mean["x"], t - mean["y"]
    area = xx * yy - xy * xy
    tilted = mean["v"] + du * (xv * yy - yv * xy) / area + dt * (yv * xx - xv * xy) / area
    return F.when(s < 1e-3, None).when(F.abs(area) > 1e-9 * (xx + du * du) * (yy + dt * dt), tilted).otherwise(mean["v"])


def diffused(grid: DataFrame, h: int, w: int, keys: list[str]) -> DataFrame:
    """Cells without a value take the mean of their four neighbours, ring by ring; what stays takes the mean of all, or 1."""
    grid = kept(grid)
    mean = grid.groupBy(*keys).agg(F.coalesce(F.avg("v"), F.lit(1.0)).alias("_all"))
    start = grid
    for _ in range(max(h, w)):
        if grid.filter("v is null").isEmpty():
            return grid
        steps = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
        near = grid.filter("v is not null").select(*keys, "v", F.explode(steps).alias("_n")).groupBy(*keys, F.col("_n.y").alias("y"), F.col("_n.x").alias("x")).agg(F.avg("v").alias("_near"))
        grid = kept(grid.join(near, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("v", "_near").alias("v")))
    return grid.join(start.select(*keys).distinct().join(mean, keys), keys).select(*keys, "y", "x", F.coalesce("v", "_all").alias("v"))


def background(df: DataFrame, h: int, w: int, levels: int, keys: list[str], holes: bool = True) -> DataFrame:
    """keys, y, x, v: the large-scale background of v under the weights wt. A plane is fitted under each cell `levels` up, from nine moments.

    `holes` says that weights may be 0, so that cells may lack a value.
    """
    edge = float(max(h, w))
    x, y, v, wt = (F.col("x") - w / 2) / edge, (F.col("y") - h / 2) / edge, F.col("v"), F.col("wt")
    m = df.select(*keys, "y", "x", *[(wt * c).alias(n) for n, c in zip(MOMENTS, (F.lit(1.0), x, y, v, x * v, y * v, x * x, x * y, y * y))])
    hs, ws = _halves(h, levels), _halves(w, levels)
    for a, b in zip(hs[:-1], ws[:-1]):
        m = reduce(m, a, b, MOMENTS, keys)
    step = 2**levels
    out = m.select(*keys, "y", "x", plane_at((F.col("x") * step - w / 2) / edge, (F.col("y") * step - h / 2) / edge).alias("v"))
    if holes:
        out = diffused(out, hs[-1], ws[-1], keys)
    for a, b in zip(hs[-2::-1], ws[-2::-1]):
        out = expand_linear(out, a, b, ["v"], keys)
    return out


def _dark(plane: DataFrame, back: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    below = 1 - min(max(threshold, 0.001), 0.9)
    return plane.join(back.withColumnRenamed("v", "bg"), [*keys, "y", "x"]).withColumn("mask", ((F.col("bg") > 1e-6) & (F.col("v") / F.col("bg") < below)).cast("int"))


def map_background(half: DataFrame, h: int, w: int, threshold: float, keys: list[str]) -> DataFrame:
    """keys, y, x, v, bg, mask at half resolution: the second background leaves out what the first one shows as dust, and two pixels around it."""
    levels = coarse_levels(h, w, 16)
    plain = background(half.withColumn("wt", F.lit(1.0)), h, w, levels, keys, holes=False)
    seen = dilate_square(_dark(half, plain, threshold, keys), 2, "mask", keys)
    weighted = kept(half.join(seen, [*keys, "y", "x"]).select(*keys, "y", "x", "v", (1.0 - F.col("mask")).alias("wt")))
    return _dark(weighted.drop("wt"), background(weighted, h, w, levels, keys), threshold, keys)


def _half_taps(hh: int, hw: int) -> Column:
    """The samples of the half grid around a pixel (sample k stands at pixel 2 k) with their weights."""
    ends = {c: [F.floor(F.col(c) / 2).cast("int"), F.least(F.floor((F.col(c) + 1) / 2).cast("int"), F.lit(n - 1))] for c, n in (("y", hh), ("x", hw))}
    return F.array(*[F.struct(a.alias("y"), b.alias("x"), F.lit(0.25).alias("w")) for a in ends["y"] for b in ends["x"]])


def detect(plane: DataFrame, h: int, w: int, settings: DustSettings | None = None, keys: list[str] | None = None) -> DustMap:
    """The spots of a map's luma (keys, y, x, v)."""
    s, keys = settings or DustSettings(), keys or []
    hh, hw, m = (h + 1) // 2, (w + 1) // 2, s.margin
    half = kept(reduce(plane, h, w, ["v"], keys))
    seen = kept(map_background(half, hh, hw, s.threshold, keys) if min(h, w) >= 4 else half.withColumn("bg", F.col("v")).withColumn("mask", F.lit(0)))
    lit = kept(regions(seen, keys))
    blobs = lit.groupBy(*keys, "region").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in "yx" for k, f in ((0, F.min), (1, F.max))])
    blobs = kept(blobs.filter(F.col("n") * 4 >= max(s.min_area, 1)).withColumn("wide", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * 4 + 4 > min(hh, hw)))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "region")
    named = blobs.filter("not wide").withColumn("spot", F.row_number().over(order).cast("long"))
    ends = [F.greatest(2 * F.col(f"{c}0") - m, F.lit(0)).alias(c) for c in "xy"] + [F.least(2 * F.col(f"{c}1") + 2 + m, F.lit(n)).alias(f"_{c}") for c, n in (("x", w), ("y", h))]
    spots = kept(named.select(*keys, "spot", "region", *ends, (F.col("n") * 4).alias("area")).select(*keys, "spot", "region", "x", "y", (F.col("_x") - F.col("x")).alias("w"), (F.col("_y") - F.col("y")).alias("h"), "area"))
    pixels = lit.join(spots.select(*keys, "region", "spot"), [*keys, "region"]).select(*keys, "spot", "y", "x")
    for c, n in (("x", w), ("y", h)):
        grown = F.sequence(F.greatest(2 * F.col(c) - m, F.lit(0)), F.least(2 * F.col(c) + 1 + m, F.lit(n - 1)))
        pixels = pixels.withColumn(c, F.explode(grown)).distinct()
    ratio = F.when((F.col("v") > 1e-6) & (F.col("bg") > F.col("v")), F.least(F.col("bg") / F.col("v"), F.lit(10.0))).otherwise(1.0)
    tapped = pixels.withColumn("_t", F.explode(_half_taps(hh, hw))).withColumns({"_y": F.col("_t.y"), "_x": F.col("_t.x")})
    gain = tapped.join(seen.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), ratio.alias("_g")), [*keys, "_y", "_x"])
    return DustMap(h, w, s, spots.drop("region"), kept(gain.groupBy(*keys, "spot", "y", "x").agg(F.sum(F.col("_t.w") * F.col("_g")).alias("gain"))), blobs.filter("wide").groupBy(*keys).agg(F.count("*").alias("rejected")))


# ---- taking it out ----------------------------------------------------------------------------


def padded(spots: DataFrame, h: int, w: int) -> DataFrame:
    """The window that a spot is filled from: the spot and as much again around it, within the frame."""
    pad = F.greatest(F.floor(F.greatest("w", "h") / 2).cast("int"), F.lit(6))
    ends = {c: (F.greatest(F.col(c) - pad, F.lit(0)), F.least(F.col(c) + F.col(n) + pad, F.lit(size))) for c, n, size in (("x", "w", w), ("y", "h", h))}
    return spots.withColumns({"_x": ends["x"][0], "_y": ends["y"][0], "_w": ends["x"][1] - ends["x"][0], "_h": ends["y"][1] - ends["y"][0]}).drop("x", "y", "w", "h").withColumnsRenamed({f"_{c}": c for c in "xywh"})


def neighbours(dust: DustMap, keys: list[str] | None = None) -> DataFrame:
    """keys, spot, other_spot, ...: for each spot those (itself too) whose window meets the one that it is filled from."""
    keys = keys or []
    return windows_meeting(padded(dust.spots, dust.h, dust.w), dust.spots, keys)


def pull_push(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values where there is weight; holes take a coarser level, which is filled in the same way. Weights fade from one to the other."""
    h, w = v.shape
    own = np.divide(v, weight, out=np.zeros_like(v), where=weight > 1e-9)
    if max(h, w) == 1:
        return own
    ty, tx = _dense(reduce_taps(h), h), _dense(reduce_taps(w), w)
    above = pull_push(ty @ v @ tx.T, ty @ weight @ tx.T)
    up = _dense(expand_taps(h), above.shape[0]) @ above @ _dense(expand_taps(w), above.shape[1]).T
    share = np.clip(weight, 0.0, 1.0)
    return np.where(weight > 1e-9, share * own + (1 - share) * up, up)


def _dense(taps: list, n: int) -> np.ndarray:
    m = np.zeros((max(o for o, _, _ in taps) + 1, n))
    for o, i, weight in taps:
        m[o, i] += weight
    return m


def _fill(values: list[str], names: list[str]):
    def run(group: pa.Table) -> pa.Table:
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        free, mine = ~group["dust"].to_numpy(zero_copy_only=False), group["mine"].to_numpy(zero_copy_only=False)
        at = y - y.min(), x - x.min()
        shape = int(at[0].max()) + 1, int(at[1].max()) + 1
        weight = np.zeros(shape)
        weight[at] = free
        out = {c: group[c].filter(pa.array(mine)) for c in names}
        for c in values:
            v = np.zeros(shape)
            v[at] = np.where(free, group[c].to_numpy(zero_copy_only=False), 0.0)
            out[c] = pa.chunked_array([pull_push(v, weight)[at][mine]])
        return pa.table(out)

    return run


def fill(frames: DataFrame, dust: DustMap, values: list[str], keys: list[str] | None = None, frame: str = "frame") -> DataFrame:
    """Frames (keys, frame, y, x, values...) with each spot interpolated from what surrounds it; null values count as 0.

    Windows meet pixels in cells, so a pixel is sent once to each window that holds it. Of several spots over a pixel the smallest one's value stays.
    """
    keys = keys or []
    cell, at = [*keys, "cell_y", "cell_x"], [*keys, "y", "x"]
    covered = dust.pixels.select(*at).distinct().withColumn("dust", F.lit(True))
    windows = padded(dust.spots, dust.h, dust.w).select(*keys, "spot", *[F.col(c).alias(f"_{c}") for c in "xywh"])
    dealt = windows.withColumn("cell_x", F.explode(cells(F.col("_x"), F.col("_x") + F.col("_w") - 1))).withColumn("cell_y", F.explode(cells(F.col("_y"), F.col("_y") + F.col("_h") - 1)))
    plain = frames.select(*keys, frame, "y", "x", *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values])
    placed = plain.withColumns({"cell_y": F.floor(F.col("y") / CELL), "cell_x": F.floor(F.col("x") / CELL)}).join(dealt, cell)
    inside = placed.filter(F.col("x").between(F.col("_x"), F.col("_x") + F.col("_w") - 1) & F.col("y").between(F.col("_y"), F.col("_y") + F.col("_h") - 1))
    own = dust.pixels.select(*keys, "spot", "y", "x").withColumn("mine", F.lit(True))
    window = inside.join(covered, at, "left").join(own, [*keys, "spot", "y", "x"], "left").select(*keys, frame, "spot", "y", "x", *values, F.coalesce("dust", F.lit(False)).alias("dust"), F.coalesce("mine", F.lit(False)).alias("mine"))
    types = dict(frames.dtypes)
    names = [*keys, frame, "spot", "y", "x"]
    schema = ", ".join(f"{c} {types[c] if c != 'spot' else 'long'}" for c in names) + "".join(f", {v} double" for v in values)
    filled = window.groupBy(*keys, frame, "spot").applyInArrow(_fill(values, names), schema)
    last = filled.groupBy(*keys, frame, "y", "x").agg(F.max_by(F.struct("spot", *values), "spot").alias("_new"))
    return frames.join(last, [*keys, frame, "y", "x"], "left").select(*keys, frame, "y", "x", *[F.coalesce(f"_new.{v}", v).alias(v) for v in values], F.coalesce("_new.spot", F.lit(0)).alias("spot"))


def flatten(frames: DataFrame, dust: DustMap, values: list[str], keys: list[str] | None = None, frame: str = "frame") -> DataFrame:
    """Frames with what lies under a spot multiplied by the attenuation that the map shows there, once for each spot over a pixel."""
    keys = keys or []
    gains = dust.pixels.groupBy(*keys, "y", "x").agg(F.product("gain").alias("_gain"), F.max("spot").alias("_spot"))
    both = frames.join(gains, [*keys, "y", "x"], "left")
    return both.select(*keys, frame, "y", "x", *[(F.col(v) * F.coalesce("_gain", F.lit(1.0))).alias(v) for v in values], F.coalesce("_spot", F.lit(0)).alias("spot"))


def describe(dust: DustMap, keys: list[str] | None = None) -> DataFrame:
    """keys, spots, smallest, largest, covered, rejected, report: one row for each key that has a spot or a rejected blob."""
    keys = keys or []
    m = dust.settings.margin
    size = F.greatest(F.greatest("w", "h") - 2 * m, F.lit(0))
    found = dust.spots.groupBy(*keys).agg(F.count("*").alias("spots"), F.min(size).alias("smallest"), F.max(size).alias("largest"))
    covered = dust.pixels.groupBy(*keys).agg(F.count("*").alias("covered"))
    both = found.join(covered, keys, "full").join(dust.rejected, keys, "full") if keys else found.join(covered).join(dust.rejected)
    n, r = F.coalesce("spots", F.lit(0)), F.coalesce("rejected", F.lit(0))
    # The report's wording is a fixed value.
    across = F.when(F.col("smallest") == F.col("largest"), F.col("smallest").cast("string")).otherwise(F.concat_ws("\u2013", "smallest", "largest"))
    share = F.format_string("%.2f", 100.0 * F.col("covered") / (dust.h * dust.w))
    some = F.concat(n, F.lit(" dust spot"), F.when(n == 1, "").otherwise("s"), F.lit(", "), across, F.lit(" px across, "), share, F.lit(" % of the frame"))
    left_out = F.when(r > 0, F.concat(F.lit(" ("), r, F.lit(" blob"), F.when(r == 1, "").otherwise("s"), F.lit(" wider than a quarter of the frame left out: not dust)"))).otherwise("")
    report = F.concat(F.when(n == 0, F.lit("no dust spots")).otherwise(some), left_out)
    return both.select(*keys, n.alias("spots"), "smallest", "largest", F.coalesce("covered", F.lit(0)).alias("covered"), r.alias("rejected"), report.alias("report"))
