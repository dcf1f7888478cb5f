"""A stack from frames as shot to image, winners and depth: register, resample, equalise, crop to what all frames cover, fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.functions.pixels import luma
from rasterfold.operators import bright, fuse, geometry
from rasterfold.operators.focus import DepthSettings, depth_from_focus
from rasterfold.operators.keep import kept
from rasterfold.operators.order import numbered
from rasterfold.operators.solvers import align
from rasterfold.sources import images, projects

RGB = ["r", "g", "b"]


def aligned_frames(frames: DataFrame, transforms: DataFrame, h: int, w: int, kernel: str, keys: list[str], equalise: bool = True) -> DataFrame:
    """Frames (keys, frame, y, x, r, g, b) through their transforms (keys, frame, m), with the brightness of frame 0 over what both show."""
    each = [*keys, "frame"]
    at = geometry.warp(frames, transforms, h, w, kernel, RGB, each)
    return bright.apply(at, bright.gains_aligned(at, keys), keys) if equalise else at.select(*each, "y", "x", *RGB)


def fuse_stack(frames: DataFrame, h: int, w: int, transforms: DataFrame | None = None, kernel: str = "spline4x4", levels: int | None = None, rule: str = "de", settings: DepthSettings | None = None, register: bool = True, equalise: bool = True, model: str = "similarity", coarsen: int = 0, fixed: tuple[str, ...] = (), crop: bool = True, **options) -> dict[str, DataFrame]:
    """image, winners, depth, transforms and area (x, y, w, h) of one stack (frame, y, x, r, g, b).

    The frame's size decides how deep the pyramid is, so the common area, one row, is found first. Transforms,
    aligned frames and the image are evaluated once. Without frames the area is the whole frame and the others are empty.
    Without registering, frames are taken as they lie, their brightness is that of frame 0 as a whole, and transforms is empty.
    model, coarsen and fixed go to the registration; crop says whether outputs are cut to the area.
    """
    if transforms is None and register:
        one = frames.select(F.lit(0).cast("long").alias("stack"), "frame", "y", "x", luma(*[F.col(c) for c in RGB]).alias("v"))
        transforms = kept(align(one, model, coarsen, fixed).drop("stack"))
    whole = frames.sparkSession.createDataFrame([(0, 0, w, h)], "x int, y int, w int, h int")
    if transforms is None:
        area, transforms = whole, frames.sparkSession.createDataFrame([], "frame int, m array<double>")
        at = bright.apply(frames, bright.gains_whole(frames, []), []) if equalise else frames.select("frame", "y", "x", *RGB)
    else:
        area = geometry.common_area(transforms, h, w, kernel, []) if crop else whole
        at = aligned_frames(frames, transforms, h, w, kernel, [], equalise)
    x, y, aw, ah = area.select(*"xywh").first()
    at = kept(geometry.crop(at, x, y, aw, ah))
    out = fuse.fuse(at, ah, aw, fuse.auto_levels(ah, aw) if levels is None else levels, rule, **options)
    out["image"] = kept(out["image"])
    gray = luma(*[F.col(c) for c in RGB]).alias("v")
    stack = F.lit(0).cast("long").alias("stack")
    deep = depth_from_focus(at.select(stack, "frame", "y", "x", gray), out["image"].select(stack, "y", "x", gray), ah, aw, settings)
    return {**out, "depth": deep.drop("stack"), "transforms": transforms, "area": area}


def run_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A project file's frames, read from beside it and fused by its settings: what fuse_stack returns, cut to the project's window, and frames, notes, settings.

    Frames are turned, then reduced for a draft. The names of one project's frames and one row of settings are known to the driver, pixels aren't.
    Frames that aren't found are left out with a note; none at all, or frames of different sizes, are an error.
    """
    texts = projects.texts(spark, path)
    settings = kept(projects.settings(texts))
    s = settings.first()
    listed = kept(projects.resolved(projects.frames(texts)))
    files = [r["file"] for r in listed.filter("found").select("file").distinct().collect()]
    if not files:
        raise ValueError(f"{path}: none of the frames is there")
    pixels = images.decode(spark.read.format("binaryFile").load(files)).withColumn("file", F.regexp_replace("path", "^file:/+", "/"))
    taken = numbered(listed.filter("found").select("frame", F.regexp_replace("file", "^file:/+", "/").alias("file")), ["frame"], "n").select("file", F.col("n").cast("int").alias("frame"))
    shot = kept(pixels.select("file", "y", "x", *RGB).join(taken, "file").select("frame", "y", "x", *RGB))
    sizes = shot.groupBy("frame").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).select("h", "w").distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError(f"{path}: frames differ in size")
    (h, w), turns = sizes[0], int((s["rotate"] or 0) // 90) % 4
    shot, (h, w) = geometry.rotate(shot, h, w, turns, False), ((w, h) if turns % 2 else (h, w))
    k = 2 ** (s["draft"] or 0)
    shot, h, w = geometry.draft(shot, s["draft"] or 0, RGB, ["frame"]), -(-h // k), -(-w // k)
    given = {"r": s["energy_radius"], "top_r": s["top_radius"], "halo": s["halo"], "kernel": s["kernel"], "model": s["model"], "coarsen": s["coarsen"], "rule": s["rule"]}
    deep = DepthSettings() if s["depth_scale"] is None else DepthSettings(scale=s["depth_scale"])
    out = fuse_stack(shot, h, w, levels=s["levels"], settings=deep, register=s["align"], equalise=s["brightness"], fixed=tuple(s["fixed"]), crop=s["crop"], chroma=s["chroma"], **{n: v for n, v in given.items() if v is not None})
    if s["window"]:
        x, y, aw, ah = out["area"].select(*"xywh").first()
        left, top = max(s["window"]["x"] // k, x), max(s["window"]["y"] // k, y)
        right, foot = min((s["window"]["x"] + s["window"]["w"]) // k, x + aw), min((s["window"]["y"] + s["window"]["h"]) // k, y + ah)
        if right <= left or foot <= top:
            raise ValueError(f"{path}: the window lies outside of what all frames cover")
        out |= {n: geometry.crop(out[n], left - x, top - y, right - left, foot - top) for n in ("image", "winners", "depth")}
        out["area"] = spark.createDataFrame([(left, top, right - left, foot - top)], "x int, y int, w int, h int")
    notes = settings.select("project", F.explode("notes").alias("note")).unionByName(projects.missing_note(listed))
    return {**out, "frames": listed, "notes": notes, "settings": settings}
