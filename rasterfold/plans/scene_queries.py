"""Queries over views, regions, dust and retouching: name -> function of session and folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.functions import pixels as P
from rasterfold.operators import batch, dust, geometry, overlay, refold, regions, retouch
from rasterfold.operators.keep import kept
from rasterfold.operators.stencil import reduce
from rasterfold.plans.queries import H, W, _mesh, gray, rounded
from rasterfold.sources import meshes
from rasterfold.sources.rasters import FRAMES, emb_stack, frame_list, li_stack, table

SCENE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    SCENE_QUERIES[f.__name__] = f
    return f


# ---- views

VIEWS = [-0.08, 0.0, 0.11]


@query
def shifted_proxy(spark, d):
    """Frames in blocks of 3 x 3, as three views move them."""
    return rounded(refold.moved(gray(spark, d), VIEWS, FRAMES, H, W, 3, ["v"], []))


@query
def shifted_frames(spark, d):
    """Frames in full size, resampled by parts of a pixel; seen from the other end."""
    return rounded(refold.moved(gray(spark, d), VIEWS, FRAMES, H, W, 1, ["v"], [], near_first=False))


@query
def refold_views(spark, d):
    return rounded(refold.refold(li_stack(spark, d), VIEWS, FRAMES, H, W, 2, levels=1, rule="avg"))


# ---- regions


def _bright(spark, d, least):
    return gray(spark, d).select("frame", "y", "x", (F.col("v") > least).cast("int").alias("mask"))


@query
def bright_regions(spark, d):
    return regions.regions(_bright(spark, d, 0.52), ["frame"])


@query
def region_neighbours(spark, d):
    """Regions whose windows meet the windows of others grown by two pixels."""
    lit = regions.regions(_bright(spark, d, 0.58), ["frame"])
    w = lit.groupBy("frame", "region").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    grown = w.select("frame", "region", (F.col("x") - 2).alias("x"), (F.col("y") - 2).alias("y"), (F.col("w") + 4).alias("w"), (F.col("h") + 4).alias("h"))
    return regions.windows_meeting(grown, w, ["frame"]).filter("region != other_region").select("frame", "region", "other_region")


# ---- dust


def _dusty(spark, d):
    """An evenly lit map for each frame, with two spots whose places follow the frame; texture is the frame's, faint."""
    cx, cy = 8 + F.col("frame") * 2, 8 + F.col("frame")
    near = F.pow(F.col("y") - cy, 2) + F.pow(F.col("x") - cx, 2)
    far = F.pow(F.col("y") - 16, 2) + F.pow(F.col("x") - 27, 2)
    return gray(spark, d).withColumn("v", (0.7 + 0.02 * F.col("v") + 0.004 * F.col("x")) * F.when(near < 5, 0.5).when(far < 4, 0.6).otherwise(1.0))


@query
def dust_background(spark, d):
    half = reduce(_dusty(spark, d), H, W, ["v"], ["frame"])
    return rounded(dust.map_background(half, H // 2, W // 2, 0.1, ["frame"]).select("frame", "y", "x", "bg", "mask"))


def _map(spark, d):
    return dust.detect(_dusty(spark, d), H, W, dust.DustSettings(threshold=0.1, margin=1, min_area=8), ["frame"])


@query
def dust_spots(spark, d):
    return _map(spark, d).spots


@query
def dust_report(spark, d):
    return dust.describe(_map(spark, d), ["frame"]).select("frame", "spots", "covered", "rejected", "report")


def _shot(spark, d):
    """Two shots for each map: the frame itself and its mirror image."""
    return gray(spark, d).withColumn("shot", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.when(F.col("shot") == 1, W - 1 - F.col("x")).otherwise(F.col("x")))


@query
def dust_fill(spark, d):
    return rounded(dust.fill(_shot(spark, d), _map(spark, d), ["v"], ["frame"], "shot"))


@query
def dust_flat(spark, d):
    return rounded(dust.flatten(_shot(spark, d), _map(spark, d), ["v"], ["frame"], "shot"))


@query
def mesh_stl(spark, d):
    """The triangles of the lineitem stack's relief, read back from the bytes of an STL file."""
    m = kept(_mesh(spark, d).withColumn("pz", F.round("pz", 9)))  # its triangles and their corners read it
    read = meshes.stl_triangles(meshes.stl_chunks(m, geometry.triangles(m, 8, []), 8))
    return rounded(read.select(*[F.col(f"{k}{x}").alias(f"{k}_{x}") for k in "abc" for x in "xyz"]))


@query
def mesh_texture(spark, d):
    return geometry.texture(li_stack(spark, d), H, W, 20, ["frame"])


# ---- overlays


@query
def scale_bars(spark, d):
    """Bars for pictures of many sizes, with and without a calibration or a length asked for."""
    k, v = F.col("p_partkey"), F.col("p_size")
    um = F.when(k % 4 > 0, v * 0.013 * F.pow(F.lit(10.0), k % 6 - 2))
    length = F.when(k % 5 == 0, v * 3.0 * F.pow(F.lit(10.0), k % 3))
    b = overlay.bar(um, length, 300 + 7 * v, 200 + k % 900, F.lit(0.03), "halo")
    return rounded(table(spark, d, "part").select("p_partkey", *[b[c].alias(c) for c in ("length", "px", "label")]))


@query
def burnt_bar(spark, d):
    """A bar with a halo in each frame, longer in each, its edges between pixels."""
    frame = F.col("frame")
    outlines = li_stack(spark, d).select("frame").distinct().select(frame, F.lit(3.25).alias("x0"), F.lit(18.5).alias("y0"), (frame * 3.5 + 9.75).alias("x1"), F.lit(20.75).alias("y1"))
    ink = overlay.coverage(outlines, H, W, ["frame"])
    return rounded(overlay.burn(li_stack(spark, d), ink, overlay.halo(ink, 2, H, W, ["frame"]), "white", "halo", ["frame"]))


@query
def expanded_inputs(spark, d):
    """Folders of the frame list, the last first, each after the first file in it."""
    files = frame_list(spark, d).select("path").distinct()
    dirs = files.groupBy(batch.folder(F.col("path")).alias("d")).agg(F.min("path").alias("f"))
    at = 2 * F.regexp_extract("d", "([0-9]+)$", 1).cast("int")
    inputs = dirs.select(F.explode(F.array(F.struct((-at - 1).alias("place"), F.col("f").alias("path"), F.lit(False).alias("is_dir")), F.struct((-at).alias("place"), F.concat("d", F.lit("/")).alias("path"), F.lit(True).alias("is_dir")))).alias("i")).select("i.*")
    return batch.expanded(inputs, files)


# ---- retouching


def _log(spark, d):
    """A log of strokes, undos and redos for each user: the kind of event says which."""
    e = table(spark, d, "events").withColumn("kind", F.pmod(F.col("event_id"), F.lit(7)))
    action = F.when(F.col("kind") < 3, "stroke").when(F.col("kind") < 5, "undo").otherwise("redo")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("list"), F.row_number().over(order).alias("seq"), action.alias("action"), F.col("event_id").alias("stroke"))


@query
def history_depths(spark, d):
    return retouch.depths(_log(spark, d), ["list"])


@query
def history_live(spark, d):
    return retouch.live_strokes(_log(spark, d), ["list"])


@query
def brush_strokes(spark, d):
    """The second frame of each small stack painted into its first along the strokes that are live in the log of that number."""
    s = emb_stack(spark, d)
    target, source = (s.filter(f"frame = {f}").select("stack", "y", "x", P.quantise(F.col("v"), 16).alias("v")) for f in (0, 1))
    k = F.col("k")
    live = retouch.live_strokes(_log(spark, d), ["list"]).select(F.col("list").alias("stack"), F.col("slot").alias("stroke"), F.col("stroke").alias("k"))
    dabs = live.select("stack", "stroke", k, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq")).select("stack", "stroke", "seq", (k % 7 + F.col("seq") * 1.5).cast("double").alias("dx"), (k % 8).cast("double").alias("dy"), (1 + k % 3).cast("double").alias("r"), ((k % 10) / 10).cast("double").alias("hard"))
    return retouch.replay(target, source, dabs, keys=["stack"]).select("stack", "y", "x", F.col("v").cast("long").alias("v"))
