"""Queries over the derived rasters and lists: name -> function of session and folder."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.functions import pixels as P
from rasterfold.functions.kernels import KERNELS, bilinear_taps, burt_taps
from rasterfold.operators import batch, bright, depth, focus, fuse, geometry, run, solvers, stencil
from rasterfold.operators.geometry import Transform
from rasterfold.operators.order import numbered
from rasterfold.sources import projects
from rasterfold.sources.rasters import FRAMES, HEIGHT, WIDTH, captures, emb_stack, frame_list, li_stack, table

RGB = ["r", "g", "b"]
H, W = HEIGHT, WIDTH
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, as sums depend on their order. The tables hold short decimals, so results often lie halfway between
    two roundings: a hair is added first. + 0.0 turns a negative zero into zero."""
    return df.select(*[(F.round(F.col(c) + 2.7e-10, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def gray(spark: SparkSession, d: str) -> DataFrame:
    return li_stack(spark, d).select("frame", "y", "x", P.luma(*[F.col(c) for c in RGB]).alias("v"))


#: Transforms of the warp queries: fixed, so that kernels can be compared.
def transforms(spark: SparkSession) -> DataFrame:
    rows = [(f, Transform(xoff=0.01 * f, yoff=-0.006 * f, scale=1 + 0.004 * f, rot=0.01 * f).inverse(H, W)) for f in range(FRAMES)]
    return spark.createDataFrame(rows, "frame int, m array<double>")


def level0(spark: SparkSession, d: str) -> DataFrame:
    return fuse.pyramid(li_stack(spark, d), H, W, 1, RGB, ["frame"])[0]


def winners(spark: SparkSession, d: str) -> DataFrame:
    return fuse.fold(fuse.region_energy(level0(spark, d), H, W, ["frame"]), [])


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return emb_stack(spark, d)


def depths(spark: SparkSession, d: str, gate: float = 0.5) -> DataFrame:
    found = depth.peaks(profiles(spark, d), ["stack"])
    return depth.finish(found, depth.noise_floor(found, ["stack"], 8), gate, ["stack"])


# ---- rasters and pixels


@query
def raster(spark, d):
    return rounded(li_stack(spark, d))


@query
def luma(spark, d):
    return rounded(gray(spark, d))


@query
def srgb_curve(spark, d):
    v = F.col("v") * 2 - 0.5
    return rounded(gray(spark, d).select("frame", "y", "x", P.srgb_encode(v).alias("e"), P.srgb_decode(v).alias("d")))


# The sRGB primaries' matrix to XYZ stands for a camera's.
LOOK = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
BALANCE = [1.9, 1.0, 1.4]


@query
def look_space(spark, d):
    out = P.to_look([F.col(c) for c in RGB], BALANCE, LOOK)
    return rounded(li_stack(spark, d).select("frame", "y", "x", *[v.alias(c) for v, c in zip(out, RGB)]))


@query
def camera_space(spark, d):
    """Look space back to camera space, by the inverse of the matrix."""
    out = P.from_look([F.col(c) for c in RGB], BALANCE, np.linalg.inv(LOOK).tolist())
    return rounded(li_stack(spark, d).select("frame", "y", "x", *[v.alias(c) for v, c in zip(out, RGB)]))


@query
def quantise(spark, d):
    v = F.col("v") * 1.4 - 0.2
    return gray(spark, d).select("frame", "y", "x", P.quantise(v, 16).alias("q16"), P.quantise(v, 8).alias("q8"), P.display8(P.quantise(v, 16)).alias("d8"))


@query
def gray_stretch(spark, d):
    g = gray(spark, d)
    ends = g.groupBy("frame").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return g.join(F.broadcast(ends), "frame").select("frame", "y", "x", F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * 255 + 0.5).cast("int").alias("v"))


@query
def turbo_map(spark, d):
    return rounded(gray(spark, d).select("frame", "y", "x", *[v.alias(c) for v, c in zip(P.turbo(P.clamp(F.col("v"))), RGB)]), 5)


@query
def rotate_mirror(spark, d):
    return rounded(geometry.rotate(gray(spark, d), H, W, 1, True))


@query
def crop(spark, d):
    return rounded(geometry.crop(gray(spark, d), 5, 3, 20, 15))


@query
def rect_intersect(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y"), (F.col("l_linenumber") * 5).alias("w"), (F.col("l_quantity").cast("int")).alias("h"), (F.col("l_partkey") % 37).alias("x2"), (F.col("l_suppkey") % 41).alias("y2"), F.lit(12).alias("w2"), F.lit(9).alias("h2"))
    return geometry.intersect(t).select(*[F.col(c).cast("long").alias(c) for c in ("ix", "iy", "iw", "ih")]).groupBy("ix", "iy", "iw", "ih").agg(F.count("*").alias("n"))


# ---- stencils


@query
def reduce(spark, d):
    return rounded(stencil.reduce(gray(spark, d), H, W, ["v"], ["frame"]))


@query
def expand(spark, d):
    return rounded(stencil.expand(stencil.reduce(gray(spark, d), H, W, ["v"], ["frame"]), H, W, ["v"], ["frame"]))


@query
def laplacian(spark, d):
    return rounded(level0(spark, d))


@query
def reconstruct(spark, d):
    return rounded(fuse.collapse(fuse.pyramid(li_stack(spark, d), H, W, 2, RGB, ["frame"]), H, W, RGB, ["frame"]))


@query
def registration_reduce(spark, d):
    return rounded(stencil.separable(gray(spark, d), burt_taps(H), burt_taps(W), ["v"], ["frame"]))


@query
def box_mean(spark, d):
    return rounded(stencil.box(gray(spark, d), 2, ["v"], ["frame"]))


@query
def guided_filter(spark, d):
    g = gray(spark, d)
    first = g.filter("frame = 0").select("y", "x", F.col("v").alias("g"))
    return rounded(stencil.guided(g.filter("frame > 0").join(first, ["y", "x"]), "g", "v", 2, 0.001, ["frame"]).select("frame", "y", "x", "out"))


@query
def ring_difference(spark, d):
    return rounded(stencil.convolve(gray(spark, d), stencil.ring_taps(1, 3), H, W, "v", ["frame"]).withColumn("v", F.abs("v")))


@query
def modified_laplacian(spark, d):
    return rounded(stencil.modified_laplacian(gray(spark, d), 1, H, W, "v", ["frame"]))


@query
def block_mean(spark, d):
    return rounded(stencil.block_mean(gray(spark, d), 5, ["v"], ["frame"]))


@query
def bilinear_upsample(spark, d):
    small = stencil.block_mean(gray(spark, d), 4, ["v"], ["frame"])
    return rounded(stencil.separable(small, bilinear_taps(6, H, 4), bilinear_taps(8, W, 4), ["v"], ["frame"]))


@query
def nearest_upsample(spark, d):
    small = stencil.block_mean(gray(spark, d), 4, ["v"], ["frame"]).withColumnsRenamed({"y": "cy", "x": "cx"})
    grid = gray(spark, d).select("frame", "y", "x", F.least(F.floor(F.col("y") / 4), F.lit(5)).cast("int").alias("cy"), F.least(F.floor(F.col("x") / 4), F.lit(7)).cast("int").alias("cx"))
    return rounded(grid.join(small, ["frame", "cy", "cx"]).select("frame", "y", "x", "v"))


@query
def median3(spark, d):
    return rounded(stencil.median3(gray(spark, d), H, W, "v", ["frame"]))


@query
def area_shrink(spark, d):
    return rounded(geometry.shrink(gray(spark, d), H, W, 7, 9, ["v"], ["frame"]))


@query
def dilate_disk(spark, d):
    return rounded(stencil.dilate_disk(gray(spark, d), H, W, 2, "v", ["frame"]))


@query
def dilate_square(spark, d):
    return rounded(stencil.dilate_square(gray(spark, d), 2, "v", ["frame"]))


@query
def local_contrast(spark, d):
    return rounded(stencil.local_contrast(gray(spark, d), 3, "v", ["frame"]))


# ---- brightness


@query
def brightness_means(spark, d):
    return rounded(bright.means(li_stack(spark, d), []))


@query
def brightness_gains(spark, d):
    return rounded(bright.gains_whole(li_stack(spark, d), []))


@query
def equalised(spark, d):
    s = li_stack(spark, d)
    return rounded(bright.apply(s, bright.gains_whole(s, []), []))


# ---- fold


@query
def region_energy(spark, d):
    return rounded(fuse.region_energy(level0(spark, d), H, W, ["frame"]).select("frame", "y", "x", "e"), 8)


@query
def winner_map(spark, d):
    return rounded(winners(spark, d).select("y", "x", "winner", "e"), 8)


@query
def winner_shares(spark, d):
    return rounded(fuse.winner_shares(winners(spark, d), FRAMES))


@query
def share_note(spark, d):
    return fuse.share_note(fuse.winner_shares(winners(spark, d), FRAMES)).select("least", "most", F.size("under").cast("long").alias("under"))


@query
def cull_frames(spark, d):
    frames = spark.range(FRAMES).select(F.col("id").cast("int").alias("frame"))
    return batch.cull(frames, fuse.winner_shares(winners(spark, d), FRAMES), 14.0)


@query
def halo_fused(spark, d):
    return rounded(fuse.halo_level(fuse.region_energy(level0(spark, d), H, W, ["frame"]), 2.0, []))


def _top(spark, d):
    s = li_stack(spark, d)
    top = stencil.reduce(s, H, W, RGB, ["frame"])
    marks = fuse.deviation_entropy(top.select("frame", "y", "x", P.luma(*[F.col(c) for c in RGB]).alias("v")), H // 2, W // 2, 1, 16, ["frame"])
    return top.join(marks.withColumn("dev", F.round("dev", 10)).withColumn("ent", F.round("ent", 10)), ["frame", "y", "x"])


@query
def deviation_entropy(spark, d):
    return rounded(_top(spark, d).select("frame", "y", "x", "dev", "ent"))


@query
def residual_pareto(spark, d):
    return rounded(fuse.residual(_top(spark, d), "de", []))


@query
def residual_deviation(spark, d):
    return rounded(fuse.residual(_top(spark, d), "dev", []))


@query
def residual_mean(spark, d):
    return rounded(fuse.residual(_top(spark, d), "avg", []))


@query
def fused_image(spark, d):
    return rounded(fuse.fuse(li_stack(spark, d), H, W, 1, rule="avg")["image"])


@query
def fused_deep(spark, d):
    return rounded(fuse.fuse(li_stack(spark, d), H, W, 2, rule="de", top_r=1, bins=16)["image"])


# ---- depth


@query
def focus_peaks(spark, d):
    return rounded(depth.peaks(profiles(spark, d), ["stack"]))


@query
def noise_floor(spark, d):
    return rounded(depth.noise_floor(depth.peaks(profiles(spark, d), ["stack"]), ["stack"], 8))


@query
def depth_confidence(spark, d):
    return rounded(depths(spark, d).select("stack", "y", "x", "depth", "conf"))


@query
def confidence_p90(spark, d):
    return rounded(depth.normalise(depths(spark, d).select("stack", "y", "x", "conf"), ["stack"], 8))


@query
def edge_weights(spark, d):
    return rounded(depth.edge_weights(gray(spark, d), 0.1, ["frame"]))


def _li_depth(spark, d):
    """Depth of the RGB stack: the winner as a number."""
    return winners(spark, d).select("y", "x", F.col("winner").cast("double").alias("depth"))


@query
def weighted_average(spark, d):
    contrast = stencil.modified_laplacian(gray(spark, d), 1, H, W, "v", ["frame"])
    floor = contrast.groupBy("y", "x").agg(F.min("v").alias("floor"))
    return rounded(depth.weighted_average(li_stack(spark, d), contrast, floor, []))


@query
def depth_render(spark, d):
    layers = li_stack(spark, d).withColumn("lo", F.col("frame").cast("double")).withColumn("hi", F.col("frame").cast("double"))
    return rounded(depth.render_by_depth(layers, _li_depth(spark, d), []))


@query
def slab_fold(spark, d):
    rated = fuse.region_energy(level0(spark, d), H, W, ["frame"])
    return rounded(fuse.fold(depth.in_slabs(rated, depth.slab_ranges(FRAMES, 3, 1)), ["slab"]).select("slab", "y", "x", "winner", "e"), 8)


@query
def slab_render(spark, d):
    ranges = depth.slab_ranges(FRAMES, 3, 1)
    mean = depth.in_slabs(li_stack(spark, d), ranges).groupBy("slab", "y", "x").agg(*[F.avg(c).alias(c) for c in RGB])
    ends = spark.createDataFrame([(s, float(a), float(b)) for s, (a, b) in enumerate(ranges)], "slab int, lo double, hi double")
    return rounded(depth.render_by_depth(mean.join(F.broadcast(ends), "slab"), _li_depth(spark, d), []))


@query
def focus_peaking(spark, d):
    rated = fuse.region_energy(level0(spark, d), H, W, ["frame"]).select("frame", "y", "x", F.round("e", 8).alias("e"))
    return depth.peaking(rated, 0.8, [])


@query
def depth_slice(spark, d):
    return depth.slice_of(depths(spark, d), 4).select("stack", "y", "x")


@query
def frame_pick(spark, d):
    return depth.pick_frame(winners(spark, d).select("y", "x", "winner"), H, W, [])


@query
def in_focus_render(spark, d):
    contrast = stencil.local_contrast(gray(spark, d).filter("frame = 3"), 2, "v", []).select("y", "x", F.col("v").alias("contrast"))
    frame = li_stack(spark, d).filter("frame = 3").drop("frame")
    return rounded(depth.in_focus(frame, _li_depth(spark, d), contrast, 3, 0.7, 0.5, 2.5, []))


# ---- geometry


def _warped(kernel: str):
    def f(spark, d):
        return rounded(geometry.warp(gray(spark, d), transforms(spark), H, W, kernel, ["v"], ["frame"]), 5)

    return f


for _k in KERNELS:
    QUERIES[f"warp_{_k}"] = _warped(_k)


def embedded_transforms(spark, d):
    """stack, frame, m: a transform for each vector, of its first six components; every frame of an 8 x 8 stack is moved by its own."""
    e = lambda k, by: F.get("embedding", k).cast("double") * by
    m = F.array(1 + e(0, 0.1), e(1, 0.1), e(2, 2.0), e(3, 0.1), 1 + e(4, 0.1), e(5, 2.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return table(spark, d, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("stack"), (F.col("vec_id") % 10).cast("int").alias("frame"), m.alias("m"))


@query
def common_area(spark, d):
    return geometry.common_area(embedded_transforms(spark, d), 8, 8, "bilinear", ["stack"])


@query
def aligned_gains(spark, d):
    at = geometry.warp(li_stack(spark, d), transforms(spark), H, W, "bilinear", RGB, ["frame"])
    return rounded(bright.gains_aligned(at, []), 5)


@query
def restretch(spark, d):
    return rounded(geometry.resize(geometry.crop(gray(spark, d), 4, 2, 24, 20), 20, 24, H, W, "spline4x4", ["v"], ["frame"]))


def _view(spark, d, shift):
    z = _li_depth(spark, d).select("y", "x", (F.col("depth") / (FRAMES - 1)).alias("z"))
    return geometry.sheared(li_stack(spark, d).filter("frame = 0").drop("frame").join(z, ["y", "x"]), W, shift, [])


@query
def sheared_view(spark, d):
    return rounded(_view(spark, d, 0.07).select("y", "x", *RGB))


@query
def anaglyph(spark, d):
    return rounded(geometry.stereo(_view(spark, d, -0.05), _view(spark, d, 0.05), W, "anaglyph", []))


@query
def stereo_pair(spark, d):
    return rounded(geometry.stereo(_view(spark, d, -0.05), _view(spark, d, 0.05), W, "parallel", []))


@query
def stereo_crossed(spark, d):
    return rounded(geometry.stereo(_view(spark, d, -0.05), _view(spark, d, 0.05), W, "crossed", []))


@query
def rocking_shifts(spark, d):
    """The frames of each list as the views of one loop."""
    lists = captures(spark, d)
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"))
    return rounded(lists.join(sizes, "list").select("list", "frame", geometry.rocking(0.03, F.col("frame"), F.col("n")).alias("shift")))


def _mesh(spark, d):
    z = _li_depth(spark, d).select("y", "x", (F.col("depth") / (FRAMES - 1)).alias("v"))
    return geometry.heightfield(z, H, W, 8, 6, 0.3, True, [])


@query
def heightfield(spark, d):
    return rounded(_mesh(spark, d))


@query
def mesh_triangles(spark, d):
    return geometry.triangles(_mesh(spark, d).withColumn("pz", F.round("pz", 9)), 8, []).select(*[F.col(c).cast("long").alias(c) for c in "abc"])


@query
def mesh_obj(spark, d):
    m = _mesh(spark, d).withColumn("pz", F.round("pz", 9))
    return geometry.obj_lines(m, geometry.triangles(m, 8, []), 8)


# ---- lists


def _frames(spark, d):
    return numbered(frame_list(spark, d), ["conv_id", "turn"], "pos").select("pos", "path")


@query
def natural_order(spark, d):
    return batch.natural_order(_frames(spark, d), [], "pos").select("n", "path")


@query
def split_gap(spark, d):
    return batch.split_gap(captures(spark, d), 86400.0, ["list"]).groupBy("list", "stack").agg(F.count("*").alias("n"), F.min("frame").alias("first"))


@query
def split_count(spark, d):
    return batch.split_count(captures(spark, d), 4, ["list"]).groupBy("list", "stack").agg(F.count("*").alias("n"))


@query
def split_dir(spark, d):
    return batch.split_dir(_frames(spark, d), "pos").select("pos", "stack")


@query
def split_dir_runs(spark, d):
    return batch.split_dir(_frames(spark, d), "pos", consecutive=True).select("pos", "stack")


@query
def split_info(spark, d):
    return rounded(batch.split_info(batch.split_gap(captures(spark, d), 86400.0, ["list"]), ["list"]))


@query
def reverse_frames(spark, d):
    return rounded(batch.reverse(captures(spark, d), ["list"]))


@query
def skip_frames(spark, d):
    return batch.without(_frames(spark, d), batch.skip_list("3,7-9,12", 400), "pos").select("pos", "path")


@query
def path_parts(spark, d):
    p = F.col("path")
    return _frames(spark, d).select("pos", batch.stem(p).alias("stem"), batch.dir_name(p).alias("dir"), batch.is_image(p).alias("image"))


@query
def output_names(spark, d):
    f = _frames(spark, d)
    f = f.crossJoin(F.broadcast(f.agg(F.count("*").alias("count"))))
    n = (F.col("pos") + 1).cast("int")
    args = (n, F.col("count"), batch.stem(F.col("path")), batch.dir_name(F.col("path")))
    return f.select("pos", batch.output_name(F.lit("out/{dir}_{n}_{first}.tif"), *args).alias("a"), batch.output_name(F.lit("out/fused.tif"), *args).alias("b"))


@query
def clock_caption(spark, d):
    c = captures(spark, d).filter("frame = 0")
    return c.select("list", batch.clock(F.col("t")).alias("clock"), batch.caption(F.lit("{date} {time} n={n} of {frames}"), F.col("t"), F.lit(7), F.lit("f"), F.col("list")).alias("caption"))


@query
def exif_time(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy:MM:dd HH:mm:ss").alias("s"))
    bad = F.when(F.col("event_id") % 11 == 0, "0000:00:00 00:00:00").otherwise(F.col("s"))
    return rounded(e.select("event_id", batch.parse_time(bad, F.when(F.col("event_id") % 2 == 0, "25")).alias("t")), 3)


@query
def near_end(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("list"), F.col("event_id").alias("frame"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("dist"))
    return batch.near_end(e, ["list"])


@query
def nice_lengths(spark, d):
    v = F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_partkey") % 7 - 3)
    return rounded(table(spark, d, "part").select("p_partkey", batch.nice_length(v).alias("near"), batch.nice_floor(v).alias("floor")))


@query
def unit_lengths(spark, d):
    units = F.array(*[F.lit(u) for u in (" mm", "um", " nm", "", " inch", " parsec", " cm.")])
    s = F.concat((F.col("p_size") / 4).cast("string"), F.get(units, (F.col("p_partkey") % 7).cast("int")))
    return rounded(table(spark, d, "part").select("p_partkey", batch.length_um(s).alias("um")))


@query
def capture_times(spark, d):
    """When frames were taken, of several dates of which some are absent or damaged: the first readable one counts."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    written = lambda hours, style: F.date_format(ts + F.make_dt_interval(hours=F.lit(hours)), style)
    exif, xmp = "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"
    original = F.when(k % 2 == 0, F.when(k % 3 == 0, "2024:13:01 00:00:00").otherwise(written(0, exif)))
    digitised, plain = F.when(k % 5 == 0, written(1, exif)), F.when(k % 7 < 3, written(2, exif))
    shot = F.when(k % 11 < 5, F.concat(written(3, xmp), F.lit(".5+02:00")))
    modified = F.when(k % 13 < 6, written(4, xmp))
    none = F.lit(None).cast("string")
    at = batch.capture_time(batch.parse_time(original, F.lit("250")), *[batch.parse_time(s, none) for s in (digitised, plain, shot, modified)])
    return rounded(table(spark, d, "events").select("event_id", at.alias("t")), 3)


@query
def subject_distances(spark, d):
    k, v = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 5 == 0, F.concat(v, F.lit("/0"))).when(k % 5 == 1, "4294967295/1").when(k % 5 == 2, F.concat(F.lit(" "), v, F.lit("/8 "))).when(k % 5 == 3, (v / 4).cast("string")).otherwise("0/1")
    return rounded(table(spark, d, "part").select("p_partkey", batch.subject_distance(text).alias("metres")))


@query
def pixel_sizes(spark, d):
    k, v = F.col("p_partkey"), F.col("p_size")
    ome = F.concat(F.lit('<Pixels PhysicalSizeX="'), v / 8, F.when(k % 3 == 0, '" PhysicalSizeXUnit="nm').when(k % 3 == 1, '" PhysicalSizeXUnit="parsec').otherwise(""), F.lit('">'))
    imagej = F.concat(F.lit("ImageJ=1.54f\n"), F.when(k % 3 == 0, "unit=micron\n").when(k % 3 == 1, "unit=mm\nloop=0\n").otherwise(""))
    text = F.when(k % 7 == 0, ome).when(k % 7 == 1, imagej).when(k % 7 < 5, "a frame")
    make = F.when(k % 7 == 2, "a camera")
    size = batch.pixel_size(text, make, F.when(k % 9 > 0, v / 2), F.when(k % 4 > 0, (k % 4).cast("int")))
    return rounded(table(spark, d, "part").select("p_partkey", size["um"].alias("um"), size["source"].alias("source")))


@query
def length_labels(spark, d):
    v = F.col("p_retailprice") * 1.0003 * F.pow(F.lit(10.0), F.col("p_partkey") % 9 - 5)  # prices alone lie halfway between two labels
    return table(spark, d, "part").select("p_partkey", batch.length_label(F.when(F.col("p_partkey") % 10 > 0, v)).alias("label"), batch.length_label(batch.nice_length(v)).alias("nice"))


@query
def focus_specs(spark, d):
    """Measures and ways of upsampling as they are written in settings, some of them wrong."""
    k, v = F.col("p_partkey"), F.col("p_size").cast("string")
    measure = F.when(k % 6 == 0, "rdf").when(k % 6 == 1, F.concat(F.lit("rdf:"), v)).when(k % 6 == 2, F.concat(F.lit("rdf:"), v, F.lit(":9"))).when(k % 6 == 3, F.concat(F.lit("sml:"), v)).when(k % 6 == 4, "sml:x").otherwise(v)
    up = F.when(k % 5 == 0, "bilinear").when(k % 5 == 1, F.concat(F.lit("guided:"), v)).when(k % 5 == 2, F.concat(F.lit("guided:"), v, F.lit(":0.5"))).when(k % 5 == 3, "guided").otherwise("guided:1:x")
    m, u = batch.focus_measure(measure), batch.upsampling(up)
    return table(spark, d, "part").select("p_partkey", *[m[c].alias(c) for c in ("kind", "inner", "outer", "step")], *[u[c].alias(c) for c in ("radius", "eps")])


def _projects(spark, d):
    """A project file for each list of captures: some of its frames are switched off, its settings follow the number of the list."""
    k = F.col("list")
    c = captures(spark, d)
    frame = F.struct(F.concat(F.lit("f"), "frame", F.lit(".tif")).alias("name"), F.when(F.col("frame") % 3 > 0, F.concat(F.lit("shoot/f"), "frame", F.lit(".tif"))).alias("path"), F.when(F.col("frame") % 4 == 0, True).alias("off"))
    lists = c.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("frame", frame.alias("f")))).alias("_f"))
    params = F.struct((k % 2 == 0).alias("align"), (k % 3 > 0).alias("shift"), (k % 5 > 0).alias("rotation"), (k % 7).alias("coarsen"), F.when(k % 4 > 0, "lanczos3").alias("interp"), (k % 6).alias("levels"), F.when(k % 8 == 0, "deep").otherwise((k % 8).cast("string")).alias("halo"), F.when(k % 3 == 0, "gap").when(k % 3 == 1, "dir").otherwise("other").alias("split"))
    save = F.struct(F.array(F.lit("lap"), F.when(k % 2 == 0, "stereo").otherwise("winner"), F.when(k % 3 == 0, "mesh").otherwise("depth16")).alias("sel"), F.when(k % 4 == 0, "jpeg").alias("sv-format"), (k % 5 > 0).alias("sv-crop"), (k / 4).cast("string").alias("v3-shift"))
    crop = F.struct((k + 0.75).alias("x"), k.alias("y"), F.when(k % 2 == 0, 30).alias("w"), F.lit(20).alias("h"))
    text = F.to_json(F.struct(F.lit(1).alias("stack_project"), F.concat(F.lit("list"), k).alias("name"), F.transform("_f", lambda f: f["f"]).alias("frames"), params.alias("params"), save.alias("save"), F.struct(crop.alias("crop")).alias("run")))
    return lists.select(k.cast("string").alias("project"), text.alias("text"))


@query
def project_settings(spark, d):
    s = projects.settings(_projects(spark, d))
    return s.select("project", "output", "align", F.array_join("fixed", " ").alias("fixed"), "brightness", "coarsen", "kernel", "levels", "split.by", "split.size", "window.x", "window.w", "crop", F.array_join("outputs", " ").alias("outputs"), "stereo.shift", "stereo.layout", "mesh.form", F.array_join("notes", "; ").alias("notes"))


@query
def project_frames(spark, d):
    return projects.frames(_projects(spark, d)).select("project", "frame", "name", "path")


# ---- solvers


@query
def smoothed_depth(spark, d):
    g = emb_stack(spark, d).filter("frame = 0").select("stack", "y", "x", F.col("v").alias("guide"))
    return rounded(solvers.smooth_depth(depths(spark, d).join(g, ["stack", "y", "x"]), 0.5, 0.2, 1.0))


@query
def smoothed_sweeps(spark, d):
    g = emb_stack(spark, d).filter("frame = 0").select("stack", "y", "x", F.col("v").alias("guide"))
    return rounded(solvers.smooth_depth(depths(spark, d).join(g, ["stack", "y", "x"]), 0.5, 0.2, 0.0, "fgs"))


@query
def registration(spark, d):
    return rounded(solvers.align(gray(spark, d).withColumn("stack", F.lit(0).cast("long"))).drop("m"), 5)


# ---- stacks as a whole


def _li_gray(spark, d):
    return gray(spark, d).withColumn("stack", F.lit(0).cast("long"))


def _li_guide(spark, d):
    """The mean of all frames' luma, in place of a fused image."""
    return _li_gray(spark, d).groupBy("stack", "y", "x").agg(F.avg("v").alias("v"))


@query
def expand_linear(spark, d):
    return rounded(stencil.expand_linear(stencil.reduce(gray(spark, d), H, W, ["v"], ["frame"]), H, W, ["v"], ["frame"]))


@query
def draft_reduce(spark, d):
    return rounded(geometry.draft(li_stack(spark, d), 3, RGB, ["frame"]))


@query
def focus_volume(spark, d):
    guide = stencil.block_mean(_li_guide(spark, d), 2, ["v"], ["stack"]).withColumnRenamed("v", "g")
    slices = focus.focus_slices(_li_gray(spark, d), H, W, ("ring", 1, 3), 2, ["stack"])
    return rounded(focus.aggregated(slices, guide, 2, 1e-3, ["stack"]).drop("stack"), 5)


@query
def guided_upsample(spark, d):
    guide = _li_guide(spark, d)
    small = stencil.block_mean(_li_gray(spark, d), 4, ["v"], ["stack", "frame"]).join(stencil.block_mean(guide, 4, ["v"], ["stack"]).withColumnRenamed("v", "g"), ["stack", "y", "x"])
    full = _li_gray(spark, d).select("stack", "frame", "y", "x").join(guide.withColumnRenamed("v", "g"), ["stack", "y", "x"])
    return rounded(focus.guided_upsample(small, full, "v", H, W, 4, 1, 0.01, ["stack", "frame"]).drop("stack"), 5)


@query
def depth_from_focus(spark, d):
    return rounded(focus.depth_from_focus(_li_gray(spark, d), _li_guide(spark, d), H, W), 5)


@query
def aligned_frames(spark, d):
    at = run.aligned_frames(li_stack(spark, d), transforms(spark), H, W, "bilinear", [])
    return rounded(geometry.crop(at, 3, 2, 24, 18), 5)


@query
def stack_fused(spark, d):
    return rounded(run.fuse_stack(li_stack(spark, d), H, W, levels=1, bins=16, top_r=1)["image"], 5)


@query
def stack_depth(spark, d):
    return rounded(run.fuse_stack(li_stack(spark, d), H, W, levels=1, rule="avg")["depth"], 4)
