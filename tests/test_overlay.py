"""Bars, coverage and blending; textures; several inputs in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterfold.operators import batch, geometry, overlay
from rasterfold.sources import images

PIXELS = "k int, y int, x int, r double, g double, b double"


def grid(spark, px):
    return spark.createDataFrame([(0, y, x, *map(float, px[y, x])) for y in range(px.shape[0]) for x in range(px.shape[1])], PIXELS)


def array(df, h, w):
    out = np.full((h, w, 3), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    return out


def test_bars_fit_and_say_what_they_are(spark):
    rows = [(0.5, None, 1000.0), (0.5, 30.0, 1000.0), (None, None, 1000.0), (0.5, 5000.0, 1000.0), (2.0, None, 1000.0), (-1.0, 40.0, 1000.0), (0.5, None, 30.0)]
    at = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, um double, want double, w double")
    got = at.orderBy("i").select(overlay.bar(F.col("um"), F.col("want"), F.col("w"), F.lit(500.0), F.lit(0.03), "plain").alias("b")).select("b.*").collect()
    assert [tuple(r) for r in got] == [(100.0, 200, "100 µm"), (30.0, 60, "30 µm"), (200.0, 200, "200 px"), (200.0, 400, "200 µm"), (500.0, 250, "500 µm"), (40.0, 40, "40 px"), (2.0, 4, "2 µm")]


@pytest.mark.parametrize(("colour", "style", "opaque"), [("white", "halo", 1.0), ("black", "box", 0.6)])
def test_burning_blends_back_then_ink(spark, colour, style, opaque):
    rng = np.random.default_rng(5)
    px = rng.random((9, 12, 3))
    outlines = spark.createDataFrame([(0, 2.5, 3.0, 6.25, 4.5), (0, -4.0, 7.75, 1.5, 20.0), (0, 5.0, 5.0, 5.0, 8.0), (0, 40.0, 1.0, 50.0, 2.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    ink = overlay.coverage(outlines, 9, 12, ["k"])
    back = overlay.halo(ink, 1, 9, 12, ["k"])
    cover = np.zeros((9, 12))
    for x0, y0, x1, y1 in [(2.5, 3.0, 6.25, 4.5), (-4.0, 7.75, 1.5, 20.0)]:
        wide = np.clip(np.minimum(np.arange(12) + 1, x1) - np.maximum(np.arange(12), x0), 0, None)
        high = np.clip(np.minimum(np.arange(9) + 1, y1) - np.maximum(np.arange(9), y0), 0, None)
        cover = np.maximum(cover, high[:, None] * wide)
    far = np.pad(cover, 1)
    grown = np.max([far[1 + dy : 10 + dy, 1 + dx : 13 + dx] for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))], axis=0)
    i, k = cover[..., None], opaque * grown[..., None]
    front, behind = (1.0, 0.0) if colour == "white" else (0.0, 1.0)
    want = (px * (1 - k) + behind * k) * (1 - i) + front * i
    assert np.abs(array(overlay.burn(grid(spark, px), ink, back, colour, style, ["k"]), 9, 12) - want).max() < 1e-12
    plain = array(overlay.burn(grid(spark, px), ink, None, colour, "plain", ["k"]), 9, 12)
    assert np.abs(plain - (px * (1 - i) + front * i)).max() < 1e-12
    none = ink.filter("false")
    assert np.array_equal(array(overlay.burn(grid(spark, px), none, overlay.halo(none, 1, 9, 12, ["k"]), colour, style, ["k"]), 9, 12), px)


def test_texture_becomes_a_file(spark):
    assert geometry.texture_size(24, 32, 0) == (24, 32) and geometry.texture_size(24, 32, 32) == (24, 32) and geometry.texture_size(1, 900, 30) == (1, 30)
    px = np.random.default_rng(6).random((12, 16, 3))
    files = images.encode(geometry.texture(grid(spark, px), 12, 16, 8, ["k"]), ["k"], 8)
    got = images.decode(files.select(F.col("k").cast("string").alias("path"), "content"))
    small = px.reshape(6, 2, 8, 2, 3).mean((1, 3))
    assert np.abs(array(got, 6, 8) * 255 - np.floor(small * 255 + 0.5)).max() < 1e-9


def test_inputs_stay_in_order(spark):
    files = spark.createDataFrame([(f,) for f in ("b/f10.png", "b/f2.png", "b/note.txt", "b/deep/f1.png", "a/x.tif")], "path string")
    rows = [(0, "b/", True), (1, "z/own.png", False), (2, "a", True), (3, "z/own.png", False)]
    inputs = spark.createDataFrame(rows, "place int, path string, is_dir boolean")
    assert [tuple(r) for r in batch.expanded(inputs, files).orderBy("n").collect()] == [(0, "b/f2.png"), (1, "b/f10.png"), (2, "z/own.png"), (3, "a/x.tif"), (4, "z/own.png")]
    with pytest.raises(Exception, match="c holds no images"):
        batch.expanded(spark.createDataFrame([(0, "c", True)], inputs.schema), files).collect()
    assert batch.expanded(inputs.filter("false"), files).count() == 0
