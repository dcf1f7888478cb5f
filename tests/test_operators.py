"""Behaviour on small scenes and worked vectors."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterfold.functions.kernels import KERNELS, binomial, expand_taps, reduce_taps, reflect
from rasterfold.operators import batch, depth, geometry, solvers
from rasterfold.operators.geometry import Transform
from rasterfold.sources import images


@given(st.integers(1, 60))
@settings(max_examples=30, deadline=None)
def test_constants_survive(n):
    for taps in (reduce_taps(n), expand_taps(n)):
        total = {}
        for o, i, w in taps:
            total[o] = total.get(o, 0) + w
        assert all(abs(v - 1) < 1e-12 for v in total.values())
    assert abs(sum(binomial(n % 5)) - 1) < 1e-12 and 0 <= reflect(-3, n) < n


@given(st.floats(0, 0.999))
@settings(max_examples=50, deadline=None)
def test_kernels_sum_to_one(t):
    assert all(abs(sum(w(t)) - 1) < 1e-9 for _, w in KERNELS.values())


def test_peaks_of_profiles(spark):
    rows = [(0, 0, 0, f, v) for f, v in enumerate([0.1, 0.5, 0.2, 0.4, 0.3])] + [(1, 0, 0, f, v) for f, v in enumerate([0.9, 0.2, 0.1])] + [(2, 0, 0, 0, 0.7)]
    got = {r["stack"]: r for r in depth.peaks(spark.createDataFrame(rows, "stack int, y int, x int, frame int, v double"), ["stack"]).collect()}
    assert (got[0]["c1"], got[0]["i1"], got[0]["c2"]) == (0.5, 1, 0.4)
    assert (got[1]["i1"], got[1]["l"], got[1]["c2"]) == (0, -1.0, None) and got[2]["i1"] == 0


def test_lists(spark):
    assert batch.skip_list("3,7-9,12", 20) == [2, 6, 7, 8, 11]
    for bad in ("9-7", "0", "x", "5-30"):
        with pytest.raises(ValueError):
            batch.skip_list(bad, 20)
    assert depth.slab_ranges(10, 4, 1) == [(0, 3), (3, 6), (6, 9)] and depth.slab_ranges(0, 3, 1) == []
    df = spark.createDataFrame([(0, "f10.tif"), (1, "f2.tif"), (2, "f02.tif"), (3, "f1.tif")], "pos int, path string").withColumn("list", batch.F.lit(0))
    assert [r["path"] for r in batch.natural_order(df, ["list"], "pos").orderBy("n").collect()] == ["f1.tif", "f2.tif", "f02.tif", "f10.tif"]


def test_wls_fills_a_ramp():
    y, x = np.mgrid[0:24, 0:32].astype(float)
    conf = np.ones_like(x)
    conf[6:18, 8:20] = 0
    d = np.where(conf > 0, x, 100.0)
    out = solvers.wls(d, conf, np.zeros_like(x), 1.0, 0.1)
    assert np.abs(out - x)[8:16, 10:18].max() < 1.5


def test_registration_finds_a_shift():
    y, x = np.mgrid[0:64, 0:64].astype(float)
    scene = lambda a, b: np.sin(0.3 * a) + np.cos(0.23 * b) + 0.5 * np.sin(0.11 * a * 1.3 + 0.17 * b)
    t = solvers.align_pair(scene(x, y), scene(x - 2, y + 1), Transform(), (0, 1))
    assert abs(t.xoff * 64 + 2) < 0.1 and abs(t.yoff * 64 - 1) < 0.1


@pytest.mark.parametrize("bits", [8, 16])
def test_images_round_trip(bits):
    px = np.random.default_rng(bits).integers(0, 1 << bits, (5, 7, 3))
    for encode, decode in ((images.encode_png, images.decode_png), (images.encode_tiff, images.decode_tiff)):
        got, b = decode(encode(px, bits))
        assert b == bits and (np.round(got * ((1 << bits) - 1)) == px).all()


def test_metadata_is_absent_when_malformed():
    exif = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 306, 2, 20, 26) + b"\0\0\0\0" + b"2024:05:06 07:08:09\0"
    assert images.metadata(exif)["taken"] == "2024:05:06 07:08:09"
    assert images.metadata(b"\xff\xd8\xff\xe1\0")["exif"] is None and images.metadata(b"")["icc"] is None


def test_folder_reads_back(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (4, 6, 3))
    (tmp_path / "a.PNG").write_bytes(images.encode_png(px, 8))
    (tmp_path / "note.txt").write_text("x")
    rows = images.decode(images.read_folder(spark, str(tmp_path))).collect()
    assert len(rows) == 24 and all(round(r["r"] * 255) == px[r["y"], r["x"], 0] for r in rows)


def test_settle_and_quiet(spark):
    from rasterfold.streaming import watch

    rows = [("a", 10, 1.0, 0.0), ("a", 10, 1.0, 1.0), ("a", 10, 1.0, 2.5), ("a", 10, 1.0, 4.0), ("b", 1, 1.0, 0.0), ("b", 2, 1.5, 2.5), ("b", 2, 1.5, 4.6)]
    got = watch.settle(spark.createDataFrame(rows, "path string, size long, mtime double, at double")).collect()
    assert sorted((r["path"], r["at"]) for r in got) == [("a", 2.5), ("b", 4.6)]
    files = spark.sql("select 0 watch, timestamp_seconds(t) ts, concat('f', t) path from values (0), (5), (30) v(t)")
    assert sorted(len(r["files"]) for r in watch.close_quiet(files, 10).collect()) == [1, 2]


def test_transform_goes_from_the_frame_to_the_result():
    t = Transform(xoff=0.1, yoff=-0.05, scale=1.2, rot=0.3, aspect=1.1, shear=0.05, px=0.02, py=-0.03)
    h, w = 40, 60
    m, back = np.array(t.matrix(h, w)).reshape(3, 3), np.array(t.inverse(h, w)).reshape(3, 3)
    both = m @ back
    assert np.abs(both / both[2, 2] - np.eye(3)).max() < 1e-12 and back[2, 2] == 1
    centre = m @ [w / 2, h / 2, 1]
    assert np.allclose(centre[:2] / centre[2], [w / 2 + 6, h / 2 - 2])
    # The linear part: shear and aspect first, then the turn, then the scale.
    u = np.array([3.0, 4.0])
    turned = 1.2 * np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]]) @ [u[0] + 0.05 * u[1], 1.1 * u[1]] + [6, -2]
    got = m @ [w / 2 + 3, h / 2 + 4, 1]
    assert np.allclose(got[:2] / got[2] - [w / 2, h / 2], (turned + np.array([w / 2, h / 2]) * (0.02 * 3 / w - 0.03 * 4 / h)) / (1 + 0.02 * 3 / w - 0.03 * 4 / h) - np.array([w / 2, h / 2]) * (0.02 * 3 / w - 0.03 * 4 / h) / (1 + 0.02 * 3 / w - 0.03 * 4 / h))
    assert Transform().inverse(24, 32) == np.eye(3).ravel().tolist()


def test_common_area_has_the_kernels_margin(spark):
    def area(ts, kernel):
        df = spark.createDataFrame([(1, i, t.inverse(20, 30)) for i, t in enumerate(ts)], "stack long, frame int, m array<double>")
        return tuple(geometry.common_area(df, 20, 30, kernel, ["stack"]).collect()[0])[1:]

    assert area([Transform()], "spline4x4") == (0, 0, 30, 20)
    assert area([Transform(), Transform(xoff=0.1)], "nearest") == (3, 0, 27, 20)
    assert area([Transform(xoff=0.1), Transform(xoff=-0.1, yoff=0.1)], "bilinear") == (4, 3, 22, 16)
    assert area([Transform(xoff=2.0)], "bilinear") == (0, 0, 30, 20)


def test_report_names_what_differs():
    assert solvers.report(Transform(xoff=0.1, rot=0.01), 10, 20) == "dx=  +2.00px dy=  +0.00px scale=1.00000 rot=+0.573 deg"
    assert solvers.report(Transform(shear=0.5, px=0.25), 10, 20).endswith(" aspect=1.00000 shear=+0.50000 persp=+0.25000/+0.00000")
