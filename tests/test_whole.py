"""Queries use all of their input. Where a query's SQL keeps a part of the rows, the test leaves that part's condition out of its own copy."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterfold.operators import batch, solvers
from rasterfold.operators.geometry import Transform
from rasterfold.plans.oracle import ORACLE_SQL
from rasterfold.plans.queries import QUERIES, gray
from rasterfold.sources import images

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "conversations"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_rect_intersect_takes_every_row(spark, con):
    got = {tuple(r)[:4]: r["n"] for r in QUERIES["rect_intersect"](spark, DIR).select("ix", "iy", "iw", "ih", "n").collect()}
    assert sum(got.values()) == con.sql("select count(*) from lineitem").fetchall()[0][0]
    sql = ORACLE_SQL["rect_intersect"]
    assert got == {r[:4]: r[4] for r in con.sql(f"select ix, iy, iw, ih, n from ({sql})").fetchall()}


@pytest.mark.parametrize(("sf", "width"), [("sf0.001", 2), ("sf0.1", 4)])
def test_output_names_number_as_many_frames_as_there_are(spark, sf, width):
    rows = QUERIES["output_names"](spark, f"/root/testdata/{sf}").collect()
    assert len(str(len(rows))) == width and sorted(r["pos"] for r in rows) == list(range(len(rows)))
    for r in rows:
        n = f"{r['pos'] + 1:0{width}}"
        assert r["b"] == f"out/fused_{n}.tif" and re.fullmatch(rf"out/[^/]+_{n}_f\d+\.tif", r["a"])


def test_numbers_of_names_are_never_cut(spark):
    df = spark.createDataFrame([(n, c) for n, c in ((7, 2), (100, 99), (1000, 536), (1001, 536), (12345, 5012))], "n int, c long")
    name = batch.output_name(F.lit("{n}.tif"), F.col("n"), F.col("c"), F.lit("f"), F.lit("d"))
    assert [r[0] for r in df.orderBy("n").select(name).collect()] == ["07.tif", "100.tif", "1000.tif", "1001.tif", "12345.tif"]


def planes(spark, sf):
    out = np.zeros((7, 24, 32))
    for r in gray(spark, sf).collect():
        out[r["frame"], r["y"], r["x"]] = r["v"]
    return out


def test_registration_aligns_the_whole_stack(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["frame"]: r for r in QUERIES["registration"](spark, sf).collect()}
    assert sorted(got) == list(range(7))
    last, ref = Transform(), None
    for f, img in enumerate(planes(spark, sf)):
        last = last if ref is None else solvers.align_pair(ref, img, last, solvers.MODELS["similarity"])
        assert all(abs(got[f][k] - getattr(last, k)) < 2e-5 for k in solvers.FIELDS), f
        at, ok = solvers.warped(img, last)
        ref = np.where(ok, at, img)


def test_ring_difference_of_every_frame(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r["frame"], r["y"], r["x"]): r["v"] for r in QUERIES["ring_difference"](spark, sf).collect()}
    assert len(got) == 7 * 24 * 32
    wide = np.pad(planes(spark, sf), ((0, 0), (3, 3), (3, 3)), mode="reflect")
    near = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4)]
    at = {d: wide[:, 3 + d[0] : 27 + d[0], 3 + d[1] : 35 + d[1]] for d in near}
    disk, ring = ([at[d] for d in near if a < d[0] ** 2 + d[1] ** 2 <= b] for a, b in ((-1, 1), (1, 9)))
    want = np.abs(np.mean(disk, 0) - np.mean(ring, 0))
    assert max(abs(v - want[k]) for k, v in got.items()) < 1e-6


def test_colour_queries_map_every_frame(spark):
    sf = "/root/testdata/sf0.001"
    img = planes(spark, sf)
    lo, hi = (f(img, axis=(1, 2), keepdims=True) for f in (np.min, np.max))
    want = (img - lo) / (hi - lo) * 255 + 0.5
    rows = QUERIES["gray_stretch"](spark, sf).collect()
    assert len({(r["frame"], r["y"], r["x"]) for r in rows}) == len(rows) == img.size
    assert all(np.floor(want[r["frame"], r["y"], r["x"]] - 1e-9) <= r["v"] <= np.floor(want[r["frame"], r["y"], r["x"]] + 1e-9) for r in rows)
    assert {(r["frame"], r["v"]) for r in rows} >= {(f, v) for f in range(7) for v in (0, 255)}
    t = np.clip(img, 0, 1)[..., None] ** np.arange(6)
    red = np.clip(t @ [0.13572138, 4.6153926, -42.66032258, 132.13108234, -152.94239396, 59.28637943], 0, 1)
    rows = QUERIES["turbo_map"](spark, sf).collect()
    assert len({(r["frame"], r["y"], r["x"]) for r in rows}) == len(rows) == img.size
    assert max(abs(r["r"] - red[r["frame"], r["y"], r["x"]]) for r in rows) < 1e-5


def test_jpeg_is_refused_plainly(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    files = images.read_folder(spark, str(tmp_path))
    assert images.extract_metadata(files).count() == 1
    with pytest.raises(Exception, match="a.jpg: JPEG files aren't decoded"):
        images.decode(files).collect()
