"""Project files: settings, frames and a whole run; short specifications, sizes and labels in text."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterfold.operators import batch, fuse, geometry, run
from rasterfold.sources import projects
from rasterfold.sources.images import encode_png

FRUIT = {
    "stack_project": 1,
    "name": "fruit",
    "frames": [{"name": "a.png", "path": "shoot/a.png"}, {"name": "b.png", "path": "shoot/b.png", "off": True}, {"name": "c.png", "path": "gone/c.png", "note": "third"}, {"name": "d.png", "path": "shoot/d.png"}, {"name": "e.png"}],
    "params": {"align": False, "rotation": False, "coarsen": 2, "levels": 1, "top": "avg", "energy_radius": 1, "halo": 0, "draft": 1, "rotate": 90, "depth_scale": 1, "render_wav": True, "wav_power": 2, "wav_edge": False, "split": "count", "ov_bar": True, "ov_um": 0.325, "ov_len": " 100um ", "ov_text": "", "render_dmap": True},
    "save": {"sel": ["lap", "depth", "stereo", "mesh", "dfr", "anim-peak"], "sv-format": "jpeg", "sv-crop": False, "v3-near": "last", "v3-shift": "2.5", "v3-layout": "cross", "m3-format": "obj", "m3-relief": "25", "m3-grid": 1000, "m3-tex": "0"},
    "run": {"crop": {"x": 8, "y": 4, "w": 24, "h": 40}},
    "dust": {"name": "wall.tif"},
}


@pytest.fixture(scope="module")
def shoot(tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    (at / "shoot").mkdir()
    rng = np.random.default_rng(3)
    frames = [rng.integers(8000, 50000, (40, 48, 3)) for _ in range(3)]
    for name, px in zip(("shoot/a.png", "c.png", "shoot/d.png"), frames):
        (at / name).write_bytes(encode_png(px, 16))
    (at / "fruit.json").write_text(json.dumps(FRUIT))
    return at, [f / 65535 for f in frames]


def test_settings_of_a_project(spark, shoot):
    s = projects.settings(projects.texts(spark, str(shoot[0] / "fruit.json"))).first()
    assert (s["output"], s["align"], s["fixed"], s["brightness"], s["coarsen"], s["rotate"], s["draft"], s["levels"], s["halo"]) == ("fruit_stacked.jpg", False, ["rot"], True, 2, 90, 1, 1, None)
    assert s["average"].asDict() == {"power": 2.0, "smooth": None, "gate": None, "edge": False} and s["split"].asDict() == {"by": "count", "size": 30.0}
    assert s["bar"].asDict() == {"um": 0.325, "length": "100um"} and s["caption"] is None and s["dust"]["map"] == "wall.tif"
    assert s["window"].asDict() == {"x": 8, "y": 4, "w": 24, "h": 40} and not s["crop"] and s["metadata"] and s["near_first"] is False
    assert s["outputs"] == ["depth", "stereo", "mesh"] and s["stereo"].asDict() == {"shift": 2.5, "layout": "cross"}
    assert s["mesh"].asDict() == {"form": "obj", "relief": 25.0, "grid": 1000, "texture": None}
    assert s["notes"] == ["the depth-map rendering isn't made", "left out: dfr, anim-peak"] and s["rocking"] is None


def test_empty_and_odd_projects(spark):
    rows = [("a", '{"x_project":1}'), ("b", '{"x_project":1,"frames":[],"params":{"levels":"deep","halo":2},"run":{"crop":{"x":1,"y":2,"w":3}}}')]
    got = {r["project"]: r for r in projects.settings(spark.createDataFrame(rows, "project string, text string")).collect()}
    assert got["a"]["output"] is None and got["a"]["align"] and got["a"]["fixed"] == [] and got["a"]["outputs"] == [] and got["a"]["notes"] == []
    assert got["b"]["levels"] is None and got["b"]["halo"] == 2 and got["b"]["window"] is None
    assert projects.frames(spark.createDataFrame(rows, "project string, text string")).count() == 0
    with pytest.raises(Exception, match="c: not a project file"):
        projects.settings(spark.createDataFrame([("c", '{"name":"x"}')], "project string, text string")).collect()


def test_frames_are_looked_for(spark, shoot):
    at = shoot[0]
    rows = projects.resolved(projects.frames(projects.texts(spark, str(at / "fruit.json"))))
    got = [(r["frame"], r["file"], r["found"], r["note"]) for r in rows.orderBy("frame").collect()]
    assert got == [(0, f"{at}/shoot/a.png", True, None), (1, f"{at}/c.png", True, "third"), (2, f"{at}/shoot/d.png", True, None), (3, f"{at}/e.png", False, None)]
    assert [r["note"] for r in projects.missing_note(rows).collect()] == ["1 of the project's frames aren't beside the project file"]


def test_run_of_a_project(spark, shoot):
    at, frames = shoot
    out = run.run_project(spark, str(at / "fruit.json"))
    small = [np.rot90(f, -1).reshape(24, 2, 20, 2, 3).mean((1, 3)) for f in frames]
    means = [f[::4, ::4].mean((0, 1)) for f in small]
    even = [f * np.clip(means[0] / m, 0.25, 4) for f, m in zip(small, means)]
    rows = [(k, y, x, *map(float, f[y, x])) for k, f in enumerate(even) for y in range(24) for x in range(20)]
    want = fuse.fuse(spark.createDataFrame(rows, "frame int, y int, x int, r double, g double, b double"), 24, 20, 1, "avg")["image"]
    want = {(r["y"] - 2, r["x"] - 4): (r["r"], r["g"], r["b"]) for r in want.collect() if 4 <= r["x"] < 16 and 2 <= r["y"] < 22}
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in out["image"].collect()}
    assert got.keys() == want.keys() and len(got) == 240 and max(np.abs(np.subtract(got[k], want[k])).max() for k in want) < 1e-6
    assert tuple(out["area"].first()) == (4, 2, 12, 20) and out["winners"].count() == out["depth"].count() == 240
    assert out["transforms"].count() == 0 and len(out["notes"].collect()) == 3


def test_projects_that_cannot_run(spark, shoot):
    at = shoot[0]
    (at / "none.json").write_text('{"s_project":1,"frames":[{"name":"zzz.png"}]}')
    with pytest.raises(ValueError, match="none of the frames"):
        run.run_project(spark, str(at / "none.json"))
    (at / "shoot" / "small.png").write_bytes(encode_png(np.zeros((4, 4, 3), np.int64), 8))
    (at / "two.json").write_text('{"s_project":1,"frames":[{"name":"c.png"},{"name":"small.png","path":"shoot/small.png"}]}')
    with pytest.raises(ValueError, match="differ in size"):
        run.run_project(spark, str(at / "two.json"))


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_labels_of_lengths(spark):
    lengths = [0.5, 100.0, 2500.0, 1e6, 0.0, None, 0.001234, 999.9999999, 1234.0, 5e12]
    assert values(spark, [(v,) for v in lengths], "v double", batch.length_label(F.col("v"))) == ["500 nm", "100 µm", "2.5 mm", "1 m", None, None, "1.23 nm", "1000 µm", "1.23 mm", "5000000 m"]


def test_pixel_sizes(spark):
    rows = [('<Pixels PhysicalSizeX="0.325" PhysicalSizeXUnit="µm">', "x", None, None), ('PhysicalSizeX=" 65 " PhysicalSizeXUnit="nm"', None, None, None), ('PhysicalSizeX="0"', None, 100.0, 3), ("ImageJ=1\nunit=micron\r\n", None, 4.0, 2), ("ImageJ=1\nloop=0", None, 4.0, 2), (None, None, 254.0, 2), (None, "a camera", 254.0, 2), (None, None, 0.0, 3), (None, None, 5.0, 1)]
    got = values(spark, rows, "t string, make string, res double, unit int", batch.pixel_size(*[F.col(c) for c in ("t", "make", "res", "unit")]))
    assert [g and (round(g["um"], 9), g["source"]) for g in got] == [(0.325, "OME-XML"), (0.065, "OME-XML"), (100.0, "TIFF resolution"), (0.25, "ImageJ"), None, (100.0, "TIFF resolution"), None, None, None]


def test_short_specifications(spark):
    got = values(spark, [(s,) for s in ("rdf", "rdf:2", "rdf:2:6", "rdf:3:3", "sml", "sml:4", "sml:-1", "box", None)], "s string", batch.focus_measure(F.col("s")))
    assert [g and tuple(g) for g in got] == [("ring", 1, 3, None), ("ring", 2, 4, None), ("ring", 2, 6, None), None, ("laplacian", None, None, 1), ("laplacian", None, None, 4), None, None, None]
    got = values(spark, [(s,) for s in ("bilinear", "guided", "guided:5", "guided:5:1e-3", "guided:x", "near", None)], "s string", batch.upsampling(F.col("s")))
    assert [g and tuple(g) for g in got] == [(0, None), (2, 0.01), (5, 0.01), (5, 0.001), None, None, None]


def test_layouts_have_names(spark):
    px = spark.createDataFrame([(0, 0, 0.1, 0.2, 0.3)], "y int, x int, r double, g double, b double")
    assert geometry.stereo(px, px, 1, "parallel", []).count() == geometry.stereo(px, px, 1, "crossed", []).count() == 2
    with pytest.raises(ValueError, match="no layout"):
        geometry.stereo(px, px, 1, "wide", [])
