"""Heads of image files and binary meshes, read back."""

import json
import struct

import numpy as np
import pytest

from rasterfold.operators import geometry
from rasterfold.plans.queries import QUERIES, _mesh
from rasterfold.sources import heads, meshes
from rasterfold.sources.images import encode_png

DIR = "/root/testdata/sf0.001"


def tiff(taken: bytes, before: int, after: int = 0) -> bytes:
    """A TIFF file whose directory with a date stands after `before` bytes of pixels."""
    at = 8 + before
    entries = struct.pack("<HHII", 256, 4, 1, 1) + struct.pack("<HHII", 306, 2, 20, at + 2 + 24 + 4)
    return struct.pack("<2sHI", b"II", 42, at) + b"\1" * before + struct.pack("<H", 2) + entries + b"\0\0\0\0" + taken.ljust(20, b"\0") + b"\2" * after


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "shoot"
    f.mkdir()
    (f / "f10.tif").write_bytes(tiff(b"2024:05:06 07:08:09", 50_000, 30_000))
    (f / "f2.tif").write_bytes(tiff(b"2024:05:06 07:08:08", 100, 90_000))
    (f / "F1.PNG").write_bytes(encode_png(np.zeros((4, 4, 3), np.int64), 8))
    (f / "f3.tif").write_bytes(b"II*\0" + b"\xff" * 20_000)
    (f / "note.txt").write_text("none")
    (tmp_path / "other.jpg").write_bytes(b"\xff\xd8\xff\xda" + b"x" * 5000)
    return tmp_path


def test_heads_read_little(spark, folder):
    got = heads.read_heads(spark, [str(folder / "other.jpg"), str(folder / "shoot")], head=1000, window=400, group=2).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["other.jpg", "F1.PNG", "f2.tif", "f3.tif", "f10.tif"]
    by = {r["path"].rsplit("/", 1)[1]: r for r in got}
    assert by["f2.tif"]["taken"] == "2024:05:06 07:08:08" and by["f2.tif"]["bytes_read"] == 1000
    assert by["f10.tif"]["taken"] == "2024:05:06 07:08:09" and by["f10.tif"]["bytes_read"] == 1400 and by["f10.tif"]["length"] > 80_000
    assert by["F1.PNG"]["bytes_read"] == by["F1.PNG"]["length"] and by["F1.PNG"]["taken"] is None
    assert by["f3.tif"]["taken"] is None and by["f3.tif"]["bytes_read"] == by["f3.tif"]["length"] == 20_004
    assert by["other.jpg"]["bytes_read"] == 5004  # nothing found: all of it


def test_heads_open_files_only_for_what_is_in_them(spark, folder, monkeypatch):
    df = heads.read_heads(spark, [str(folder / "shoot")], ["path", "length"], group=1)
    assert df.columns == ["path", "length"] and df.rdd.getNumPartitions() == 4
    for f in (folder / "shoot").iterdir():
        f.chmod(0o200)
    reader = heads.HeadReader({"inputs": json.dumps([str(folder / "shoot")])}, df.schema)
    monkeypatch.setattr(heads, "Ranges", lambda path: pytest.fail("opened"))
    assert [r for p in reader.partitions() for r in reader.read(p)] and df.count() == 4


def test_folders_in_order_and_empty_ones(folder):
    files = heads.expand([str(folder / "shoot"), str(folder / "other.jpg"), "file://" + str(folder / "shoot")])
    assert [p.rsplit("/", 1)[1] for p, _ in files] == ["F1.PNG", "f2.tif", "f3.tif", "f10.tif", "other.jpg", "F1.PNG", "f2.tif", "f3.tif", "f10.tif"]
    (folder / "none").mkdir()
    with pytest.raises(ValueError, match="no images"):
        heads.expand([str(folder / "none")])


@pytest.fixture(scope="module")
def mesh(spark):
    m = _mesh(spark, DIR).cache()
    return m, geometry.triangles(m, 8, []).cache()


def test_stl_is_written_by_many_tasks(spark, mesh, tmp_path, monkeypatch):
    monkeypatch.setattr(meshes, "CHUNK", 7)
    m, tris = mesh
    chunks = meshes.stl_chunks(m, tris, 8).cache()
    assert chunks.count() > 8
    path = str(tmp_path / "a.stl")
    size = meshes.write_file(chunks, path)
    data = open(path, "rb").read()
    assert len(data) == size == 84 + 50 * tris.count()
    place = {r["j"] * 8 + r["i"]: (r["px"], r["py"], r["pz"]) for r in m.collect()}
    want = [[place[v] for v in abc] for abc in sorted((r["a"], r["b"], r["c"]) for r in tris.collect())]
    got = meshes.read_stl(data).reshape(-1, 4, 3)
    key = lambda t: tuple(np.asarray(t, np.float32).ravel().tolist())
    assert sorted(key(t[1:]) for t in got) == sorted(map(key, want))
    for normal, a, b, c in got.astype(float):
        cross = np.cross(b - a, c - a)
        assert np.abs(normal - cross / np.linalg.norm(cross)).max() < 1e-4
    assert meshes.write_file(chunks, path) == size and open(path, "rb").read() == data


def test_glb_holds_the_mesh(spark, mesh, tmp_path):
    m, tris = mesh
    image = encode_png(np.zeros((3, 5, 3), np.int64), 8)
    path = str(tmp_path / "a.glb")
    size = meshes.write_file(meshes.glb_chunks(m, tris, 8, image), path)
    data = open(path, "rb").read()
    magic, version, whole, length, kind = struct.unpack_from("<4sIII4s", data)
    assert (magic, version, whole, kind) == (b"glTF", 2, size, b"JSON") and size == len(data) and size % 4 == 0
    scene = json.loads(data[20 : 20 + length])
    assert struct.unpack_from("<I4s", data, 20 + length) == (scene["buffers"][0]["byteLength"], b"BIN\0")
    view = lambda k: data[28 + length + scene["bufferViews"][k]["byteOffset"] :][: scene["bufferViews"][k]["byteLength"]]
    rows = sorted(m.collect(), key=lambda r: (r["j"], r["i"]))
    for k, names in enumerate((("px", "py", "pz"), ("nx", "ny", "nz"), ("u", "v"))):
        got = np.frombuffer(view(k), "<f4").reshape(len(rows), -1)
        assert np.abs(got - [[r[c] for c in names] for r in rows]).max() < 1e-6
    assert sorted(map(tuple, np.frombuffer(view(3), "<u4").reshape(-1, 3).tolist())) == sorted((r["a"], r["b"], r["c"]) for r in tris.collect())
    assert view(4) == image and scene["accessors"][3]["count"] == 3 * tris.count()
    assert np.allclose(scene["accessors"][0]["max"], np.frombuffer(view(0), "<f4").reshape(-1, 3).max(0))
    assert "map_Kd a.png" in meshes.material("a.png")


def test_numbers_have_no_gap(spark):
    rows = spark.createDataFrame([(j, i) for j in (5, 0, 3, 9) for i in range(j + 1)], "j int, i int")
    got = sorted((r["j"], r["i"], r["n"]) for r in meshes.numbered(rows, "j", ["i"]).collect())
    assert [n for *_, n in got] == list(range(len(got)))
    assert QUERIES["mesh_triangles"](spark, DIR).count() == 70
