"""Binary meshes: one STL or GLB file written by many tasks, each at its own place.

Records have a fixed size, so a record's place follows from its number; numbers come from counts a line of the grid and their running
sum, without sorting everything in one task. Runs of records become chunks (at, content), which may be written in any
order and more than once.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Records of a chunk, at most.
CHUNK = 20_000
XYZ = ("x", "y", "z")


def numbered(rows: DataFrame, line: str, order: list[str]) -> DataFrame:
    """Adds n: the place of each row, line after line and by `order` within a line. Only the counts of the lines meet in one place."""
    counts = rows.groupBy(line).agg(F.count("*").alias("_n"))
    before = Window.orderBy(line).rowsBetween(Window.unboundedPreceding, -1)  # one row for each line of the grid
    starts = counts.select(line, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(line).orderBy(*order)
    return rows.join(starts, line).withColumn("n", F.col("_start") + F.row_number().over(within) - 1).drop("_start")


def corners(vertices: DataFrame, tris: DataFrame, nx: int) -> DataFrame:
    """j, a, b, c and the places of a triangle's corners (ax ... cz)."""
    place = vertices.select((F.col("j") * nx + F.col("i")).alias("_v"), F.struct(*[f"p{c}" for c in XYZ]).alias("_p"))
    each = tris.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("long").alias("v")) for k, c in enumerate("abc")])))
    met = each.join(place, F.col("_c.v") == F.col("_v")).groupBy("a", "b", "c").agg(*[F.max(F.when(F.col("_c.k") == k, F.col("_p"))).alias(f"_{c}") for k, c in enumerate("abc")])
    line = F.floor(F.least("a", "b", "c") / nx)
    return met.select(line.alias("j"), "a", "b", "c", *[F.col(f"_{c}.p{x}").alias(f"{c}{x}") for c in "abc" for x in XYZ])


def _packed(columns: list[tuple[str, str]], base: int, size: int):
    """Chunks of records: columns (name, numpy type) one after the other, rows in the order of n."""
    kind = np.dtype([(c, t) for c, t in columns])
    assert kind.itemsize == size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy()
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(n) != 1) + 1):
                if len(part):
                    out = np.zeros(len(part), kind)
                    for c, _ in columns:
                        if c in batch.schema.names:
                            out[c] = batch[c].to_numpy(zero_copy_only=False)[part]
                    yield pa.record_batch({"at": pa.array([base + size * int(n[part[0]])], pa.int64()), "content": pa.array([out.tobytes()], pa.binary())})

    return run


def chunks(rows: DataFrame, columns: list[tuple[str, str]], base: int) -> DataFrame:
    """at and content of the rows' records from `base` on; rows have n. Tasks take ranges of n."""
    size = np.dtype([(c, t) for c, t in columns]).itemsize
    placed = rows.withColumn("_part", F.floor(F.col("n") / CHUNK)).repartition("_part").sortWithinPartitions("n")
    return placed.select("n", *[c for c, _ in columns if c in rows.columns]).mapInArrow(_packed(columns, base, size), "at long, content binary")


def stl_chunks(vertices: DataFrame, tris: DataFrame, nx: int, title: bytes = b"binary STL") -> DataFrame:
    """at, content of a binary STL file: 80 bytes, the number of triangles, then 50 bytes a triangle with its face normal."""
    t = corners(vertices, tris, nx)
    u, v = [F.col(f"b{c}") - F.col(f"a{c}") for c in XYZ], [F.col(f"c{c}") - F.col(f"a{c}") for c in XYZ]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    long = F.greatest(F.sqrt(sum((c * c for c in cross[1:]), cross[0] * cross[0])), F.lit(1e-12))
    rows = numbered(t.select("*", *[(c / long).alias(f"n{x}") for c, x in zip(cross, XYZ)]), "j", ["a", "b", "c"])
    columns = [(f"{k}{x}", "<f4") for k in "nabc" for x in XYZ] + [("more", "<u2")]
    head = tris.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("at"), _bytes(lambda n: title[:80].ljust(80, b"\0") + struct.pack("<I", n))("n").alias("content"))
    return head.unionByName(chunks(rows, columns, 84))


def _bytes(make):
    return F.udf(lambda *a: bytearray(make(*a)), "binary")  # for single rows: headers


def glb_chunks(vertices: DataFrame, tris: DataFrame, nx: int, image: bytes, mime: str = "image/png") -> DataFrame:
    """at, content of a glTF 2.0 binary file: places, normals, texture places and corners, the texture embedded, one double-sided material."""
    ends = vertices.agg(F.count("*").alias("n"), *[f(f"p{x}").alias(f"{k}{x}") for k, f in (("lo", F.min), ("hi", F.max)) for x in XYZ]).first()  # one row
    nv, nt = ends["n"], tris.count()
    sizes = [12 * nv, 12 * nv, 8 * nv, 12 * nt, len(image)]
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s + -s % 4)
    kinds = ["VEC3", "VEC3", "VEC2", "SCALAR"]
    accessors = [{"bufferView": k, "componentType": 5125 if k == 3 else 5126, "count": 3 * nt if k == 3 else nv, "type": t} for k, t in enumerate(kinds)]
    accessors[0] |= {"min": [float(np.float32(ends[f"lo{x}"])) for x in XYZ], "max": [float(np.float32(ends[f"hi{x}"])) for x in XYZ]}
    # The numbers are those of the glTF standard: fixed values.
    scene = {
        "asset": {"version": "2.0", "generator": "rasterfold"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "name": "stack"}],
        "meshes": [{"name": "stack", "primitives": [{"attributes": {"POSITION": 0, "NORMAL": 1, "TEXCOORD_0": 2}, "indices": 3, "material": 0, "mode": 4}]}],
        "materials": [{"name": "stack", "pbrMetallicRoughness": {"baseColorTexture": {"index": 0}, "metallicFactor": 0, "roughnessFactor": 1}, "doubleSided": True}],
        "textures": [{"sampler": 0, "source": 0}], "samplers": [{"magFilter": 9729, "minFilter": 9987, "wrapS": 33071, "wrapT": 33071}],
        "images": [{"bufferView": 4, "mimeType": mime}], "accessors": accessors,
        "bufferViews": [{"buffer": 0, "byteOffset": a, "byteLength": s} | ({"target": 34963 if k == 3 else 34962} if k < 4 else {}) for k, (a, s) in enumerate(zip(starts, sizes))],
        "buffers": [{"byteLength": starts[-1]}],
    }
    text = json.dumps(scene, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    base = 20 + len(text) + 8
    head = struct.pack("<4sIII4s", b"glTF", 2, base + starts[-1], len(text), b"JSON") + text + struct.pack("<I4s", starts[-1], b"BIN\0")
    placed = numbered(vertices.select("j", "i", *[f"{k}{x}" for k in "pn" for x in XYZ], "u", "v"), "j", ["i"])
    corner = numbered(tris.withColumn("j", F.floor(F.least("a", "b", "c") / nx)), "j", ["a", "b", "c"])
    parts = [placed, placed, placed, corner]
    columns = [[(f"p{x}", "<f4") for x in XYZ], [(f"n{x}", "<f4") for x in XYZ], [("u", "<f4"), ("v", "<f4")], [(c, "<u4") for c in "abc"]]
    out = vertices.sparkSession.createDataFrame([(0, bytearray(head)), (base + starts[4], bytearray(image + b"\0" * (-len(image) % 4)))], "at long, content binary")
    for rows, cols, at in zip(parts, columns, starts):
        out = out.unionByName(chunks(rows, cols, base + at))
    return out


def write_file(out: DataFrame, path: str) -> int:
    """Write chunks (at, content) into one file at a path that driver and executors have mounted, and return its size.

    Every task writes at its chunks' places, so order and repeated tasks don't matter; the file has its full size before.
    """
    size = out.agg(F.max(F.col("at") + F.length("content"))).first()[0] or 0
    with open(path, "wb") as file:
        file.truncate(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as file:
            for batch in batches:
                for at, content in zip(batch["at"].to_pylist(), batch["content"]):
                    file.seek(at)
                    done += file.write(content.as_buffer())
        yield pa.record_batch({"written": pa.array([done], pa.int64())})

    out.mapInArrow(run, "written long").agg(F.sum("written")).first()
    return size


def read_stl(data: bytes) -> np.ndarray:
    """Triangles of a binary STL file: a row of normal and three corners for each."""
    n = struct.unpack_from("<I", data, 80)[0]
    return np.frombuffer(data, np.dtype([("v", "<f4", 12), ("more", "<u2")]), n, 84)["v"]


def stl_triangles(out: DataFrame) -> DataFrame:
    """nx ... cz of each triangle within the chunks of an STL file."""
    names = [f"{k}{x}" for k in "nabc" for x in XYZ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                v = np.frombuffer(content.as_buffer(), np.dtype([("v", "<f4", 12), ("more", "<u2")]))["v"].astype(float)
                yield pa.record_batch({c: v[:, k] for k, c in enumerate(names)})

    return out.filter("at >= 84").select("content").mapInArrow(run, ", ".join(f"{c} double" for c in names))


def material(texture: str, name: str = "stack") -> str:
    """The material file beside an OBJ file: one plain material with a texture. The numbers are fixed values."""
    return f"newmtl {name}\nKa 1.000 1.000 1.000\nKd 1.000 1.000 1.000\nKs 0.000 0.000 0.000\nd 1.0\nillum 1\nmap_Kd {texture}\n"
