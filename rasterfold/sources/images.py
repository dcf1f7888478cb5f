"""Image files: a PNG and TIFF decoder and encoder in Arrow functions, embedded metadata, project files.

`binaryFile` gives one row a file, so a folder spreads over tasks by file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.operators.batch import is_image

_PNG = b"\x89PNG\r\n\x1a\n"


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """h x w x 3 in [0, 1] and the bit depth; gray is repeated, alpha dropped, palettes looked up. Not interlaced."""
    parts = list(_chunks(data))
    w, h, bits, kind, _, _, lace = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if lace or bits < 8:
        raise ValueError("interlaced and packed PNG files aren't read")
    raw = zlib.decompress(b"".join(d for t, d in parts if t == b"IDAT"))
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = n * bits // 8
    rows = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    before = np.zeros(w * step, np.uint8)
    for y in range(h):
        f, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if f == 0:
            cur = line
        elif f == 1:
            cur = line.reshape(-1, step).cumsum(0).ravel()
        elif f == 2:
            cur = line + before
        else:
            cur = line.copy()
            for i in range(len(cur)):
                a, b, c = (cur[i - step] & 255 if i >= step else 0), int(before[i]), (int(before[i - step]) if i >= step else 0)
                if f == 3:
                    cur[i] += (a + b) // 2
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                    cur[i] += near[2]
        out[y] = before = (cur & 255).astype(np.uint8)
    px = (out.reshape(h, w, n, 2).astype(np.uint16) @ np.array([256, 1], np.uint16) if bits == 16 else out.reshape(h, w, n)).astype(np.float64)
    if kind == 3:
        palette = np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3).astype(np.float64)
        return palette[px[..., 0].astype(int)] / 255, 8
    return (px[..., :3] if n >= 3 else np.repeat(px[..., :1], 3, 2)) / ((1 << bits) - 1), bits


def encode_png(px: np.ndarray, bits: int) -> bytes:
    """From integer samples, h x w (gray) or h x w x 3."""
    px = px[..., None] if px.ndim == 2 else px
    h, w, n = px.shape
    body = px.astype(">u2" if bits == 16 else np.uint8).reshape(h, -1).view(np.uint8)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), body], 1).tobytes()
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, 0 if n == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff_tags(data: bytes, at: int | None = None) -> dict[int, tuple]:
    """Tags of one directory; empty for anything malformed."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    try:
        at = struct.unpack(order + "I", data[4:8])[0] if at is None else at
        out = {}
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            e = at + 2 + 12 * k
            tag, kind, n = struct.unpack(order + "HHI", data[e : e + 8])
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1}.get(kind)
            if size is None:
                continue
            where = e + 8 if size * n <= 4 else struct.unpack(order + "I", data[e + 8 : e + 12])[0]
            raw = data[where : where + size * n]
            if len(raw) < size * n:
                continue
            if kind in (2, 7, 1):
                out[tag] = (raw,)
            else:
                out[tag] = struct.unpack(order + {3: f"{n}H", 4: f"{n}I", 5: f"{2 * n}I"}[kind], raw)
        return out
    except struct.error:
        return {}


def decode_tiff(data: bytes) -> tuple[np.ndarray, int]:
    """Uncompressed, chunky, 8 or 16 bits."""
    t = tiff_tags(data)
    w, h, bits, n = t[256][0], t[257][0], t.get(258, (8,))[0], t.get(277, (1,))[0]
    if t.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF files aren't read")
    raw = b"".join(data[a : a + c] for a, c in zip(t[273], t[279]))
    kind = ("<" if data[:2] == b"II" else ">") + "u2" if bits == 16 else "u1"
    px = np.frombuffer(raw, kind, h * w * n).reshape(h, w, n).astype(np.float64) / ((1 << bits) - 1)
    return (px[..., :3] if n >= 3 else np.repeat(px[..., :1], 3, 2)), bits


def encode_tiff(px: np.ndarray, bits: int, extra: dict[int, tuple[int, list]] | None = None) -> bytes:
    """Little-endian, one strip; extra: tag -> (kind 3 or 4, values) for linear DNG and such."""
    px = px[..., None] if px.ndim == 2 else px
    h, w, n = px.shape
    body = px.astype("<u2" if bits == 16 else np.uint8).tobytes()
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * n), 259: (3, [1]), 262: (3, [2 if n == 3 else 1]), 273: (4, [8]), 277: (3, [n]), 278: (4, [h]), 279: (4, [len(body)]), **(extra or {})}
    at = 8 + len(body) + len(body) % 2
    entries, tail, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), free + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + tail


def metadata(data: bytes) -> dict:
    """exif (TIFF bytes), icc, xmp and the EXIF date of JPEG, PNG or TIFF bytes; what is malformed is absent."""
    out = {"exif": None, "icc": None, "xmp": None, "taken": None}
    try:
        if data[:8] == _PNG:
            for t, d in _chunks(data):
                if t == b"eXIf":
                    out["exif"] = d
                elif t == b"iCCP":
                    out["icc"] = zlib.decompress(d[d.index(b"\0") + 2 :])
                elif t == b"iTXt" and d.startswith(b"XML:com.adobe.xmp"):
                    out["xmp"] = d.split(b"\0", 5)[-1]
        elif data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
                n = struct.unpack(">H", data[at + 2 : at + 4])[0]
                d = data[at + 4 : at + 2 + n]
                if data[at + 1] == 0xE1 and d.startswith(b"Exif\0\0"):
                    out["exif"] = d[6:]
                elif data[at + 1] == 0xE1 and d.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                    out["xmp"] = d[29:]
                elif data[at + 1] == 0xE2 and d.startswith(b"ICC_PROFILE\0"):
                    out["icc"] = (out["icc"] or b"") + d[14:]
                at += 2 + n
        elif data[:2] in (b"II", b"MM"):
            tags = tiff_tags(data)
            out |= {"exif": data if 34665 in tags or 306 in tags else None, "icc": tags.get(34675, (None,))[0], "xmp": tags.get(700, (None,))[0]}
    except (ValueError, IndexError, zlib.error, struct.error):
        pass
    if out["exif"]:
        own = tiff_tags(out["exif"])
        deep = tiff_tags(out["exif"], own[34665][0]) if 34665 in own else {}
        for tags, tag in ((deep, 36867), (deep, 36868), (own, 306)):
            if tag in tags and re.match(rb"\d{4}:(?!00)", tags[tag][0]):
                out["taken"] = tags[tag][0].rstrip(b"\0").decode("ascii", "replace")
                break
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch["path"].to_pylist(), batch["content"]):
            data = raw.as_py()
            if data[:2] == b"\xff\xd8":
                raise ValueError(f"{path}: JPEG files aren't decoded, only their metadata is read")
            px, bits = decode_png(data) if data[:8] == _PNG else decode_tiff(data)
            y, x = np.indices(px.shape[:2])
            yield pa.record_batch({"path": pa.array([path] * y.size), "bit_depth": pa.array(np.full(y.size, bits), pa.int32()), "y": pa.array(y.ravel(), pa.int32()), "x": pa.array(x.ravel(), pa.int32()), **{c: px[..., k].ravel() for k, c in enumerate("rgb")}})


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the images directly in a folder; a folder without any is an error."""
    files = spark.read.format("binaryFile").load(folder).filter(is_image(F.col("path")))
    if not files.limit(1).count():
        raise ValueError(f"{folder} holds no images")
    return files.select("path", "content", "modificationTime", "length")


def decode(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_decode, "path string, bit_depth int, y int, x int, r double, g double, b double")


def _metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [metadata(c.as_py()) for c in batch["content"]]
        yield pa.record_batch({"path": batch["path"], **{k: pa.array([r[k] for r in rows], pa.string() if k == "taken" else pa.binary()) for k in ("exif", "icc", "xmp", "taken")}})


def extract_metadata(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_metadata, "path string, exif binary, icc binary, xmp binary, taken string")


def encode(pixels: DataFrame, keys: list[str], bits: int = 16, form: str = "png") -> DataFrame:
    """keys and content: one file for each key from integer columns r, g, b."""
    name = ", ".join(f"{k} {dict(pixels.dtypes)[k]}" for k in keys)

    def run(group: pa.Table) -> pa.Table:
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        px = np.zeros((y.max() + 1, x.max() + 1, 3), np.int64)
        for k, c in enumerate("rgb"):
            px[y, x, k] = group[c].to_numpy()
        data = encode_png(px, bits) if form == "png" else encode_tiff(px, bits)
        return group.select(keys).slice(0, 1).append_column("content", pa.array([data], pa.binary()))

    return pixels.groupBy(*keys).applyInArrow(run, f"{name}, content binary")
