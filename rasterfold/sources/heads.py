"""Metadata of many image files from little of each: a data source that reads heads and, where the directory stands later, a window around it."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rasterfold.operators.batch import IMAGE_TYPES
from rasterfold.sources.images import metadata

HEAD = WINDOW = 4 << 20
SCHEMA = "path string, length long, taken string, exif binary, icc binary, xmp binary, bytes_read long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path within it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+://|file:", path) else (fs.LocalFileSystem(), path)


def natural(path: str) -> list:
    """Runs of digits compare as numbers, everything else in lower case."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", path) if p] + [(2, 0, path)]


def expand(inputs: list[str]) -> list[tuple[str, int]]:
    """Files and their lengths: a folder is replaced by the images directly in it, in natural order; other inputs stay where they are. A folder without images is an error."""
    out = []
    for given in inputs:
        system, path = opened(given)
        info = system.get_file_info(path)
        if info.type != fs.FileType.Directory:
            out.append((given, max(info.size or 0, 0)))
            continue
        own = [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.extension.lower() in IMAGE_TYPES]
        if not own:
            raise ValueError(f"{given} holds no images")
        out += [(f"{given.rstrip('/')}/{f.base_name}", f.size) for f in sorted(own, key=lambda f: natural(f.base_name))]
    return out


class Ranges:
    """Parts of one file, and how many bytes were read."""

    def __init__(self, path: str) -> None:
        system, at = opened(path)
        self.file, self.read = system.open_input_file(at), 0

    def part(self, at: int, size: int) -> bytes:
        data = self.file.read_at(size, at)
        self.read += len(data)
        return data


def directory_at(head: bytes) -> int | None:
    """Where a TIFF file's first directory stands."""
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    return struct.unpack_from(order + "I", head, 4)[0] if order and len(head) >= 8 else None


def head_metadata(path: str, length: int, head: int = HEAD, window: int = WINDOW) -> dict:
    """Metadata from the head; else, for a TIFF file whose directory stands after it, from a window around that; else from all of the file."""
    ranges = Ranges(path)
    data = ranges.part(0, min(head, length))
    found = metadata(data)
    if found["taken"] is None and length > head:
        at = directory_at(data)
        if at is not None and head <= at < length:
            low, high = max(at - window // 2, head), min(at + window // 2, length)
            sparse = bytearray(high)  # zero pages that nothing touches take no memory
            sparse[: len(data)] = data
            sparse[low:high] = ranges.part(low, high - low)
            found = metadata(bytes(sparse))
        if found["taken"] is None:
            found = metadata(data + ranges.part(head, length - head))
    return {**found, "bytes_read": ranges.read}


class HeadReader(DataSourceReader):
    """Groups of files are partitions; files are opened only if the schema asks for what is in them."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.inputs = json.loads(options["inputs"])
        self.head, self.window, self.group = (int(options.get(k, d)) for k, d in (("head", HEAD), ("window", WINDOW), ("group", 64)))
        self.names = schema.names

    def partitions(self) -> list[InputPartition]:
        files = expand(self.inputs)
        return [InputPartition(files[k : k + self.group]) for k in range(0, len(files), self.group)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        inside = set(self.names) - {"path", "length"}
        for path, length in partition.value:
            row = {"path": path, "length": length, **(head_metadata(path, length, self.head, self.window) if inside else {})}
            yield tuple(row[n] for n in self.names)


class ImageHeads(DataSource):
    """Format image_heads: options inputs (a JSON list of files and folders), head and window (bytes), group (files of a task)."""

    @classmethod
    def name(cls) -> str:
        return "image_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeadReader:
        return HeadReader(self.options, schema)


def read_heads(spark: SparkSession, inputs: list[str], columns: list[str] | None = None, **options: int) -> DataFrame:
    """path, length, taken, exif, icc, xmp, bytes_read of image files (or those of `columns`), in the order of the inputs and natural order within folders."""
    spark.dataSource.register(ImageHeads)
    wanted = ", ".join(f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns)
    return spark.read.format("image_heads").schema(wanted).options(inputs=json.dumps(inputs), **{k: str(v) for k, v in options.items()}).load()
