"""Shared pieces: session settings, word hashing, ranks without one big task, groups with hot keys, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in one Arrow batch; long texts make a batch of the default 10,000 rows too large for a Python worker.
ARROW_ROWS = 512
#: A key with more than this share (one in so many) of the rows is hot; there can be no more than HOT_SHARE of them.
HOT_SHARE = 1000
#: A side of at most so many narrow rows (about 16 bytes each) may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that checkpoint() has a shared folder."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the folder in spark.checkpoint.dir, which every executor reads."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, several times smaller than a checkpoint, and its path for removed()."""
    import uuid

    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that nothing refers to any more; else they wait for the driver's next collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it Spark drops a query's shuffle files as the query ends; what is to be read again must be cut or stored. The session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text without null texts; other columns, whatever their names, stay out of the operator."""
    return docs.select("doc_id", text_of().alias("text"), *more)


def ascii_lower(column: Column) -> Column:
    """Lower case of A-Z only, as contracts ask for; lower() would change other letters too."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _stores() -> dict:
    import sys
    import types

    return sys.modules.setdefault("_rasterfold_worker", types.ModuleType("_rasterfold_worker")).__dict__.setdefault("stores", {})


def worker_store(name: str) -> dict:
    """A dictionary that outlives a task in its Python worker; for caches, which may be lost at any time."""
    return _stores().setdefault(name, {})


def fresh_worker(keep: str = "") -> None:
    """At a task's start or end, rid its Python worker of what operators left there: their caches, and their pause of garbage collection."""
    import ctypes
    import gc

    stores = _stores()
    others = [name for name in stores if name != keep]
    for name in others:
        del stores[name]
    if not gc.isenabled():
        gc.unfreeze()
        gc.enable()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---- words and shingles, in numpy -------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle, one without words has none."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    acc = np.full(n, min(size, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(acc)


# ---- ranks, groups, components ----------------------------------------------------------------


def gapless_rank(df: DataFrame, key: str, order: list[str], out: str, rows: int | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """Number the rows of each key from 0 without a gap, whatever share of the rows a key has.

    Rows are dealt into (key, bucket) cells by a hash of `order`; a cell's start is the sum of the counts before it.
    `order` must tell the rows of a key apart. Numbers are dense but in no order of meaning. Cells number keys x buckets.
    """
    rows = df.count() if rows is None else rows
    buckets = max(16, -(-rows // bucket_rows))
    cells = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cells.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_cell").orderBy(*order)
    numbered = cells.withColumn("_in", F.row_number().over(within) - 1)
    return numbered.join(starts, [key, "_cell"]).withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_cell", "_start", "_in")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join of rows with their group by key; `how` may be left, then rows without a group stay.

    Groups with over total / HOT_SHARE rows number less than HOT_SHARE, so they are broadcast; the others are joined by a
    shuffle in which no key is hot.
    """
    least = max(total // HOT_SHARE, 1)
    hot = groups.filter(F.col(size) > least)
    keys = F.broadcast(hot.select(F.col(key).alias("_hot")))
    cold_rows = rows.join(keys, F.col(key) == F.col("_hot"), "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold_rows.join(groups.filter(F.col(size) <= least), key, how))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id that edges reach.

    Each round takes the least label of the neighbours, then the label of that label, so that chains halve. Labels and
    edges stay distributed; hubs are summed up before the shuffle. A round's labels are a table and not a checkpoint, as a
    checkpoint keeps the estimated size of its plan, which would be multiplied by itself in each round.
    """
    ways = F.array(F.struct(F.col(u).alias("a"), F.col(v).alias("b")), F.struct(F.col(v).alias("a"), F.col(u).alias("b")))
    both, path = stored(edges.filter(F.col(u) != F.col(v)).select(F.explode(ways).alias("_way")).select("_way.a", "_way.b").distinct())  # edges are evaluated once
    labels, last = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    done = False
    while not done:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        took = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("far"))
        new, at = stored(took.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("far", "c")).alias("component")))
        done = new.filter("was != component").isEmpty()
        removed(labels.sparkSession, last)
        labels, last = new.select("id", "component"), at
    labels = cut(labels)
    removed(labels.sparkSession, last)
    removed(labels.sparkSession, path)
    return labels


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in ids, a table of one column; texts only move if the ids are too many to broadcast.

    A null doc_id is in no table, so its row stays; all rows of a doc_id in ids go, whatever their texts.
    """
    ids = cut(ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti").select(*docs.columns)
