"""Op 5: exact deduplication of a batch against an immutable snapshot, screened by static binary-fuse filters.

A snapshot's distinct digests are dealt by hash into buckets, and each bucket gets a binary-fuse filter: three 8-bit
fingerprints a key in neighbouring segments, found by peeling. Incoming rows are first grouped by digest among themselves, so
each distinct digest is screened once. Only digests that a filter lets through are joined with the snapshot's exact buckets.
Groups of several rows are then compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import BROADCAST_ROWS, ascii_lower, attach_groups, cut, mix, prepare, text_of

#: Digests that one filter covers.
BUCKET_KEYS = 10_000
FILTER = "bucket long, seed long, segment long, segments long, prints binary"


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in neighbouring segments, and its fingerprint."""
    h = mix(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)) * np.uint64(segment)
    low = np.uint64(segment - 1)
    other = mix(h)
    at = np.stack([first + (h & low), first + np.uint64(segment) + (other & low), first + np.uint64(2 * segment) + ((other >> np.uint64(24)) & low)])
    return at.astype(np.int64), (other >> np.uint64(56)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """seed, segment length, segment count and fingerprints for distinct 64-bit keys (at least one)."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25) if n > 1 else 2))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-int(n * factor + 1) // segment) - 2)
    seed = 0
    while True:
        seed += 1
        at, prints = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        index = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(index, row, np.arange(n))
        peeled, alone = [], np.flatnonzero(count == 1)
        while len(alone):
            # A key may be alone in two of its slots; it is peeled at the first of them.
            key, where = np.unique(index[alone], return_index=True)
            slot = alone[where]
            peeled.append((key, slot))
            touched = at[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(index, row, key)
            near = np.unique(touched)
            alone = near[count[near] == 1]
        if sum(len(k) for k, _ in peeled) == n:
            break
    table = np.zeros(size, np.uint8)
    for key, slot in reversed(peeled):
        a, b, c = at[:, key]
        table[slot] = 0
        table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
    return seed, segment, segments, table


def maybe_in(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others."""
    (a, b, c), prints = _slots(keys, seed, segment, segments)
    return prints == table[a] ^ table[b] ^ table[c]


def _build(group: pa.Table) -> pa.Table:
    keys = np.unique(group["key"].to_numpy().view(np.uint64))
    seed, segment, segments, table = build_filter(keys)
    return pa.table({"bucket": group["bucket"][:1].cast(pa.int64()), "seed": [seed], "segment": [segment], "segments": [segments], "prints": [table.tobytes()]})


def _screen(new: pa.Table, filters: pa.Table) -> pa.Table:
    out = np.zeros(len(new), bool)
    for row in filters.to_pylist():
        out |= maybe_in(new["key"].to_numpy().view(np.uint64), row["seed"], row["segment"], row["segments"], np.frombuffer(row["prints"], np.uint8))
    return pa.table({"text_sha256": new["text_sha256"], "maybe": out})


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter a bucket over the distinct text_sha256 of an immutable snapshot; may be kept beside it."""
    keys = digests.select(F.xxhash64("text_sha256").alias("key")).distinct()
    return keys.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(_build, FILTER)


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """text_sha256 and maybe, for distinct digests: false only if the snapshot lacks it."""
    keyed = digests.select("text_sha256", F.xxhash64("text_sha256").alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "text_sha256 string, maybe boolean")


def deduplicate(docs: DataFrame, incoming: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; of equal texts the row with the largest doc_id stays.

    Rows for which `incoming` holds are the new batch, the others the snapshot; which half a row is in doesn't change the
    result. Texts are equal when identical after lower-casing A-Z; null counts as empty. Rows that repeat a doc_id with the same
    text count in group_size, and all of them carry the mark of the row that stays. An empty table gives no rows; other columns are ignored.
    A null doc_id counts in group_size, but its row is marked kept even if another of its group stays.
    """
    prepare(docs.sparkSession)
    incoming = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 1 if incoming is None else incoming
    text = ascii_lower(text_of())
    rows = cut(docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.coalesce(incoming, F.lit(False)).alias("new")))
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_KEYS))
    groups = cut(rows.groupBy("text_sha256", "new").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    old, new = groups.filter("not new").drop("new"), groups.filter("new").drop("new")
    filters = cut(build_filters(old, buckets))
    screened = new.join(screen(new, filters, buckets), "text_sha256")
    maybe = screened.filter("maybe").select("text_sha256", F.col("keep_id").alias("k"), F.col("group_size").alias("n"))
    bucket = old.join(maybe, "text_sha256", "left")
    met = bucket.select("text_sha256", F.greatest("keep_id", "k").alias("keep_id"), (F.col("group_size") + F.coalesce("n", F.lit(0))).alias("group_size"))
    alone = screened.filter("not maybe").select(*met.columns).unionByName(maybe.join(old, "text_sha256", "left_anti").select("text_sha256", F.col("k").alias("keep_id"), F.col("n").alias("group_size")))
    several = cut(met.unionByName(alone).filter("group_size > 1"))
    classes = _bytes_checked(docs.select("doc_id", text.alias("text")), rows, several)
    out = attach_groups(rows.select("doc_id", "text_sha256"), classes, "text_sha256", "group_size", total, "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(True)).alias("kept"), "text_sha256")


def _bytes_checked(texts: DataFrame, rows: DataFrame, several: DataFrame) -> DataFrame:
    """The groups, once all texts of each are found to be the same bytes.

    The least and the greatest text of a group are equal if and only if all are; both are found map-side first, so that a
    task sends one pair of texts for a group of any size. A digest that stands for two texts would be a SHA-256 collision;
    it stops the job rather than merge texts that differ.
    """
    digests = several.select("text_sha256")
    digests = F.broadcast(digests) if digests.count() <= BROADCAST_ROWS // 4 else digests
    members = texts.withColumn("text_sha256", F.sha2("text", 256)).join(digests, "text_sha256", "left_semi")
    ends = members.groupBy("text_sha256").agg((F.min("text") == F.max("text")).alias("same"))
    same = F.when(F.col("same"), F.lit(True)).otherwise(F.raise_error(F.lit("one digest for two texts")).cast("boolean"))
    return several.join(ends.select("text_sha256", same.alias("same")), "text_sha256").filter("same").drop("same")
