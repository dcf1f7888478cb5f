"""Op 9: byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of `shards` sums. Differencing takes the two partial partitions with the largest spread
(largest sum less smallest) and adds them in opposite order, until one is left. It is done in levels so that no task and not
the driver sees all groups: tasks difference at most CHUNK groups into one partial partition each, tasks difference CHUNK of
those, and so on. Each level keeps which local bin went to which bin above; joins on (chunk, bin) carry that to the documents.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import attach_groups, cut, gapless_rank, prepare, text_of

#: Partial partitions that one task differences.
CHUNK = 50_000


def difference(vectors: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Karmarkar-Karp over vectors of equal length: for each vector the final bin of each of its entries, and the final sums.

    Ties go to the vector that came first. Vectors keep their entries apart: no two entries of one vector share a bin.
    """
    k = len(vectors[0])
    order = [sorted(range(k), key=lambda b, v=v: (-v[b], b)) for v in vectors]
    sums = [[v[b] for b in o] for v, o in zip(vectors, order)]
    # A node is a leaf or (left, right, permutation of each into its own sorted bins).
    nodes: list[tuple] = [("leaf",)] * len(vectors)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = [sums[a][j] + sums[b][k - 1 - j] for j in range(k)]
        at = sorted(range(k), key=lambda j: (-merged[j], j))
        place = [0] * k
        for p, j in enumerate(at):
            place[j] = p
        nodes.append((a, b, place))
        sums.append([merged[j] for j in at])
        sums[a] = sums[b] = []
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(nodes) - 1))
    root = heap[0][1]
    final: list[list[int]] = [[] for _ in vectors]
    stack = [(root, list(range(k)))]
    while stack:
        node, to = stack.pop()
        if node < len(vectors):
            bins = [0] * k
            for p, b in enumerate(order[node]):
                bins[b] = to[p]
            final[node] = bins
        else:
            a, b, place = nodes[node]
            stack.append((a, [to[place[j]] for j in range(k)]))
            stack.append((b, [to[place[k - 1 - j]] for j in range(k)]))
    return final, sums[root]


def _level(shards: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending")])
        vectors = group["sums"].to_pylist()
        bins, sums = difference(vectors)
        n = len(vectors)
        return pa.table({"chunk": pa.array(group["chunk"].to_pylist(), pa.int64()), "id": group["id"].cast(pa.int64()), "bins": pa.array(bins, pa.list_(pa.int32())), "sums": pa.array([sums] + [None] * (n - 1), pa.list_(pa.int64()))})

    return run


def partition_groups(groups: DataFrame, shards: int, chunk: int = CHUNK) -> DataFrame:
    """(id, shard) for groups of (id long, size long); ids are distinct. An empty table gives no rows."""
    at = groups.select("id", F.array(F.col("size").cast("long"), *[F.lit(0).cast("long")] * (shards - 1)).alias("sums"))
    levels = []
    n = groups.count()
    while n:
        chunks = -(-n // chunk)
        dealt = at.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
        done = cut(dealt.groupBy("chunk").applyInArrow(_level(shards), "chunk long, id long, bins array<int>, sums array<long>"))
        levels.append(done)
        if chunks == 1:
            break
        at = done.filter("sums is not null").select(F.col("chunk").alias("id"), "sums")
        n = at.count()
    if not levels:
        return groups.select("id", F.lit(0).alias("shard"))
    # From the last level, which holds few rows, back to the first.
    above = levels[-1].select("id", "bins")
    for level in reversed(levels[:-1]):
        up = above.select(F.col("id").alias("chunk"), F.col("bins").alias("up"))
        above = level.select("chunk", "id", "bins").join(up, "chunk").select("id", F.transform("bins", lambda b: F.element_at("up", b + 1)).alias("bins"))
    return above.select("id", F.element_at("bins", 1).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards of nearly equal bytes (law `bytes`); equal texts stay together.

    size is the UTF-8 length of the text plus 1; null and empty texts have size 1 and count as equal. Repeated rows are each
    placed. A group larger than a shard's fair share stays whole. Empty table: no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    text = text_of()
    # Two independent 64-bit hashes and the length tell texts apart.
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("id"), F.xxhash64(F.lit(41), text).alias("other"), F.monotonically_increasing_id().alias("_row")))
    total = rows.count()
    texts = rows.groupBy("id", "other", "size").agg(F.count("*").alias("copies"))
    # A clash of the first hash would join two texts into one group, which no law forbids.
    groups = cut(texts.groupBy("id").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("copies")))
    placed = cut(groups.join(partition_groups(groups, shards, chunk), "id").select("id", "copies", "shard"))
    out = attach_groups(rows, placed, "id", "copies", total)
    out = gapless_rank(out, "shard", ["doc_id", "_row"], "slot", total)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
