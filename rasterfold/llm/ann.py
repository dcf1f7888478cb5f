"""Op 3: approximate nearest neighbours by learned partitions.

On a bounded sample, the neighbour graph is built and cut into partitions of equal size with few edges between them; a small
network then learns the partition of a vector. It puts every row of the table in its most probable partition and sends a
query to the several most probable ones, as many as a held-out part of the sample needs for the recall asked for. There all
rows are compared, in blocks, and candidates are reranked by exact distances in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.llm.common import cut, prepare

#: Vectors that partitions and network are fitted on, at most; neighbours in the graph; partitions; hidden units.
SAMPLE, GRAPH, PARTITIONS, HIDDEN = 8000, 10, 32, 96
#: The share of true neighbours that the calibration on held-out vectors asks for.
RECALL = 0.97
#: Rows, and queries, that one task compares.
BLOCK = 8192


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Indices into y of the k nearest of each row of x, in blocks."""
    out = []
    squares = (y * y).sum(1)
    for at in range(0, len(x), 1024):
        d = squares - 2 * x[at : at + 1024] @ y.T
        out.append(np.argpartition(d, min(k, len(y) - 1), axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def balanced_partition(graph: np.ndarray, parts: int, x: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A label for each vertex; no part holds more than 5 % above the mean.

    Parts grow from far-apart seeds through the vectors and are then refined: vertices move to the part that most of their
    neighbours are in, those that gain most first, as far as room allows.
    """
    n = len(graph)
    room = int(np.ceil(n / parts * 1.05))
    seeds = [int(rng.integers(n))]
    far = ((x - x[seeds[0]]) ** 2).sum(1)
    while len(seeds) < parts:
        seeds.append(int(rng.choice(n, p=far / far.sum())) if far.sum() > 0 else int(rng.integers(n)))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(1))
    centers = x[seeds]
    label = np.zeros(n, np.int64)
    for _ in range(8):
        d = ((x**2).sum(1)[:, None] - 2 * x @ centers.T) + (centers**2).sum(1)
        load = np.zeros(parts, np.int64)
        order = np.argsort(d.min(1) - np.partition(d, min(1, parts - 1), axis=1)[:, min(1, parts - 1)], kind="stable")
        choice = np.argsort(d, axis=1)
        for v in order:
            for p in choice[v]:
                if load[p] < room:
                    label[v], load[p] = p, load[p] + 1
                    break
        centers = np.stack([x[label == p].mean(0) if load[p] else centers[p] for p in range(parts)])
    rows = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.bincount(rows * parts + label[graph.ravel()], minlength=n * parts) + np.bincount(graph.ravel() * parts + label[rows], minlength=n * parts)
        votes = votes.reshape(n, parts)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        load, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if load[want[v]] < room:
                load[label[v]] -= 1
                load[want[v]] += 1
                label[v] = want[v]
                moved += 1
        if not moved:
            break
    return label


def fit_network(x: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator, epochs: int = 40) -> dict[str, np.ndarray]:
    """One hidden layer, softmax over partitions, Adam."""
    mean, scale = x.mean(0), x.std() + 1e-12
    z = (x - mean) / scale
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            i = order[at : at + 256]
            h = np.maximum(z[i] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), label[i]] -= 1
            p /= len(i)
            dh = (p @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((z[i].T @ dh, dh.sum(0), h.T @ p, p.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - 0.002 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w0": w[0], "b0": w[1], "w1": w[2], "b1": w[3]}


def ranked_partitions(net: dict, x: np.ndarray) -> np.ndarray:
    """Partitions of each row, the most probable first."""
    h = np.maximum((x - net["mean"]) / net["scale"] @ net["w0"] + net["b0"], 0)
    return np.argsort(-(h @ net["w1"] + net["b1"]), axis=1, kind="stable")


def fit_index(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[dict, int]:
    """The network and the number of partitions to probe: the fewest that reach the recall on vectors held out of the fit, plus one."""
    rng = np.random.default_rng(7)
    held = rng.permutation(len(x))[: max(1, len(x) // 10)]
    kept = np.setdiff1d(np.arange(len(x)), held)
    base = x[kept]
    graph = nearest(base, base, min(GRAPH + 1, len(base)))
    net = fit_network(base, balanced_partition(graph, parts, base, rng), parts, rng)
    place = ranked_partitions(net, base)[:, 0]
    order, truth = ranked_partitions(net, x[held]), nearest(x[held], base, min(k, len(base)))
    rank_of = np.argsort(order, axis=1)
    need = np.take_along_axis(rank_of, place[truth], 1)
    for probes in range(1, parts + 1):
        if (need < probes).mean() >= recall:
            return net, min(parts, probes + 1)
    return net, parts


def usable(column: Column, dimension: int) -> Column:
    good = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return column.isNotNull() & (F.size(column) == dimension) & good & F.exists(column, lambda v: v != 0)


def _placed(net: dict):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch["embedding"].flatten(), np.float64).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(net["mean"])))
            yield pa.record_batch({"vec_id": batch["vec_id"], "embedding": batch["embedding"].cast(pa.list_(pa.float64())), "ranked": pa.array(list(ranked_partitions(net, x).astype(np.int32)), pa.list_(pa.int32()))})

    return run


def block_top(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query in a block, with exact distances; ties go to the smaller id; rows of the query's own id are left out."""
    out: list[list[np.ndarray]] = [[], [], []]
    squares = (v * v).sum(1)
    slack = 1e-9 * (squares.max(initial=0) + (q * q).sum(1).max(initial=0))
    for at in range(0, len(q), 512):
        d = squares - 2 * q[at : at + 512] @ v.T
        d[qid[at : at + 512, None] == vid] = np.inf
        limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1] + slack
        for i, row in enumerate(d):
            near = np.flatnonzero((row <= limit[i]) & (row < np.inf))
            diff = v[near] - q[at + i]
            exact = np.sqrt((diff * diff).sum(1))
            best = np.lexsort((vid[near], exact))[:k]
            out[0].append(np.full(len(best), qid[at + i]))
            out[1].append(vid[near[best]])
            out[2].append(exact[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = (np.asarray(t["embedding"].combine_chunks().flatten()).reshape(len(t), -1) for t in (queries, rows))
        a, b, s = block_top(queries["vec_id"].to_numpy(), q, rows["vec_id"].to_numpy(), v, k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, partitions: int = PARTITIONS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that `is_query` holds for, by Euclidean distance.

    Vectors that are null, zero, of another than the commonest length or hold null or non-finite components take no part.
    Ties go to the smaller vec_id. With no more than k candidates all are returned: a query probes further partitions until
    they hold more than k rows. Rows that repeat a vec_id are one candidate, the nearest of them. An empty table gives no rows;
    other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    length = vectors.filter("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), length["d"])).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    n = rows.count()
    drawn = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(0.95 * sample / n * (1 << 30)))
    x = np.array([r["embedding"] for r in drawn.orderBy("vec_id").collect()], np.float64)
    if not len(x):
        return spark.createDataFrame([], schema)
    parts = max(1, min(partitions, len(x) // 50))
    net, probes = fit_index(x, parts, k, recall) if parts > 1 else (fit_network(x, np.zeros(len(x), np.int64), 1, np.random.default_rng(7), 1), 1)
    index = cut(rows.mapInArrow(_placed(net), "vec_id long, embedding array<double>, ranked array<int>"))
    index = index.withColumn("part", F.get("ranked", 0))
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    blocks = {p: -(-c // BLOCK) for p, c in sizes.items()}
    # A table of `partitions` rows: blocks of rows, and of queries, in each partition.
    held = F.create_map(*[F.lit(x) for p in range(parts) for x in (p, sizes.get(p, 0))])
    count = F.create_map(*[F.lit(x) for p in range(parts) for x in (p, blocks.get(p, 0))])
    queries = index.filter(is_query).select("vec_id", "embedding", F.slice("ranked", 1, parts).alias("ranked"))
    before = F.transform(F.sequence(F.lit(1), F.size("ranked")), lambda i: F.aggregate(F.slice("ranked", 1, i - 1), F.lit(0), lambda a, p: a + F.element_at(held, p)))
    probed = F.filter(F.arrays_zip("ranked", before.alias("before")), lambda z: (z["before"] <= k) | F.array_contains(F.slice("ranked", 1, probes), z["ranked"]))
    sent = queries.withColumn("part", F.explode(F.transform(probed, lambda z: z["ranked"])))
    per = {r["part"]: -(-r["count"] // BLOCK) for r in sent.groupBy("part").count().collect()}
    chunks = F.create_map(*[F.lit(x) for p in range(parts) for x in (p, max(1, per.get(p, 1)))])

    def dealt(df: DataFrame, own: str, of: Column, other: str, of_other: Column) -> DataFrame:
        """Each row in one block of its own side and in all blocks of the other side."""
        df = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.element_at(of, F.col("part"))).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.element_at(of_other, F.col("part")) - 1))).select("part", "rb", "qb", "vec_id", "embedding")

    left = dealt(sent.filter(F.element_at(count, F.col("part")) > 0), "qb", chunks, "rb", count)
    right = dealt(index, "rb", count, "qb", chunks)
    keys = ["part", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
