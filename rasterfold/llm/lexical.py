"""Op 12: ranked lexical search by best-first intervals of documents, bounded by range maxima of the posting lists.

Documents are dealt into blocks of a few thousand, and a block's postings lie list after list in one array with a sparse
table over it: for each power of two, where the greatest impact of that many postings stands. A list's greatest impact among the documents of an
interval is then the better of two entries, and the sum over a query's lists bounds every document of the interval. Intervals are taken
highest bound first, many at a time, and split at the document with the greatest impact, which gets its exact score; an interval of few postings is
scored whole. A block is done when no bound reaches its k-th score. Queries aren't broadcast: each posting list is joined with
the queries that hold its term.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.llm.common import BROADCAST_ROWS, attach_groups, prepare, removed, stored, text_of

#: Documents of a block, and items that a task searches it for.
BLOCK_DOCS, GROUP_ITEMS = 8_192, 2_000
#: Intervals taken at once, and postings up to which an interval is scored whole.
AT_ONCE, FEW = 64, 256
#: ASCII other than letters and digits parts terms; A-Z become small; every other byte belongs to a term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


# ---- terms ------------------------------------------------------------------------------------


def _count(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value if wanted is not None else None
        for batch in batches:
            out: dict[str, list] = {"id": [], "at": [], "n": [], "terms": [], "tfs": []}
            for id, at, text in zip(batch["id"].to_pylist(), batch["at"].to_pylist(), batch["text"]):
                words = terms_of(text.as_py())
                if not words:
                    continue
                tf = Counter(words)
                mine = list(tf) if only is None else list(only.intersection(tf))
                out["id"].append(id)
                out["at"].append(at)
                out["n"].append(len(words))
                out["terms"].append(mine)
                out["tfs"].append([tf[t] for t in mine])
            kinds = {"id": pa.int64(), "at": pa.int64(), "n": pa.int64(), "terms": pa.list_(pa.string()), "tfs": pa.list_(pa.int32())}
            yield pa.record_batch({c: pa.array(out[c], kinds[c]) if c != "terms" else pa.array(out[c], pa.list_(pa.binary())).cast(kinds[c]) for c in kinds})

    return run


def term_counts(rows: DataFrame, id: str, wanted=None) -> DataFrame:
    """id, at (a hash of the row), n (terms with repeats), terms (distinct), tfs, for each text with a term.

    `wanted`, a broadcast set of terms, leaves the other terms out of the lists; n counts all.
    """
    prepare(rows.sparkSession)
    text = text_of()
    return rows.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("at"), text.alias("text")).mapInArrow(_count(wanted), "id long, at long, n long, terms array<string>, tfs array<int>")


def _exploded(counts: DataFrame) -> DataFrame:
    return counts.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


def _wanted(queries: DataFrame):
    """The terms of the queries as a broadcast set, if few enough; else None, and the join with the queries leaves terms out."""
    terms = queries.select("term").distinct().limit(BROADCAST_ROWS // 4 + 1).collect()
    return queries.sparkSession.sparkContext.broadcast(frozenset(r["term"].encode() for r in terms)) if len(terms) <= BROADCAST_ROWS // 4 else None


# ---- blocks -----------------------------------------------------------------------------------


def _invert(documents: int, terms: int):
    """The posting lists of a block. Impacts are whole: (10^9 tf) div (1000 tf + 12 m), m from the length and the mean length."""

    def run(group: pa.Table) -> pa.Table:
        id = group["id"].to_numpy(zero_copy_only=False) if not group["id"].null_count else np.array([np.iinfo(np.int64).max if x is None else x for x in group["id"].to_pylist()])
        group = group.take(np.lexsort((id, group["id"].is_null().to_numpy())))
        lists = group["terms"].combine_chunks()
        size = np.diff(np.asarray(lists.offsets))
        doc = np.repeat(np.arange(len(group), dtype=np.int32), size)
        tf = group["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 75 + 25 * group["n"].to_numpy() * documents // terms
        impact = (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        order = np.argsort(code, kind="stable")  # documents stay in order
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).tolist()
        doc, impact = doc[order], impact[order]
        names = coded.dictionary.to_pylist()
        block = group["block"][0].as_py()
        return pa.table({
            "block": pa.array([block] * (len(names) + 1), pa.int32()),
            "term": pa.array([*names, ""], pa.string()),
            "docs": pa.array([*[doc[a:b].tobytes() for a, b in zip(starts, starts[1:])], b""], pa.binary()),
            "impacts": pa.array([*[impact[a:b].tobytes() for a, b in zip(starts, starts[1:])], b""], pa.binary()),
            "ids": pa.array([*[None] * len(names), group["id"].to_pylist()], pa.list_(pa.int64())),
        })

    return run


def posting_lists(counts: DataFrame, documents: int, terms: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """block, term, docs (numbers within the block), impacts, ids: one row a block and term, and one of the empty term with the block's ids."""
    blocks = max(1, -(-documents // block_docs))
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_invert(documents, terms), "block int, term string, docs binary, impacts binary, ids array<long>")


class Block:
    """A block's posting lists, one after another in the order of `lists`, and the sparse table over them."""

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray]) -> None:
        size = np.array([len(d) for d in docs], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.docs, self.impacts = np.concatenate(docs).astype(np.int64), np.concatenate(impacts)
        self.keys = np.repeat(np.arange(len(docs), dtype=np.int64) << 32, size) + self.docs
        self.best = [np.arange(len(self.docs), dtype=np.int32)]
        while 2 << (len(self.best) - 1) <= int(size.max()):
            last, half = self.best[-1], 1 << (len(self.best) - 1)
            a, b = last[:-half], last[half:]
            self.best.append(np.where(self.impacts[b] > self.impacts[a], b, a))
        self.log = np.zeros(int(size.max()) + 1, np.int64)
        for n in range(2, len(self.log)):
            self.log[n] = self.log[n >> 1] + 1

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the greatest impact of postings a to b stands, each range within one list; -1 for empty ranges."""
        out = np.full(a.shape, -1, np.int64)
        level = self.log[b - a]
        for k in np.unique(level):
            here = (level == k) & (b > a)
            if here.any():
                x, y = self.best[k][a[here]], self.best[k][b[here] - (1 << int(k))]
                out[here] = np.where(self.impacts[y] > self.impacts[x], y, x)
        return out

    def search(self, lists: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (numbers) with a score above 0, best first, ties to smaller numbers, and their scores."""
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        base, order = lists.astype(np.int64) << 32, itertools.count()
        heap: list[tuple] = []
        least = 1

        def offer(a: np.ndarray, b: np.ndarray) -> None:
            top = self.greatest(a, b)
            part = np.where(top >= 0, self.impacts[top] * weight, 0)
            bound, at = part.sum(1), part.argmax(1)
            for r in np.flatnonzero(bound >= least):
                heapq.heappush(heap, (-int(bound[r]), next(order), a[r], b[r], int(self.docs[top[r, at[r]]])))

        offer(self.start[lists][None], self.end[lists][None])
        while heap and -heap[0][0] >= least:
            taken = [heapq.heappop(heap) for _ in range(min(AT_ONCE, len(heap)))]
            a, b, split = np.stack([t[2] for t in taken]), np.stack([t[3] for t in taken]), np.array([t[4] for t in taken])
            whole = (b - a).sum(1) <= FEW
            found, gained = [], []
            if whole.any():
                lo, n = a[whole].ravel(), (b - a)[whole].ravel()
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                one, where = np.unique(self.docs[at], return_inverse=True)
                total = np.zeros(len(one), np.int64)
                np.add.at(total, where, self.impacts[at] * np.repeat(np.tile(weight, int(whole.sum())), n))
                found.append(one)
                gained.append(total)
            if not whole.all():
                a, b, split = a[~whole], b[~whole], split[~whole]
                cut = np.clip(np.searchsorted(self.keys, base[None] + split[:, None]), a, b)
                hit = (cut < b) & (self.docs[np.minimum(cut, len(self.docs) - 1)] == split[:, None])
                found.append(split)
                gained.append((np.where(hit, self.impacts[np.minimum(cut, len(self.docs) - 1)], 0) * weight).sum(1))
            docs, scores = np.concatenate([docs, *found]), np.concatenate([scores, *gained])
            docs, scores = docs[scores > 0], scores[scores > 0]
            first = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[first], scores[first]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
            if not whole.all():
                offer(np.concatenate([a, cut + hit]), np.concatenate([cut, b]))
        return docs, scores


def _search(k: int):
    def run(group: pa.Table) -> pa.Table:
        terms, docs, impacts = group["term"].to_pylist(), group["docs"].to_pylist(), group["impacts"].to_pylist()
        ids = next((x for t, x in zip(terms, group["ids"].to_pylist()) if t == ""), [])
        rows = [r for r, t in enumerate(terms) if t != ""]
        out: dict[str, list] = {"item_id": [], "doc_id": [], "score": []}
        if rows:
            block = Block([np.frombuffer(docs[r], np.int32) for r in rows], [np.frombuffer(impacts[r], np.int32) for r in rows])
            uses: dict[int | None, list[tuple[int, int]]] = {}
            weights, items = group["w"].to_pylist(), group["items"].to_pylist()
            for place, r in enumerate(rows):
                for item in items[r]:
                    uses.setdefault(item["item_id"], []).append((place, weights[r] * item["n"]))
            for item, own in uses.items():
                found, scores = block.search(np.array([p for p, _ in own]), np.array([w for _, w in own], np.int64), k)
                out["item_id"] += [item] * len(found)
                out["doc_id"] += [ids[d] for d in found.tolist()]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def weight_of(df: Column, documents: int) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * df + 1).cast("double"))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_docs: int = BLOCK_DOCS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k best documents with a score above 0, equal scores by ascending doc_id (null last).

    Null and empty texts have no term: such a document isn't counted, such an item has no result. Rows that repeat an item_id
    are one query of all their terms; rows that repeat a doc_id are documents of their own, each with a rank. A null item_id
    is an item as any other. An empty table on either side gives no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    queries, _ = stored(_exploded(term_counts(items, "item_id")).groupBy(F.col("id").alias("item_id"), "term").agg(F.sum("tf").cast("int").alias("n")))
    counts, path = stored(term_counts(docs, "doc_id", _wanted(queries)))
    whole = counts.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()  # two numbers
    index, _ = stored(posting_lists(counts, whole["documents"], whole["terms"], block_docs))
    removed(spark, path)
    groups = max(1, -(-queries.select("item_id").distinct().count() // group_items))
    held = index.filter("term != ''").groupBy("term").agg((F.sum(F.length("docs")) / 4).cast("long").alias("df"), F.count("*").alias("blocks"))
    dealt = queries.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int")).groupBy("term", "group").agg(F.collect_list(F.struct("item_id", "n")).alias("items"))
    lists = dealt.join(held, "term").select("term", "group", "items", weight_of(F.col("df"), max(whole["documents"], 1)).alias("w"), "blocks").filter("w > 0")
    if queries.count() <= BROADCAST_ROWS:
        used = index.join(F.broadcast(lists.drop("blocks")), "term")
    else:
        used = attach_groups(index, lists, "term", "blocks", index.count()).drop("blocks")
    named = index.filter("term = ''").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("items", F.lit(None).cast("array<struct<item_id:bigint,n:int>>")).withColumn("w", F.lit(0).cast("long"))
    columns = ["block", "group", "term", "docs", "impacts", "ids", "items", "w"]
    best = used.select(*columns).unionByName(named.select(*columns)).groupBy("block", "group").applyInArrow(_search(k), "item_id long, doc_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
