"""Op 7: set-similarity self-join of documents on word shingles, as a blocked sparse matrix product.

The incidence matrix has a row for each document and a column for each shingle. Two rows of a and b entries whose Jaccard
similarity is at least num/den differ in at most k = floor((a + b) * (den - num) / (den + num)) entries. Columns are dealt
by hash into k + 1 blocks, so such rows must agree entirely on one block at least: this bound, which depends on sizes alone,
says which entries of the product are wanted. Rows are compared only within size classes (a row's own class and the next),
where k is one number.

Blocks with fewer than two entries say little, and many rows would agree on them. So E spare blocks are added: then linked
rows agree on E + 1 blocks at least. Blocks that agree are small in both rows or in neither, so a row with at most E small
blocks may leave all of them out and still shares a block of two entries or more with each of its links. The few rows with
more small blocks keep them.

1. One pass over the texts gives each row's size, a digest of its set and a digest of each of its column blocks. Equal sets
   count once from here on, as the smallest document that has them.
2. Rows that agree on a block are paired with the smallest of them (a star), not with each other. Sizes, entries counted over
   column ranges and parity bits (about as many as a row has entries) bound the differences of a pair from below; a pair
   beyond its own k is dropped. The product of the others accumulates their overlap over column ranges; an entry is dropped
   as soon as what it has and what the rows have left can't reach the size-derived count.
3. Links contract the groups. In groups that still hold several components, rows outside of the group's largest component are
   compared with the group, in row blocks. A task screens the pairs of its two row blocks that lie in different components,
   and sends only a spanning forest of those that may link: fewer pairs than rows. Their products contract the groups again.
4. Row blocks that sent something are looked at once more. Rows that still may link across components come with their entries,
   their product is accumulated within the task, and again only a spanning forest of the links leaves it.
So no link between different texts is lost, equal texts are never paired with each other, and what is sent of a group grows
with its rows, not with its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.llm.common import BROADCAST_ROWS, attach_groups, components, cut, documents_of, fresh_worker, mix, prepare, release, removed, shingle_set, shuffles_dropped, stored, worker_store

#: Column ranges in which a row's entries are counted (up to 255 each), and the wider ranges that are compared first.
RANGES, WIDE = 128, 32
#: Rows of a group that one task compares with as many others.
ROW_BLOCK = 2000
#: Bytes of the rows that one row block holds, at most (a single row may be larger).
BLOCK_BYTES = 32 << 20
#: Rows of small tiles that one call handles together; pairs that it looks at together.
TASK_ROWS, PAIRS = 4000, 100_000
#: Column ranges over which overlaps are accumulated, a power of two; entries and bytes that are handled at once.
COLUMN_BLOCKS, PRODUCT_ENTRIES, PAIR_BYTES = 8, 2_000_000, 16 << 20
#: Digests of sets that a task remembers, so that copies within it are emitted once.
SEEN = 200_000


def size_classes(n: int, num: int, den: int) -> tuple[int, int, int]:
    """The class of size n and the ends of this class and the next. Sizes a <= b that can link are in one class or in two neighbouring ones."""
    low, c = 1, 0
    while True:
        high = low * den // num
        if n <= high:
            return c, high, (high + 1) * den // num
        low, c = high + 1, c + 1


def differences(total: int, num: int, den: int) -> int:
    """The most entries in which two linked rows with `total` entries together can differ."""
    return total * (den - num) // (den + num)


def spare_blocks(k: int, least: int) -> int:
    """How many blocks to add beyond k + 1, so that most rows of `least` entries or more have no more small blocks than that; 0 if that takes too many."""
    known = worker_store("spare blocks")
    if (k, least) not in known:
        known[k, least] = 0
        for spare in range(k // 3 + 2):
            n = k + 1 + spare
            small = n * math.exp(-least / n) * (1 + least / n)
            if spare >= small + 2.5 * math.sqrt(small):
                known[k, least] = spare
                break
    return known[k, least]


def block_digests(h: np.ndarray, c: int, k: int, least: int) -> np.ndarray:
    """Digests of the column blocks of a sorted row; blocks are equal ranges of the hash space."""
    spare = spare_blocks(k, least)
    blocks = k + 1 + spare
    edges = (np.arange(blocks + 1, dtype=np.float64) / blocks * 2.0**64).astype(np.float64)
    at = np.empty(blocks + 1, np.int64)
    at[0], at[-1] = 0, len(h)
    at[1:-1] = np.searchsorted(h, edges[1:-1].astype(np.uint64))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
        own = total[at[1:]] - total[at[:-1]]
        out = mix(own + mix(np.arange(blocks, dtype=np.uint64) + np.uint64((c + 1) << 40)))
    small = np.diff(at) < 2
    return out[~small] if small.sum() <= spare else out


def range_counts(h: np.ndarray) -> np.ndarray:
    """Entries per column range. The L1 distance of two rows' counts, clipped or not, is at most the number of their differences."""
    at = np.searchsorted(h, np.arange(1, RANGES, dtype=np.uint64) << np.uint64(57))
    return np.minimum(np.diff(np.concatenate([[0], at, [len(h)]])), 255).astype(np.uint8)


def parity_bits(h: np.ndarray) -> bytes:
    """Whether the entries per residue are odd in number, for a power of two of residues from the row's size on, 64 at least. An entry that one row alone has flips one bit."""
    n = 1 << max(6, (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Parity bits of many rows, a matrix for each width."""

    def __init__(self, bits: list[bytes]) -> None:
        self.width = np.fromiter(map(len, bits), np.int64, len(bits))
        self.place = np.zeros(len(bits), np.int64)
        self.matrix: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.matrix[w] = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(len(own), -1)

    def flipped(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits that differ between rows x and rows y: at most the number of differences of the two rows. Wider bits are folded to the other's width."""
        out = np.zeros(len(x), np.int64)
        both = self.width[x] * (1 << 40) + self.width[y]
        for pair in np.unique(both).tolist():
            wx, wy = divmod(pair, 1 << 40)
            at = np.flatnonzero(both == pair)
            step = max(1, PAIR_BYTES // (wx + wy))
            for k in range(0, len(at), step):
                own = at[k : k + step]
                a, b = self.matrix[wx][self.place[x[own]]], self.matrix[wy][self.place[y[own]]]
                while a.shape[1] != b.shape[1]:
                    if a.shape[1] < b.shape[1]:
                        a, b = b, a
                    half = a.shape[1] // 2
                    a = a[:, :half] ^ a[:, half:]
                out[own] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out


def linked(values: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which entries (a, b) of the sparse product of the matrix with its transpose meet the bound.

    The matrix has the row values[ends[i] : ends[i + 1]], sorted, for each i. Overlaps are accumulated over COLUMN_BLOCKS column
    ranges, for all entries together. An entry is dropped once its overlap and what is left of the shorter row can't reach
    num/den, and accepted once it has.
    """
    out = np.zeros(len(a), bool)
    if not len(values) or not len(a):
        return out
    columns, column = np.unique(values, return_inverse=True)
    sizes = np.diff(ends)
    key = np.repeat(np.arange(len(sizes)), sizes) * len(columns) + column
    # Where the column ranges of each row start.
    ranges = np.repeat(np.arange(len(sizes)), sizes) * COLUMN_BLOCKS + (values >> np.uint64(64 - COLUMN_BLOCKS.bit_length() + 1)).astype(np.int64)
    parts = np.bincount(ranges, minlength=len(sizes) * COLUMN_BLOCKS).reshape(len(sizes), COLUMN_BLOCKS)
    starts = np.concatenate([ends[:-1, None], ends[:-1, None] + parts.cumsum(1)], 1)
    need = -(-num * (sizes[a] + sizes[b]) // (num + den))
    alive = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= np.maximum(need, 1))
    step = max(1, int(PRODUCT_ENTRIES * max(len(alive), 1) / max(int(sizes[a[alive]].sum()), 1)))
    for at in range(0, len(alive), step):
        own = alive[at : at + step]
        count = np.zeros(len(own), np.int64)
        for c in range(COLUMN_BLOCKS):
            x, y = a[own], b[own]
            n = starts[x, c + 1] - starts[x, c]
            pair = np.repeat(np.arange(len(own)), n)
            entry = np.arange(len(pair)) + np.repeat(starts[x, c] - (n.cumsum() - n), n)
            wanted = column[entry] + y[pair] * len(columns)
            found = np.searchsorted(key, wanted)
            hit = key[np.minimum(found, len(key) - 1)] == wanted
            count += np.bincount(pair[hit], minlength=len(own))
            reached = count >= need[own]
            out[own[reached]] = True
            left = np.minimum(ends[x + 1] - starts[x, c + 1], ends[y + 1] - starts[y, c + 1])
            stay = ~reached & (count + left >= need[own])
            own, count = own[stay], count[stay]
    return out


def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Values and row ends of rows given as bytes."""
    ends = np.concatenate([[0], np.cumsum([len(r) // 8 for r in rows], dtype=np.int64)])
    return np.frombuffer(b"".join(rows), np.uint64), ends


def _set_digests(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(keep="spare blocks")
        seen: set[bytes] = set()
        for batch in batches:
            ids, sizes, sets, counts, parities, digests = [], [], [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                h = shingle_set(text.as_py(), size)
                n = len(h)
                ids.append(doc)
                sizes.append(n)
                own = xxhash.xxh3_128_digest(h.tobytes()) if n else None
                sets.append(own)
                counts.append(range_counts(h).tobytes() if n else None)
                parities.append(parity_bits(h) if n else None)
                if not n or own in seen:
                    digests.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(own)
                c, high, far = size_classes(n, num, den)
                # A class's blocks also hold the rows of the class below, down to about num / den squared of its largest.
                least = [max(1, x * num * num // (den * den)) for x in (high, far)]
                parts = [block_digests(h, c, differences(2 * high, num, den), least[0])]
                if n * den // num > high:
                    parts.append(block_digests(h, c + 1, differences(2 * far, num, den), least[1]))
                digests.append(np.concatenate(parts).view(np.int64))
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "set_digest": pa.array(sets, pa.binary()), "counts": pa.array(counts, pa.binary()), "parity": pa.array(parities, pa.binary()), "blocks": pa.array(digests, pa.list_(pa.int64()))})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingle_set(t.as_py(), size).tobytes() for t in batch["text"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "digest": pa.array([xxhash.xxh3_64_intdigest(r) >> 1 for r in rows], pa.int64()), "hashes": pa.array(rows, pa.binary())})

    return run


def _product(num: int, den: int):
    """Products of the pairs of a batch: both ends' rows make the matrix, and the pairs are the entries wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            values, ends = matrix(batch["x"].to_pylist() + batch["y"].to_pylist())
            keep = linked(values, ends, np.arange(n), np.arange(n, 2 * n), num, den)
            yield pa.record_batch({"u": batch["u"], "v": batch["v"]}).filter(pa.array(keep))

    return run


def _plausible(num: int, den: int):
    """Keeps pairs that sizes and range counts don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for c in ("x", "y"))
            n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
            keep = (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (np.abs(a - b).sum(1) <= (n + m) * (den - num) // (den + num))
            yield pa.record_batch({"u": batch["u"], "v": batch["v"]}).filter(pa.array(keep))

    return run


def _near(num: int, den: int):
    """Keeps pairs that parity bits don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            flips = Parities(batch["x"].to_pylist() + batch["y"].to_pylist()).flipped(np.arange(n), np.arange(n, 2 * n))
            yield pa.record_batch({"u": batch["u"], "v": batch["v"]}).filter(pa.array(flips <= differences(batch["total"].to_numpy(), num, den)))

    return run


# ---- groups that stars don't join -------------------------------------------------------------

TILE = "block long, kind int, i int, j int"
TILE_KEY = ["block", "kind", "i", "j"]
TILE_ROWS = f"bucket int, {TILE}, side int, doc_id long, component long, n_shingles long, counts binary, parity binary"


class Tiles:
    """Pairs of row blocks of groups: which pairs of rows in different components may link. A task sees many small ones at once."""

    def __init__(self, group: pa.Table, num: int, den: int) -> None:
        self.group = group = group.sort_by([(c, "ascending") for c in (*TILE_KEY, "doc_id")])
        self.num, self.den = num, den
        self.ids, self.total = group["doc_id"].to_numpy(), group["n_shingles"].to_numpy()
        self.side = group["side"].to_numpy()
        keys = np.stack([group[c].to_numpy() for c in TILE_KEY], 1)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        self.tile = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.start, self.end = starts[self.tile], np.append(starts[1:], len(keys))[self.tile]
        component = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        self.label = np.unique(self.tile * len(keys) + component, return_inverse=True)[1]
        self.counts = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16)
        self.wide = self.counts.reshape(len(self.ids), WIDE, -1).sum(2, dtype=np.int16)
        self.parities = Parities(group["parity"].to_pylist())

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that sizes, range counts and parity bits don't rule out, in parts, the nearest of a part first; labels may be merged in between."""
        total, side = self.total, self.side
        rows = np.flatnonzero(side != 2)
        before = np.concatenate([[0], np.cumsum(self.end[rows] - self.start[rows])])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
            own = rows[at:to]
            n = self.end[own] - self.start[own]
            x = np.repeat(own, n)
            y = np.arange(len(x)) + np.repeat(self.start[own] - (n.cumsum() - n), n)
            at = to
            fits = (side[y] != 1) & (self.label[x] != self.label[y]) & ((side[x] != 0) | (side[y] == 2) | (self.ids[x] < self.ids[y]))
            x, y = x[fits], y[fits]
            fits = np.minimum(total[x], total[y]) * self.den >= np.maximum(total[x], total[y]) * self.num
            x, y = x[fits], y[fits]
            for screen in (self.wide, self.counts):
                near = np.abs(screen[x] - screen[y]).sum(1) <= differences(total[x] + total[y], self.num, self.den)
                x, y = x[near], y[near]
            flips = self.parities.flipped(x, y)
            near = flips <= differences(total[x] + total[y], self.num, self.den)
            order = np.argsort(flips[near], kind="stable")
            yield x[near][order], y[near][order]

    def merged(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Merge the labels of these pairs; returns the pairs that were needed for it."""
        out = []
        for a, b in zip(x.tolist(), y.tolist()):
            one, other = self.label[a], self.label[b]
            if one != other:
                own = self.label[self.start[a] : self.end[a]]
                own[own == other] = one
                out.append((a, b))
        return out

    def edges(self, found: list[tuple[int, int]]) -> dict[str, np.ndarray]:
        at = np.array(found, np.int64).reshape(-1, 2)
        u, v = self.ids[at[:, 0]], self.ids[at[:, 1]]
        return {"u": np.minimum(u, v), "v": np.maximum(u, v)}


def _forest(num: int, den: int):
    """A spanning forest of the pairs that may link, with their tile's key."""

    def run(group: pa.Table) -> pa.Table:
        tiles = Tiles(group, num, den)
        found = [pair for x, y in tiles.pairs() for pair in tiles.merged(x, y)]
        key = tiles.group.select(TILE_KEY).take(pa.array([a for a, _ in found], pa.int64()))
        return pa.table({c: key[c] for c in TILE_KEY} | tiles.edges(found))

    return run


def _open_rows(num: int, den: int):
    """The rows that may link across components of a tile."""

    def run(group: pa.Table) -> pa.Table:
        tiles = Tiles(group, num, den)
        mark = np.zeros(len(group), bool)
        for x, y in tiles.pairs():
            mark[x], mark[y] = True, True
        return tiles.group.filter(pa.array(mark))

    return run


def _forest_of_links(num: int, den: int):
    """A spanning forest of the links across components, from the product within a tile."""

    def run(group: pa.Table) -> pa.Table:
        tiles = Tiles(group, num, den)
        values, ends = matrix(tiles.group["hashes"].to_pylist())
        found = []
        for x, y in tiles.pairs():
            meets = linked(values, ends, x, y, num, den)
            found += tiles.merged(x[meets], y[meets])
        return pa.table(tiles.edges(found))

    return run


def _tiles(members: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """The tiles' rows of groups with several components: block, kind, i, j, side, doc_id, component.

    Rows outside of the group's largest component (minor ones) are compared with each other (kind 0) and with the others (kind
    1), each in row blocks, so a group that is one component but for a few rows is dealt out about once. The others' first row
    block goes to the tiles in which a minor row block meets itself, so of a small group each row is in one tile.
    """
    at = members.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(rows.select("doc_id", "n_shingles"), "doc_id")
    at = at.select("block", "doc_id", F.coalesce("component", "doc_id").alias("component"), "n_shingles")
    parts = at.groupBy("block", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = parts.groupBy("block").agg(F.count("*").alias("_c"), F.max(F.struct("n", "s", "component")).alias("_big"), F.sum("n").alias("_n"), F.sum("s").alias("_s")).filter("_c > 1")

    def blocks(n, s):
        return F.greatest(F.ceil(n / ROW_BLOCK), F.ceil(s * 8 / BLOCK_BYTES)).cast("int")

    big = F.col("_big")
    whole = whole.select("block", big["component"].alias("_largest"), blocks(F.col("_n") - big["n"], F.col("_s") - big["s"]).alias("_m"), blocks(big["n"], big["s"]).alias("_k"))
    rest = at.join(whole, "block").withColumn("_minor", F.col("component") != F.col("_largest"))
    rest = rest.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.when(F.col("_minor"), F.col("_m")).otherwise(F.col("_k"))).cast("int"))

    def places(n, f, first=0):
        return F.transform(F.filter(F.sequence(F.lit(0), F.col(n) - 1), lambda o: o >= first), f)

    def place(kind, i, j, side):
        return F.struct((F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    b = F.col("_b")
    among = places("_m", lambda o: place(0, F.least(b, o), F.greatest(b, o), F.when(b == o, 0).when(b < o, 1).otherwise(2)))
    to_major = places("_k", lambda o: place(1, b, o, F.lit(1)), 1)
    to_minor = places("_m", lambda o: place(F.when(b == 0, 0).otherwise(1), o, F.when(b == 0, o).otherwise(b), F.lit(2)))
    spread = F.explode(F.when(F.col("_minor"), F.concat(among, to_major)).otherwise(to_minor)).alias("_t")
    return rest.select("block", "doc_id", "component", spread).select("block", "_t.kind", "_t.i", "_t.j", "_t.side", "doc_id", "component")


# ---- the join ---------------------------------------------------------------------------------


def _rows_of(docs: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """The rows of the incidence matrix of the documents in ends, from the texts."""
    ends = cut(ends.distinct())
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    return cut(docs.join(ends, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, digest long, hashes binary").dropDuplicates(["doc_id", "digest"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v"))


def _attached(pairs: DataFrame, rows: DataFrame, *names: tuple[str, str, str]) -> DataFrame:
    """Columns of both ends; each name is (column, its name for u, its name for v)."""
    for end, k in (("u", 1), ("v", 2)):
        pairs = pairs.join(rows.select(F.col("doc_id").alias(end), *[F.col(n[0]).alias(n[k]) for n in names]), end)
    return pairs


def _screened(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    counted = _attached(pairs, rows, ("n_shingles", "n", "m"), ("counts", "x", "y"))
    likely = cut(counted.select("u", "v", "n", "m", "x", "y").mapInArrow(_plausible(num, den), "u long, v long"))
    both = _attached(likely, rows, ("n_shingles", "n", "m"), ("parity", "x", "y"))
    return cut(both.select("u", "v", (F.col("n") + F.col("m")).alias("total"), "x", "y").mapInArrow(_near(num, den), "u long, v long"))


def _verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs that link, by the product of their whole rows."""
    both = _attached(pairs, _rows_of(docs, _ends(pairs), size), ("hashes", "x", "y"))
    return cut(both.select("u", "v", "x", "y").mapInArrow(_product(num, den), "u long, v long"))


def ngram_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked when their sets of `size`-word shingles have a Jaccard similarity of num/den or more.

    Words are runs of non-blank characters after lower-casing A-Z. Fewer than `size` words: the whole sequence is the one
    shingle. Null text, empty text and text without words: an empty set, linked with nothing, its own component. Copies share
    a component. A doc_id that repeats gives each of its rows; with different texts it is linked with whatever any of them
    links with. A null doc_id is linked with nothing and its component is null. Empty table: no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    with shuffles_dropped(spark):
        return _components(spark, documents_of(docs), size, num, den)


def _components(spark: SparkSession, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    found = docs.mapInArrow(_set_digests(size, num, den), "doc_id long, n_shingles long, set_digest binary, counts binary, parity binary, blocks array<long>")
    found, path3 = stored(found)
    release(spark)
    own = found.select("doc_id", "n_shingles", "set_digest", "counts", "parity")
    sets = own.filter("set_digest is not null and doc_id is not null")
    rows = sets.select("doc_id", "n_shingles", "set_digest", "counts", "parity").dropDuplicates(["doc_id", "set_digest"]).drop("set_digest")
    # Copies: each with the smallest document of its set, which stands for all of them.
    copies = sets.groupBy("set_digest").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("_last"), F.count("*").alias("group_size"))
    copies = cut(copies.filter("u != _last").drop("_last"))
    same = cut(attach_groups(sets.select("set_digest", F.col("doc_id").alias("v")), copies, "set_digest", "group_size", own.count()).filter("u != v").select("u", "v").distinct())

    def standing(df: DataFrame, name: str) -> DataFrame:
        return df.join(same.select(F.col("v").alias(name), F.col("u").alias("_s")), name, "left").withColumn(name, F.coalesce("_s", name)).drop("_s")

    # Members of blocks that several rows share, with the smallest of them.
    members = found.filter("doc_id is not null").select("doc_id", F.explode("blocks").alias("block"))
    centers = members.groupBy("block").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("_last"), F.count("*").alias("n"))
    centers = cut(centers.filter("center != _last").drop("_last"))
    release(spark)
    places = found.filter("doc_id is not null").agg(F.sum(F.size("blocks"))).first()[0] or 0
    # A group of two is its star alone: its one pair is kept, and not its block.
    shared, path = stored(attach_groups(members, centers, "block", "n", places).filter("n > 2 or doc_id != center").select(F.when(F.col("n") > 2, F.col("block")).alias("block"), "doc_id", "center"))
    release(spark)
    star = standing(standing(shared.filter("doc_id != center").select(F.col("center").alias("u"), F.col("doc_id").alias("v")).distinct(), "u"), "v")
    star = cut(star.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    links = _verified(_screened(star, rows, num, den), docs, size, num, den)
    groups, path2 = stored(standing(shared.filter("block is not null").select("block", "doc_id"), "doc_id").distinct())
    removed(spark, path)
    release(spark)
    # First a spanning forest of what may link in each tile, then, in tiles that sent one, of what links.
    places, path4 = stored(_tiles(groups, components(links), rows))
    bucket = F.pmod(F.xxhash64(*TILE_KEY), F.lit(-(-places.count() // TASK_ROWS) + 1)).cast("int").alias("bucket")
    tiles = places.select(bucket, "*").join(rows, "doc_id")
    forest = cut(tiles.groupBy("bucket").applyInArrow(_forest(num, den), f"{TILE}, u long, v long"))
    release(spark)
    links = links.unionByName(_verified(forest.select("u", "v").distinct(), docs, size, num, den)).unionByName(same)
    labels = components(links)
    again = places.select(bucket, "*").drop("component").join(forest.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi").join(rows, "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    again = again.select("bucket", *TILE_KEY, "side", "doc_id", F.coalesce("component", "doc_id").alias("component"), "n_shingles", "counts", "parity")
    open_ = cut(again.groupBy("bucket").applyInArrow(_open_rows(num, den), TILE_ROWS))
    more = open_.join(_rows_of(docs, open_.select("doc_id"), size).drop("digest"), "doc_id").groupBy("bucket").applyInArrow(_forest_of_links(num, den), "u long, v long")
    more = cut(more.distinct())
    for at in (path2, path4):
        removed(spark, at)
    labels = labels if more.isEmpty() else components(links.unionByName(more))
    out = cut(own.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    removed(spark, path3)
    return out
