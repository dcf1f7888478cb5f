"""Op 2: packing token sequences by the configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits in one sequence. The covering program (fewest configurations so that every
length is covered as often as it occurs) is solved by multiplicative weights: each round prices lengths by their weights, and
an unbounded-knapsack dynamic program over the capacity gives the highest price of a configuration. The same table yields a
configuration of (nearly) that price for each length still uncovered; it is taken a whole number of times, at most the supply,
so the solution is rounded down as it grows. Weights of what is covered fall. Each round's prices are a solution of the dual
program, and the best of them bounds the number of sequences from below. The little that is left is packed best-fit
decreasing; if best fit alone needs fewer sequences, its packing is kept. The histogram has at most `capacity` entries, so
this part is the same size for any corpus; only assigning pieces to places is distributed.
"""

from __future__ import annotations

import bisect
import gc
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import cut, documents_of, fresh_worker, gapless_rank, prepare

#: A task's memory for the ids of words, in bytes; it is given back when the task ends.
CACHE = 200_000_000
PUNCTUATION = ".,;:!?"
#: A byte-level vocabulary writes each byte as one character, those that can't be seen as the characters from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {**{b: chr(b) for b in _SEEN}, **{b: chr(256 + k) for k, b in enumerate(sorted({*range(256)}.difference(_SEEN)))}}
#: Small Latin letters beyond ASCII as such a vocabulary writes them; normalising changes none of them.
_LATIN = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(128, 0x250) if chr(c).isalpha() and chr(c) == chr(c).lower()}


# ---- tokens -----------------------------------------------------------------------------------


class Recent(dict):
    """Values by word in two generations: when the young one is full it becomes the old one, from which words that come again are taken back."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.size, self.old = limit // 2, 0, {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """Words without a value. Room is made here and nowhere else, so what is in afterwards stays until the next call."""
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        out = [w for w in words if w not in self]
        if self.old:
            old = self.old
            again = [w for w in out if w in old]
            self.fill(again, [old[w] for w in again])
            out = [w for w in out if w not in old]
        return out

    def fill(self, words: list[str], values: list[bytes]) -> None:
        self.update(zip(words, values))
        self.size += 210 * len(words) + sum(map(len, values))


class Words(dict):
    """Numbers of white-space separated words, and the ids of each in one array; all are forgotten when they take about half of `cache` bytes.

    The tokenizer's pattern cuts letters from punctuation, so `word,` is `word` and `,`. Such parts are remembered apart from words, in the other half.
    """

    def __init__(self, tokenizer: str, end: int, cache: int) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder, self.end, self.limit, self.parts = Tokenizer.from_file(tokenizer), end, cache // 2, Recent(cache // 2)
        suffix = getattr(self.encoder.model, "end_of_word_suffix", None)
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a match of the pattern
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        probe = ["stone", "été", "ñandúœ"]
        self.byte_level = self.encoded(probe) == self.small(probe)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[None] = 0  # the end of a document
        self.new: list[str] = []
        self.ids, self.starts = array("I", [self.end]), array("q", [0, 1])

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of each, a word in one call."""
        return [array("I", e.ids).tobytes() for e in self.encoder.encode_batch_fast(parts, add_special_tokens=False)]

    def small(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of small Latin letters, which pass the normaliser and the pattern as they are."""
        tokenize = self.encoder.model.tokenize
        return [array("I", [t.id for t in tokenize(x if x.isascii() else x.translate(_LATIN))]).tobytes() for x in parts]

    def joined(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one match of the pattern each: encoded as one text, which is cut where a match ends. Should there be more matches, one by one."""
        ids = np.array(self.encoder.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(parts):
            return self.encoded(parts)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self) -> None:
        """Ids of the new words."""
        new, parts = self.new, self.parts
        bases = [w.rstrip(PUNCTUATION) for w in new]
        bases = [(x.lower() if x.isascii() else x) if x.isalpha() else w for x, w in zip(bases, new)]
        tails = [w[len(b) :] for w, b in zip(new, bases)]
        unknown = parts.missing({*bases, *tails})
        small, one, many = [], [], []
        for x in unknown:
            if not x.isalpha():
                (many if x.strip(PUNCTUATION) else one if x else small).append(x)
            else:
                (small if self.byte_level and x == x.lower() and (x.isascii() or max(x) < "\u0250") else one).append(x)
        for some, ids_of in ((small, self.small), (one, self.joined), (many, self.encoded)):
            for k in range(0, len(some), 20_000):
                parts.fill(some[k : k + 20_000], ids_of(some[k : k + 20_000]))
        values = [parts[b] + parts[t] if t else parts[b] for b, t in zip(bases, tails)]
        self.ids.frombytes(b"".join(values))
        self.starts.extend((self.starts[-1] + np.cumsum([len(v) // 4 for v in values], dtype=np.int64)).tolist())
        self.new = []

    def documents(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text and the end, as bytes."""
        if 210 * len(self) + 4 * len(self.ids) > self.limit:
            self.forget()
        # These four are white space to the tokenizer's normaliser, and no token crosses white space.
        numbers = [array("q", map(self.__getitem__, [*t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), None])) for t in texts]
        if not numbers:
            return []
        self.learn()
        word, starts = np.concatenate([np.frombuffer(x, np.int64) for x in numbers]), np.frombuffer(self.starts, np.int64)
        first = starts[word]
        size = starts[word + 1] - first
        after = np.cumsum(size)
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(first - after + size, size) + np.arange(after[-1])].astype("<u4").tobytes()
        ends = (4 * after[np.cumsum([len(x) for x in numbers]) - 1]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _pieces(tokenizer: str, capacity: int, end: int, keep_ids: bool, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        fresh_worker()
        gc.disable()  # the memory of words holds no cycles, and walking it costs more than the work
        try:
            yield from pieces(Words(tokenizer, end, cache), batches)
        finally:
            fresh_worker()

    def pieces(words: Words, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 4 * capacity
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for doc, ids in zip(batch["doc_id"].to_pylist(), words.documents(t.as_py() for t in batch["text"])):
                for p, at in enumerate(range(0, len(ids), wide)):
                    piece = ids[at : at + wide]
                    out["doc_id"].append(doc)
                    out["piece"].append(p)
                    out["start"].append(at // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["ids"].append(np.frombuffer(piece, "<u4").astype(np.int32) if keep_ids else None)
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.record_batch({k: pa.array(out[k], t) for k, t in kinds.items()})

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless keep_ids): each document's ids and then `end`, cut only beyond capacity."""
    prepare(docs.sparkSession)
    return documents_of(docs).mapInArrow(_pieces(tokenizer, capacity, end, keep_ids, cache), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


# ---- the program ------------------------------------------------------------------------------


def _prices(size: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The highest price that fits in each capacity (an unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(int(size[0]), capacity + 1):
        m = fits[c]
        best[c] = max(best[c - 1], (price[:m] + best[c - size[:m]]).max())
    return best


def _configuration(first: int, size: np.ndarray, price: np.ndarray, best: np.ndarray, left: np.ndarray, capacity: int, slack: float) -> dict[int, int] | None:
    """A configuration with `first` in it, whose price is the highest but for `slack`; of lengths that serve, the largest that is left."""
    used = {first: 1}
    left[first] -= 1
    c = capacity - int(size[first])
    slack -= best[capacity] - price[first] - best[c]
    while slack >= 0 and best[c] > 0:
        m = int(np.searchsorted(size, c, side="right"))
        loss = best[c] - price[:m] - best[c - size[:m]]
        serve = np.flatnonzero((loss <= slack) & (left[:m] > 0))
        if not len(serve):
            slack -= best[c]
            break
        i = int(serve[-1])
        slack -= max(float(loss[i]), 0.0)
        used[i] = used.get(i, 0) + 1
        left[i] -= 1
        c -= int(size[i])
    for i, n in used.items():
        left[i] += n
    return used if slack >= 0 else None


def _fill(used: dict[int, int], lengths: list[int], left: np.ndarray, capacity: int) -> int:
    """Put the largest remaining lengths into what is free; returns the free tokens."""
    free = capacity - sum(lengths[i] * n for i, n in used.items())
    i = bisect.bisect_right(lengths, free) - 1
    while free > 0 and i >= 0:
        more = min(free // lengths[i], int(left[i]) - used.get(i, 0))
        if more > 0:
            used[i] = used.get(i, 0) + more
            free -= more * lengths[i]
        i = min(i - 1, bisect.bisect_right(lengths, free) - 1)
    return free


def _best_fit(lengths: list[int], left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Largest first: a sequence takes the largest that still fit, and is repeated while the supply lasts. Empties `left`."""
    out = []
    i = len(lengths) - 1
    while i >= 0:
        if left[i] == 0:
            i -= 1
            continue
        used = {i: 1}
        _fill(used, lengths, left, capacity)
        times = min(int(left[j]) // n for j, n in used.items())
        for j, n in used.items():
            left[j] -= n * times
        out.append((used, times))
    return out


def pack_histogram(histogram: dict[int, int], capacity: int, rounds: int = 5, rate: float = 0.5, report: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """Configurations ({length: times}, sequences) that hold each length exactly as often as the histogram says.

    `report` receives sequences, bound (the best dual value, which no packing undercuts), share (of the tokens that lie in
    configurations of the program and not in the best-fit rest) and rounds.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    size, counts = np.array(lengths), np.array([histogram[x] for x in lengths], np.int64)
    tokens = int((size * counts).sum())
    left, weight = counts.copy(), np.ones(len(lengths))
    out, bound, taken, done = [], 0.0, 0, 0
    while done < rounds and left.any():
        # Any prices, over the highest price of a configuration, are a solution of the dual program.
        price = size * weight / capacity
        best = _prices(size, price, capacity)
        bound = max(bound, float((price * counts).sum() / best[capacity]))
        # Configurations within a slack of the highest price, longest lengths first, each as often as the supply lasts.
        slack = 1e-9 + (0.0, 0.0005, 0.002, 0.008)[min(done, 3)] * best[capacity]
        for i in range(len(lengths) - 1, -1, -1):
            while left[i] > 0 and (used := _configuration(i, size, price, best, left, capacity, slack)):
                times = min(int(left[j]) // n for j, n in used.items())
                for j, n in used.items():
                    left[j] -= n * times
                    taken += n * times * lengths[j]
                out.append((used, times))
        done += 1
        # What is covered loses weight, so that the next prices ask for what is left.
        weight *= np.exp(-rate * (1 - left / counts))
        if (size * left).sum() < max(capacity, tokens // 100):
            break
    out += _best_fit(lengths, left, capacity)
    greedy = _best_fit(lengths, counts.copy(), capacity)
    if sum(n for _, n in greedy) < sum(n for _, n in out):
        out, taken = greedy, 0
    if report is not None:
        report |= {"sequences": sum(n for _, n in out), "bound": bound, "share": taken / tokens, "rounds": done}
    return [({lengths[i]: n for i, n in used.items()}, times) for used, times in out]


def places(configurations: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, one past the last, first sequence, times in each, offset of the first): where the pieces of a length go."""
    at: dict[int, int] = {}
    sequence, runs = 0, []
    for used, times in configurations:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            first = at.get(length, 0)
            at[length] = first + n * times
            runs.append((length, first, at[length], sequence, n, offset))
            offset += n * length
        sequence += times
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = 4096, rounds: int = 5) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity).

    Sequences number from 0; offsets within one leave no gap. Rows of the same length are interchangeable; the histogram and
    the runs (at most a few for each configuration) are bounded by the capacity, whatever the corpus. Repeated rows are each
    placed. Empty table: no rows.
    """
    spark = prepare(pieces.sparkSession)
    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = places(pack_histogram(histogram, capacity, rounds))
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "length long, first long, last long, sequence long, times long, at long")
    ranked = gapless_rank(pieces, "length", ["doc_id", "piece", "_row"], "_rank", sum(histogram.values()))
    # Runs of a length follow each other: the run of a rank is the last one that starts at or before it.
    by_length = F.broadcast(table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "sequence", "times", "at"))).alias("_runs")))
    put = ranked.join(by_length, "length").withColumn("_r", _last_run(F.col("_runs"), F.col("_rank")))
    off = F.col("_rank") - F.col("_r.first")
    return put.select(*[c for c in pieces.columns if c != "_row"], (F.col("_r.sequence") + F.floor(off / F.col("_r.times"))).cast("long").alias("sequence_id"), (F.col("_r.at") + F.pmod(off, F.col("_r.times")) * F.col("length")).cast("long").alias("offset"))


def _last_run(runs, rank):
    return F.element_at(F.filter(runs, lambda r: r["first"] <= rank), -1)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, keep_ids: bool = False, rounds: int = 5, cache: int = CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids), sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Only documents over capacity are cut. Repeated rows are each packed;
    an empty table gives no rows; other columns are ignored. `cache` is how many bytes a task spends on remembered words, and changes no result.
    """
    packed = pack_pieces(token_pieces(docs, tokenizer, capacity, end, keep_ids, cache), capacity, rounds)
    return packed if keep_ids else packed.drop("ids")
