"""Op 11: byte-level BPE by replaying the merges over all distinct words at once.

The distinct words of the texts at hand lie in one array of symbols, first one a byte. An inverted index leads from a pair of
neighbours to the places where it stands; pairs that join to the same token share its rank and so an entry. Entries are taken in rank order:
all their places are merged at once, from the left where they overlap, and only the pairs to the left and right of a merge
are looked up again. A vocabulary may give a new pair a lower rank than the merge that made it; a word in which
that happens is merged by itself, one pair at a time. A word that is a token is that token, as in the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterfold.llm.common import documents_of, prepare

#: Texts are held back until they have so many bytes or so many new words; then their new words are merged together.
HELD_BYTES, HELD_WORDS = 16_000_000, 200_000
#: A task forgets its words when they take about so many bytes.
KNOWN_BYTES = 120_000_000
#: Texts over so many characters are cut into words little by little.
LONG = 1_000_000
NONE = np.iinfo(np.int32).max


class Ranks:
    """Tokens by rank, and the rank of each pair of tokens that joins to a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.size = max(self.ranks.values()) + 1
        self.table = [b""] * self.size
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, joined = array("q"), array("q"), array("i")
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        keys = np.frombuffer(left, np.int64) * self.size + np.frombuffer(right, np.int64)
        order = np.argsort(keys)
        self.pairs, self.joined = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.frombuffer(joined, np.int32)[order], NONE)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair joins to, or NONE."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], NONE)

    def alone(self, word: bytes) -> list[int]:
        """One word by definition: the pair of the lowest rank, leftmost first, until none joins."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], NONE), k) for k in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's begin (with one more entry for the end)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(size)])
        n = int(starts[-1])
        symbol = np.append(self.bytes[np.frombuffer(b"".join(words), np.uint8)], 0).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[starts[1:] - 1] = n  # n stands for no neighbour, on both sides
        before[starts[:-1]] = n
        alive = np.ones(n + 1, bool)
        joins = np.full(n + 1, NONE, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(after[:n] < n)
        joins[inner] = self.rank(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def enter(places: np.ndarray) -> None:
            rank = joins[places]
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            for r, a, b in zip(rank[first].tolist(), first.tolist(), [*first[1:].tolist(), len(rank)]):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(due, r)

        if (joins < NONE).any():
            enter(inner[joins[inner] < NONE])
        odd: list[np.ndarray] = []
        while due:
            rank = heapq.heappop(due)
            at = index.pop(rank)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[joins[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                fresh = np.concatenate([[True], at[1:] != after[at[:-1]]])
                if not fresh.all():  # a run of overlapping pairs: every second one, from its first
                    run = np.flatnonzero(fresh)
                    at = at[(np.arange(len(at)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            gone = after[at]
            far = after[gone]
            symbol[at] = rank
            alive[gone] = False
            joins[gone] = NONE
            after[at] = far
            before[far] = at
            before[n] = n
            touched = np.unique(np.concatenate([at, before[at]]))
            touched = touched[touched < n]
            joins[touched] = new = np.where(after[touched] < n, self.rank(symbol[touched], symbol[after[touched]]), NONE)
            if (new < rank).any():
                odd.append(touched[new < rank])
            if (new < NONE).any():
                enter(touched[new < NONE])
        ids, kept = symbol[:n][alive[:n]], np.concatenate([[0], np.cumsum(alive[:n])])[starts]
        if odd:
            ids, kept = self._mended(words, ids, kept, set((np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist()))
        return ids, kept

    def _mended(self, words: list[bytes], ids: np.ndarray, kept: np.ndarray, which: set[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(self.alone(w), np.int32) if k in which else ids[kept[k] : kept[k + 1]] for k, w in enumerate(words)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class Words(dict):
    """Words of a task and their numbers; a word not seen before gets the next number."""

    def __init__(self, ranks: Ranks) -> None:
        super().__init__()
        self.model = ranks
        self.decimals = [str(k) for k in range(ranks.size)]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.raw: list[bytes] = []
        self.text: list[str] = []
        self.bytes = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def learn(self) -> None:
        """Ids of the new words, as little-endian 32-bit numbers and as text."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.new]
        token = [self.model.ranks.get(w) for w in words]
        ids, starts = self.model.replay([w for w, t in zip(words, token) if t is None])
        ids, starts, k = ids.astype("<u4"), starts.tolist(), 0
        for t in token:
            if t is None:
                own = ids[starts[k] : starts[k + 1]]
                k += 1
                self.raw.append(own.tobytes())
                self.text.append(" ".join([self.decimals[i] for i in own.tolist()]))
            else:
                self.raw.append(t.to_bytes(4, "little"))
                self.text.append(self.decimals[t])
        self.bytes += sum(300 + 8 * len(w) for w in words)
        self.new = []


def _encode(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words = Words(Ranks(path))
        found = regex.compile(pattern)
        table = words.model.table

        def numbers(text: str) -> array:
            if len(text) <= LONG:
                return array("I", map(words.__getitem__, found.findall(text)))
            out, parts = array("I"), (m.group() for m in found.finditer(text))
            while some := array("I", map(words.__getitem__, islice(parts, 100_000))):
                out.extend(some)
            return out

        def done(held: list) -> pa.RecordBatch:
            words.learn()
            ids, said, back = [], [], []
            for _, own in held:
                raw = np.frombuffer(b"".join([words.raw[k] for k in own]), "<u4")
                ids.append(raw.astype(np.int32) if keep_ids else len(raw))
                said.append(hashlib.sha256(" ".join([words.text[k] for k in own]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(table.__getitem__, raw.tolist()))).hexdigest())
            columns = {
                "doc_id": pa.array([d for d, _ in held], pa.int64()),
                "n_tokens": pa.array(map(len, ids) if keep_ids else ids, pa.int64()),
                "ids_sha256": pa.array(said, pa.string()),
                "decoded_sha256": pa.array(back, pa.string()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            held.clear()
            if words.bytes > KNOWN_BYTES:
                words.forget()
            return pa.record_batch(columns)

        held: list[tuple[int | None, array]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                held.append((doc, numbers(text)))
                size += len(text)
                if size > HELD_BYTES or len(words.new) > HELD_WORDS:
                    yield done(held)
                    size = 0
        if held:
            yield done(held)

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the bytes that the ids stand for), (ids): every whole text.

    `ranks` is a tiktoken file; each match of `pattern` is encoded by itself, without special tokens. Null and empty texts have
    no ids. Rows are handled one by one: equal rows give equal rows, an empty table none, a null doc_id stays null; other columns are ignored.
    A task's memory is bounded by the texts held back, the words it knows and its longest text.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return documents_of(docs).mapInArrow(_encode(ranks, pattern, keep_ids), schema)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Ranks(path).table
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "bytes": pa.array([b"".join([table[i] for i in ids or []]) for ids in batch["ids"].to_pylist()], pa.binary())})

    return run


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and bytes from doc_id and ids; null ids give no bytes. Bytes, as ids cut out of a text may end within a character."""
    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(ranks), "doc_id long, bytes binary")
