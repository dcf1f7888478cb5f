"""Op 4: SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

No piece of the model crosses from a letter to a mark, so a text is encoded word by word, a word being its run of marks and what follows.
The distinct words of a batch are sorted; going through them in order is a depth-first walk of their trie, and the forward
state of a common prefix (for each end position: the best last piece and its score) stays on the stack and is used again.

A unigram model's state is the Viterbi score. A BPE model's scores are merge ranks, which don't add up: the segmentation of
highest total isn't the one that the model defines. There the state is the last piece of the prefix's encoding, which is the
one piece that ends at the position and whose boundary with the encoding before it no merge would have crossed. Both give the
library's ids exactly. Words that start with several marks have pieces of equal rank and are merged directly.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterfold.llm.common import documents_of, fresh_worker, prepare, worker_store

MARK = "▁"
#: Distinct words whose ids a worker remembers, and pairs of pieces.
CACHE = 400_000
_MARKED = re.compile(MARK + "+[^" + MARK + "]*")


def marked_words(text: str) -> list[str]:
    """The words whose concatenation is the marked text; an empty text has none."""
    return _MARKED.findall(MARK + text.replace(" ", MARK)) if text else []


class Model:
    """Pieces, scores and kinds of a model file with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model needs identity normalisation, a dummy prefix and byte fallback")
        self.unigram = proto.trainer_spec.model_type == 1
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        bytes_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.bytes = [bytes_of[f"<0x{b:02X}>"] for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses from a letter to a mark")
        self.longest = max(map(len, self.ids))
        # Lengths of the pieces that end in two given characters, the longest first: most endings have few.
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items()}
        self.least = min(self.scores.values()) - 10
        self.table = [p.piece.encode() if p.type == 1 else bytes([self.bytes.index(i)]) if p.type == 6 else b"" for i, p in enumerate(proto.pieces)]
        self._raw: dict[str, bytes] = {}
        self._splits: dict[str, tuple[str, str] | None] = {}
        self._meets: dict[tuple[str, str], bool] = {}

    # -- one word at a time, directly

    def merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE by its definition: the pair of the highest score, leftmost first, until none is a piece; and the last pair merged."""
        left, right, symbol = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1)), list(word)
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and right[i] < len(word) and (s := self.scores.get(both := symbol[i] + symbol[right[i]])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(len(word) - 1):
            offer(i)
        last = None
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if symbol[i] else len(word)
            if j >= len(word) or symbol[i] + symbol[j] != both:
                continue
            last = symbol[i], symbol[j]
            symbol[i], symbol[j], right[i] = both, "", right[j]
            if right[i] < len(word):
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbol if s], last

    # -- which pieces may stand side by side

    def split(self, piece: str) -> tuple[str, str] | None:
        """The pair whose merge makes a piece of several characters; None if merging its characters doesn't give the piece."""
        if piece not in self._splits:
            got, last = self.merge(piece)
            self._splits[piece] = last if len(got) == 1 else None
        return self._splits[piece]

    def meets(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b keeps the boundary: undo merges from the latest on and look at the pair across."""
        known = self._meets.get((a, b))
        if known is None:
            if len(self._meets) > CACHE:
                self._meets.clear()
            known = self._meets[a, b] = self._boundary(a, b)
        return known

    def _boundary(self, a: str, b: str) -> bool:
        latest, ties = math.inf, True
        while True:
            across = self.scores.get(a + b)
            if across is not None and (-across < latest or ties and -across == latest):
                return False
            ranks = [-self.scores[p] if len(p) > 1 else -math.inf for p in (a, b)]
            if ranks[0] == ranks[1] == -math.inf:
                return True
            # Of equal ranks the left one is merged first, so the right one is undone first; a pair of its rank across would have come before.
            if ranks[0] > ranks[1]:
                latest, ties, a = ranks[0], False, self.split(a)[1]
            else:
                latest, ties, b = ranks[1], True, self.split(b)[0]

    # -- the walk

    def encode_sorted(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each word; words are sorted and distinct."""
        score, last = [0.0], [""]
        before = ""
        extend = self._viterbi if self.unigram else self._merged
        for word in words:
            if not self.unigram and word[1:2] == MARK:
                yield self.merge(word)[0]
                continue
            k = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                k += 1
            del score[k + 1 :], last[k + 1 :]
            before = word
            for end in range(k + 1, len(word) + 1):
                extend(word, end, score, last)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            yield pieces[::-1]

    def _viterbi(self, word: str, end: int, score: list[float], last: list[str]) -> None:
        best, piece = -math.inf, word[end - 1]
        for n in (*self.lengths.get(word[end - 2 : end] if end > 1 else "", ()), 1):
            if n <= end:
                part = word[end - n : end]
                s = self.scores.get(part, self.least if n == 1 else None)
                if s is not None and score[end - n] + s > best:
                    best, piece = score[end - n] + s, part
        score.append(best)
        last.append(piece)

    def _merged(self, word: str, end: int, score: list[float], last: list[str]) -> None:
        if end > 1:
            scores, meets = self.scores, self._meets
            for n in self.lengths.get(word[end - 2 : end], ()):
                if n > end:
                    continue
                part = word[end - n : end]
                if part not in scores or self._splits.get(part, 0) is None:
                    continue
                if n == end:
                    ok = self.split(part) is not None
                else:
                    ok = meets.get((last[end - n], part))
                    if ok is None:
                        ok = self.split(part) is not None and self.meets(last[end - n], part)
                if ok:
                    score.append(0.0)
                    last.append(part)
                    return
        score.append(0.0)
        last.append(word[end - 1])

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def raw_ids(self, piece: str) -> bytes:
        out = self._raw.get(piece)
        if out is None:
            out = np.array(self.piece_ids(piece), "<u4").tobytes()
            if piece in self.ids:
                self._raw[piece] = out
        return out

    def decode(self, ids: list[int]) -> str:
        """Marks become spaces, the first one goes; control pieces have no text; broken byte sequences become U+FFFD."""
        text = b"".join([self.table[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def encode_batch(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if len(known) > CACHE:
            known.clear()
        split = [marked_words(t) for t in texts]
        new = sorted({w for words in split for w in words if w not in known})
        for word, pieces in zip(new, self.encode_sorted(new)):
            known[word] = b"".join(map(self.raw_ids, pieces))
        return [b"".join([known[w] for w in words]) for words in split]


def _encode(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(keep="sentencepiece")
        gc.freeze()
        gc.disable()  # the caches hold no cycles, and walking them costs more than the work
        store = worker_store("sentencepiece")
        if path not in store:
            store[path] = Model(path), {}
        model, known = store[path]
        for batch in batches:
            texts = batch["text"].to_pylist()
            raw = model.encode_batch(texts, known)
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in raw]
            back = [model.decode(x.tolist()) for x in ids]
            yield pa.record_batch({
                "doc_id": batch["doc_id"],
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                "decoded_crc32": pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                "round_trip": pa.array([a == b.replace(MARK, " ") for a, b in zip(back, texts)], pa.bool_()),
                "ids": pa.array(ids if keep_ids else [None] * len(ids), pa.list_(pa.int32())),
            })

    return run


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_crc32, round_trip, (ids): every whole text encoded and decoded.

    Null and empty texts have no ids. A mark in a text is the same as a space, as in the library. Each row is encoded by
    itself, so repeated rows repeat; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    out = documents_of(docs).mapInArrow(_encode(model, keep_ids), "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids array<int>")
    return out if keep_ids else out.drop("ids")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array([model.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())})

    return run


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text."""
    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")
