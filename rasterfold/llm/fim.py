"""Op 13: fill-in-middle by an index of exceptions: only characters of several bytes are written down.

For a batch of texts in UTF-8 the index holds, for each character of several bytes, its place in characters and the bytes in
excess of one up to it. A character cut becomes a byte cut by one search in the index: place plus excess before it. Runs of
ASCII have no entry and stay arithmetic; no text is decoded. Cuts follow from the document's id alone, so a row lost with its
executor comes out the same again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import prepare, text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts are indexed together until they hold so many bytes (a longer one by itself).
SPAN = 4_000_000


class Exceptions:
    """The index of some UTF-8 bytes: characters of several bytes, in order."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.before = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        self.chars = self.at - self.before[:-1]

    def char_of(self, byte: np.ndarray) -> np.ndarray:
        """How many characters lie before a byte that begins one."""
        return byte - self.before[np.searchsorted(self.at, byte)]

    def byte_of(self, char: np.ndarray) -> np.ndarray:
        """At which byte the character of this number begins."""
        return char + self.before[np.searchsorted(self.chars, char)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins (with one more entry for the end)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def join_parts(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text from an output and its form; parts hold no mark, so the first marks found are those that were put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    turn = output.index(second, len(first))
    last = output.index(MIDDLE, turn + len(second))
    one, two, middle = output[len(first) : turn], output[turn + len(second) : last], output[last + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def _transform(rate: int, spm: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch["text"])
            draw = [batch[h].to_numpy() for h in ("h1", "h2", "h3", "h4")]
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SPAN, "right")) - 1)
                part = slice(lo, hi)
                yield _rows(batch["doc_id"][lo:hi], data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], [h[part] for h in draw], rate, spm, keep)
                lo = hi

    return run


def _rows(ids: pa.Array, data: np.ndarray, starts: np.ndarray, draw: list[np.ndarray], rate: int, spm: int, keep: bool) -> pa.RecordBatch:
    index = Exceptions(data)
    chars = index.char_of(starts)
    n = np.diff(chars)
    cuts = np.sort(np.stack([draw[0] % (n + 1), draw[1] % (n + 1)]), axis=0)
    at = index.byte_of(chars[:-1] + cuts)
    raw = data.tobytes()
    forms, outputs, back = [], [], []
    for k, (a, b, c, d) in enumerate(zip(starts[:-1].tolist(), at[0].tolist(), at[1].tolist(), starts[1:].tolist())):
        text = raw[a:d]
        if not text or draw[2][k] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
            form, out = "plain", text
        else:
            form = "spm" if draw[3][k] % 100 < spm else "psm"
            out = join_parts(form, raw[a:b], raw[b:c], raw[c:d])
        forms.append(form)
        outputs.append(out)
        back.append(hashlib.sha256(restore(out, form)).hexdigest())
    plain = np.array([f == "plain" for f in forms])
    columns = {
        "doc_id": ids,
        "n": pa.array(n, pa.int64()),
        "form": pa.array(forms, pa.string()),
        "prefix_chars": pa.array(cuts[0], pa.int64(), mask=plain),
        "middle_chars": pa.array(cuts[1] - cuts[0], pa.int64(), mask=plain),
        "output_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in outputs], pa.string()),
        "restored_sha256": pa.array(back, pa.string()),
    }
    if keep:
        columns["output"] = pa.array(outputs, pa.binary()).cast(pa.string())
    return pa.record_batch(columns)


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, keep_output: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, (output): each whole text rearranged, and put back from its output.

    `rate` percent of the documents are rearranged, `spm` percent of those with the suffix first; the draws are the first
    four groups of the SHA-256 of seed:doc_id. A null text counts as empty and stays plain, as does a text that holds one of the marks.
    A null doc_id draws as an empty one. Rows are handled one by one: equal rows give equal rows, an empty table none; other columns are ignored.
    """
    prepare(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", text_of().alias("text"), digest.alias("digest")).select("doc_id", "text", *draws)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return rows.mapInArrow(_transform(rate, spm, keep_output), schema + (", output string" if keep_output else ""))
