"""Op 6: document quality by histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, one row a document. Trees are complete and of one depth, grown level by level over quantile
bins with the logistic loss, on a bounded sample of labelled rows. They are flattened into three arrays (feature, threshold,
leaf) that numpy walks for a whole batch of documents at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import cut, documents_of, fresh_worker, prepare

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, L2 = 64, 4, 80, 0.15, 1.0

FEATURES = ["log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "lower", "digit", "space", "symbol", "stops", "commas", "high_bytes", "odd_marks", "caps_start", "distinct", "top_word", "top_pair", "repeats", "log_lines", "mean_line", "same_lines", "word_deviation", "symbol_words", "bare_words", "char_entropy"]

_KIND = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".!?", 6), (b",;:", 7)):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8
_KIND[[c for c in range(33, 127) if not _KIND[c]]] = 5
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|<>{}[]@^~_=+\\")] = True


def statistics(text: str) -> list[float]:
    """The values of FEATURES; all 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=count, minlength=9) / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, n)
    tops = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    share = count[count > 0] / len(raw)
    last = Counter(w[-1] for w in words)
    first = Counter(w[0] for w in words)
    pairs = Counter(zip(words, words[1:]))
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), float(sizes.mean()), float((sizes > 14).mean()), float((sizes < 3).mean()), *(float(kind[k]) for k in (1, 2, 3, 4, 5, 6, 7, 8)),
        float(count[_MARKS].sum() / len(raw)), sum(v for c, v in first.items() if 65 <= c <= 90) / n, len(tops) / n, max(tops.values()) / n, max(pairs.values(), default=0) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n, float(np.log1p(len(lines))), float(np.log1p(len(raw) / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), float(sizes.std()),
        sum(v for c, v in last.items() if _MARKS[c] or c == 33) / n, sum(v for c, v in last.items() if 97 <= c <= 122 or c >= 128) / n, float(-(share * np.log(share)).sum()),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker()
    for batch in batches:
        rows = [np.asarray(statistics(t.as_py()), np.float64) for t in batch["text"]]
        yield pa.record_batch({"doc_id": batch["doc_id"], "x": pa.array(rows, pa.list_(pa.float64()))})


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Flattened trees: feature and threshold (trees x inner nodes), leaf (trees x leaves), base. One class alone: the base only."""
    inner = (1 << DEPTH) - 1
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return {"feature": np.zeros((0, inner), np.int64), "threshold": np.zeros((0, inner)), "leaf": np.zeros((0, inner + 1)), "base": base}
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(d) * BINS
    score = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            at = (flat + (node - first)[:, None] * (d * BINS)).ravel()
            gs = np.bincount(at, np.repeat(g, d), width * d * BINS).reshape(width, d, BINS).cumsum(2)
            hs = np.bincount(at, np.repeat(h, d), width * d * BINS).reshape(width, d, BINS).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            right = np.zeros(len(y), bool)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
                    mine = node == first + k
                    right[mine] = binned[mine, j] > b
            node = 2 * node + 1 + right
        at = node - inner
        leaf = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        score = score + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return {"feature": np.stack(features), "threshold": np.stack(thresholds), "leaf": np.stack(leaves), "base": base}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities; all rows go down a tree together."""
    score = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        score += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-score))


def _scores(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch["x"].flatten()).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(FEATURES)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(predict(model, x), pa.float64())})

    return run


def sampled(rows: DataFrame, limit: int) -> DataFrame:
    """At most about `limit` rows, those with the smallest hash of doc_id, so that the same rows are drawn wherever they are stored."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(0.95 * limit / n * (1 << 30)))


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learned from labels of rows that aren't held out.

    Only the statistics of the text enter a score. Null and empty texts get the score of all-zero statistics. Labels that are
    null, or of documents that aren't there, teach nothing, of labels that repeat a doc_id the greatest counts; repeated rows are each scored; without labels, or with one class,
    all scores are one number. Empty table: no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    table = cut(documents_of(docs).mapInArrow(_statistics, "doc_id long, x array<double>"))
    marks = labels.select("doc_id", F.col(target).cast("int").alias("y")).filter("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = sampled(marks.filter(~is_held_out(F.col("doc_id"))), sample)
    known = table.join(drawn, "doc_id").orderBy("doc_id").collect()
    model = fit(np.array([r["x"] for r in known]).reshape(len(known), len(FEATURES)), np.array([r["y"] > 0 for r in known], float))
    scored = table.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
