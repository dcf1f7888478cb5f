"""Op 8: toxicity categories by a classifier chain of linear models.

Categories are predicted one after the other; the probabilities that earlier models give are inputs of the later ones. While
the later ones are trained, those inputs are out-of-fold: each training row's come from models that haven't seen it, over inputs
chosen without it. Each model is fitted in a task of its own, from the marks that the sample's documents have among the
chosen ones; the driver gets weights only. The other inputs are marks of presence for words and word beginnings, all those whose association with a
category, for or against it, in a bounded sample of labelled documents is beyond chance; a beginning has a mark for each of LEVELS, if so many distinct words of the text start with it. Scoring
looks each distinct word of a whole text up once; the words that begin alike are counted for a batch of texts at once.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import cut, documents_of, fresh_worker, prepare
from rasterfold.llm.quality import sampled

#: Labelled documents that a chain is fitted on, at most.
SAMPLE = 15_000
#: Chi-square (one degree of freedom) of a mark and a category from which the mark is an input: by chance in one of a hundred thousand marks.
LEAST = 20.0
FOLDS, ROUNDS, L2 = 4, 250, 2e-4
STARTS, LEVELS = (3, 4, 5, 6, 7), (1, 2, 3, 5)
#: Entries that a product takes at once, so that its parts stay in the processor's cache.
BLOCK = 1 << 18
#: A scoring task forgets its words when it knows so many.
KNOWN_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")
_ASCII = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))


def distinct_words(text: str) -> set[str]:
    text = text.lower()
    return set(text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text))


def word_input(word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"={word}") >> 1


def start_input(start: str, level: int) -> int:
    return xxhash.xxh3_64_intdigest(f"^{start} {level}") >> 1


def starts_of(word: str) -> list[str]:
    return [word[:k] for k in STARTS if len(word) > k]


def text_inputs(text: str) -> list[int]:
    words = distinct_words(text)
    starts = Counter(p for w in words for p in starts_of(w))
    return [*map(word_input, words), *(start_input(p, k) for p, n in starts.items() for k in LEVELS if n >= k)]


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker()
    for batch in batches:
        rows = [text_inputs(t.as_py()) for t in batch["text"]]
        yield pa.record_batch({"doc_id": batch["doc_id"], "inputs": pa.array(rows, pa.list_(pa.int64()))})


def _chosen(chosen: list[int]):
    """Positions in `chosen` of a row's inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {h: i for i, h in enumerate(chosen)}
        for batch in batches:
            cols = [sorted(place[h] for h in row if h in place) for row in batch["inputs"].to_pylist()]
            yield pa.record_batch({n: batch[n] for n in batch.schema.names if n != "inputs"} | {"cols": pa.array(cols, pa.list_(pa.int32()))})

    return run


# ---- the chain --------------------------------------------------------------------------------


class Sums:
    """Sums over the entries of a sparse 0/1 matrix that are in the same line: for each line, of the values at its places, which are as many as `size` says."""

    def __init__(self, size: np.ndarray, places: np.ndarray) -> None:
        self.n, self.places, self.parts = len(size), places, []
        starts = np.concatenate([[0], np.cumsum(size)])
        full = np.flatnonzero(np.diff(starts))
        first, end = starts[full], len(places)
        k = 0
        while k < len(full):
            j = max(k + 1, int(np.searchsorted(first, first[k] + BLOCK)))
            self.parts.append((int(first[k]), int(first[j]) if j < len(full) else end, first[k:j] - first[k], full[k:j]))
            k = j

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for a, b, starts, lines in self.parts:
            out[lines] = np.add.reduceat(values[self.places[a:b]], starts)
        return out


def fit_linear(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Logistic regression on a sparse 0/1 matrix (rows, which ascend, cols) beside dense columns; weights: width, then extra's, then the bias."""
    n, m = len(y), extra.shape[1]
    by_row = Sums(np.bincount(rows, minlength=n), cols)
    size = np.bincount(cols, minlength=width)
    by_col = Sums(size, rows[np.argsort(cols, kind="stable")])
    del rows
    w = np.zeros(width + m + 1)
    p = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(p / (1 - p))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        z = by_row.of(w) + extra @ w[width:-1] + w[-1]
        d = 1 / (1 + np.exp(-z)) - y
        g = np.concatenate([by_col.of(d), extra.T @ d, [d.sum()]]) / n
        g[:-1] += L2 * w[:-1] / 10
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w


def probability(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, n: int, width: int) -> np.ndarray:
    return 1 / (1 + np.exp(-(np.bincount(rows, w[cols], n) + extra @ w[width:-1] + w[-1])))


def fit_model(f: int, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, folds: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of one category from the rows outside fold f, and the probabilities of those within; FOLDS is a fold without rows.

    Only the inputs that allowed[f] marks get weights.
    """
    width = allowed.shape[1]
    inside = folds != f
    out = ~inside
    keep = out[rows]
    own = (np.cumsum(out) - 1)[rows[keep]], cols[keep]
    keep = ~keep & allowed[f][cols]
    if not keep.all():
        rows, cols = (np.cumsum(inside, dtype=np.int32) - np.int32(1))[rows[keep]], cols[keep]
    w = fit_linear(rows, cols, extra[inside], y[inside], width)
    return w, probability(w, *own, extra[out], int(out.sum()), width)


def fit_chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, folds: np.ndarray, allowed: np.ndarray) -> list[np.ndarray]:
    """A weight vector for each column of labels, in order; the k-th has k extra inputs, the earlier probabilities.

    allowed[f] marks the inputs chosen without fold f, allowed[FOLDS] those of the model itself. `fitted` does the same in tasks.
    """
    extra, weights = np.zeros((len(labels), 0)), []
    for y in labels.T:
        weights.append(fit_model(FOLDS, rows, cols, extra, y, folds, allowed)[0])
        out = np.zeros(len(labels))
        for f in range(FOLDS):
            out[folds == f] = fit_model(f, rows, cols, extra, y, folds, allowed)[1]
        extra = np.column_stack([extra, out])
    return weights


def _fit(f: int, category: int, earlier: list[str], allowed: np.ndarray):
    """One model of one category, from all the sample's rows: its weights in one row, and a row for each document of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        parts, narrow = [], []
        for batch in batches:
            # Only what this model may use is held, in 32 bits.
            cols = batch["cols"].flatten().to_numpy()
            keep = allowed[f][cols]
            size = np.bincount(np.repeat(np.arange(len(batch)), batch["cols"].value_lengths())[keep], minlength=len(batch))
            parts.append(cols[keep].astype(np.int32))
            narrow.append(batch.drop_columns("cols").append_column("size", pa.array(size, pa.int64())))
        small = pa.Table.from_batches(narrow) if narrow else None
        if small is None or not small.num_rows:
            return
        size, doc = small["size"].to_numpy(), small["doc_id"].to_numpy()
        # Sums depend on the order of rows in their last digits.
        order = np.argsort(doc)
        starts = np.cumsum(size) - size
        cols = np.concatenate(parts)
        del parts
        cols = np.concatenate([cols[starts[i] : starts[i] + size[i]] for i in order])
        rows = np.repeat(np.arange(len(doc), dtype=np.int32), size[order])
        column = lambda name: small[name].to_numpy()[order]
        extra = np.column_stack([np.zeros((len(doc), 0)), *[column(e) for e in earlier]])
        w, p = fit_model(f, rows, cols, extra, (column(f"y{category}") > 0).astype(float), column("fold"), allowed)
        own = doc[order][column("fold") == f]
        yield pa.record_batch({"model": pa.array([f], pa.int32()), "doc_id": pa.array([None], pa.int64()), "p": pa.array([None], pa.float64()), "weights": pa.array([w], pa.list_(pa.float64()))})
        yield pa.record_batch({"model": pa.array([f] * len(own), pa.int32()), "doc_id": pa.array(own), "p": pa.array(p), "weights": pa.array([None] * len(own), pa.list_(pa.float64()))})

    return run


def fitted(small: DataFrame, categories: int, allowed: np.ndarray) -> list[np.ndarray]:
    """The weights of a chain, as fit_chain's; a task for each model. `small`: doc_id, fold, y0, y1, ..., cols (positions of inputs); bounded by the sample.

    No weights if there are no rows. The last category's probabilities are no inputs, so it has one model.
    """
    weights, earlier = [], []
    for c in range(categories):
        models = range(FOLDS + 1) if c < categories - 1 else [FOLDS]
        # A task reads all rows of the sample by itself: nothing is dealt out, and two models share no task.
        out = cut(reduce(DataFrame.unionAll, [small.coalesce(1).mapInArrow(_fit(f, c, earlier, allowed), "model int, doc_id long, p double, weights array<double>") for f in models]))
        weights += [np.array(r["weights"]) for r in out.filter(f"model = {FOLDS} and doc_id is null").select("weights").collect()]
        if c < categories - 1:
            small = small.join(F.broadcast(out.filter("doc_id is not null").select("doc_id", F.col("p").alias(f"p{c}"))), "doc_id")
            earlier = [*earlier, f"p{c}"]
    return weights


def chain_scores(weights: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, n: int, width: int) -> np.ndarray:
    extra = np.zeros((n, 0))
    for w in weights:
        extra = np.column_stack([extra, probability(w, rows, cols, extra, n, width)])
    return extra


class Marks(dict):
    """Words that a task has seen, numbered, with the place among the chosen inputs of each and of its beginnings' marks."""

    def __init__(self, chosen: list[int]) -> None:
        super().__init__()
        self.place = {h: i for i, h in enumerate(chosen)}
        # Beginnings with a chosen mark are numbered too, and never forgotten: there are at most as many as inputs.
        self.starts: dict[str, int] = {}
        self.levels: list[list[int]] = []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.none: set[str] = set()  # beginnings without a chosen mark
        self.own, self.first, self.begins = array("i"), array("q", [0]), array("i")

    def __missing__(self, word: str) -> int:
        self.own.append(self.place.get(word_input(word), -1))
        for p in starts_of(word):
            if p in self.none:
                continue
            at = self.starts.get(p)
            if at is None:
                found = [self.place.get(start_input(p, k), -1) for k in LEVELS]
                if max(found) < 0:
                    self.none.add(p)
                    continue
                at = self.starts[p] = len(self.levels)
                self.levels.append(found)
            self.begins.append(at)
        self.first.append(len(self.begins))
        number = self[word] = len(self)
        return number

    def inputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and input of each mark that the texts have."""
        if len(self) > KNOWN_WORDS:
            self.forget()
        numbers = [array("q", map(self.__getitem__, distinct_words(t))) for t in texts]
        word = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in numbers if x]])
        text = np.repeat(np.arange(len(texts)), list(map(len, numbers)))
        own, first, begins = np.array(self.own, np.int64), np.array(self.first), np.array(self.begins, np.int64)
        at, many = first[word], first[word + 1] - first[word]
        # The beginnings of every word, one after another, and how many words of a text begin with each.
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = max(len(self.levels), 1)
        pair, n = np.unique(np.repeat(text, many) * size + begins[np.repeat(at, many) + step], return_counts=True)
        levels = np.array(self.levels or [[-1] * len(LEVELS)])
        rows, cols = [text[own[word] >= 0]], [own[word][own[word] >= 0]]
        for j, k in enumerate(LEVELS):
            place = levels[pair % size, j]
            hit = (n >= k) & (place >= 0)
            rows.append(pair[hit] // size)
            cols.append(place[hit])
        return np.concatenate(rows), np.concatenate(cols)


def _score(chosen: list[int], weights: list[np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        marks = Marks(chosen)
        for batch in batches:
            rows, cols = marks.inputs(batch["text"].to_pylist())
            p = chain_scores(weights, rows, cols, len(batch), len(chosen))
            yield pa.record_batch({"doc_id": batch["doc_id"], **{f"p_{c}": pa.array(p[:, k], pa.float64()) for k, c in enumerate(names)}})

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = 0.5, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """doc_id, p_<category> for each category in chain order, toxic (the last category's probability reaches the threshold).

    `labels` has doc_id and a 0/1 column for each category. Null labels count as 0, and of labels that repeat a doc_id the greatest
    counts; labels of absent documents teach nothing; without labels nothing is toxic. Inputs are the marks that two documents
    of the sample share and whose chi-square with a category reaches `least`; 0 takes them all. Null, empty and wordless texts have no inputs and get the bias
    alone. A text that repeats with the same labels counts once in the sample. Repeated rows are each scored; an empty table
    gives no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    docs = documents_of(docs)
    each = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories)])
    marks = sampled(each, sample)
    ys = [f"y{k}" for k in range(len(categories))]
    # The sample is bounded, so its labels may be broadcast: texts needn't move.
    # Copies teach a model nothing more, so a text counts once for each set of labels.
    known = docs.join(F.broadcast(marks), "doc_id").withColumn("copy", F.xxhash64("text", *ys))
    first = known.groupBy("copy").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    known = docs.join(F.broadcast(first), "doc_id").dropDuplicates(["doc_id"])
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = cut(known.select("doc_id", "text").mapInArrow(_inputs, "doc_id long, inputs array<long>").join(F.broadcast(marks), "doc_id").select("doc_id", "inputs", *ys, fold))

    # Sums over all rows (fold FOLDS) and over the rows outside of each fold.
    def sums(f: int) -> list[Column]:
        inside = F.lit(1) if f == FOLDS else (F.col("fold") != f).cast("int")
        return [F.sum(inside).alias(f"n{f}"), *[F.sum(F.col(y) * inside).alias(f"{y}_{f}") for y in ys]]

    totals = rows.agg(*[x for f in range(FOLDS + 1) for x in sums(f)]).first()
    counts = rows.select(F.explode("inputs").alias("input"), "fold", *ys).groupBy("input").agg(*[x for f in range(FOLDS + 1) for x in sums(f)]).filter(f"n{FOLDS} > 1")

    def association(y: str, f: int) -> Column:
        """Chi-square of a mark and a category: (observed - expected) squared over the variance."""
        total = max(totals[f"n{f}"] or 0, 1)
        p = min(max((totals[f"{y}_{f}"] or 0) / total, 1e-6), 1 - 1e-6)
        n = F.col(f"n{f}")
        return F.pow(F.col(f"{y}_{f}") - n * p, 2) / F.greatest(n * (1 - n / total) * p * (1 - p), F.lit(1e-9))

    # Bounded by the marks of the sample's documents.
    scores = cut(counts.select("input", *[f"n{f}" for f in range(FOLDS + 1)], *[F.greatest(*[association(y, f) for y in ys], F.lit(0.0)).alias(f"s{f}") for f in range(FOLDS + 1)]))
    lists = [[r["input"] for r in scores.filter((F.col(f"s{f}") >= least) & (F.col(f"n{f}") > 1)).select("input").collect()] for f in range(FOLDS + 1)]
    chosen = sorted(set().union(*lists))
    place = {h: i for i, h in enumerate(chosen)}
    allowed = np.zeros((FOLDS + 1, len(chosen)), bool)
    for f, own in enumerate(lists):
        allowed[f, [place[h] for h in own]] = True
    # Bounded: the sample's labels and, for each of its documents, its marks among the chosen ones.
    schema = ", ".join(["doc_id long", *[f"{y} int" for y in ys], "fold int", "cols array<int>"])
    # They lie in a few files, as each model's task reads them all.
    small = cut(rows.select("doc_id", *ys, "fold", "inputs").coalesce(8).mapInArrow(_chosen(chosen), schema))
    weights = fitted(small, len(categories), allowed) if chosen else []
    if not weights:
        weights = [np.concatenate([np.zeros(len(chosen) + k), [-8.0]]) for k in range(len(categories))]
    # Scoring needs the marks of the models themselves only.
    used = np.flatnonzero(allowed[FOLDS])
    weights = [np.concatenate([w[: len(chosen)][used], w[len(chosen) :]]) for w in weights]
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories)
    scored = docs.mapInArrow(_score([chosen[i] for i in used], weights, categories), schema)
    return scored.withColumn("toxic", F.col(f"p_{categories[-1]}") >= threshold)
