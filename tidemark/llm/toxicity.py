"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into a table of embeddings; its vector is their mean, so unseen misspellings share
the vectors of the n-grams they keep. The vectors of all words of a document are averaged, and so are those of each WINDOW neighbouring words. A linear
softmax over the two classes takes both: the document's average, and the window that speaks most for the toxic class, so that a single insult in a
long text, which an average over all words drowns, counts as much as in a short one. In training the maximum over windows is softened at
first and sharpened step by step, and embeddings and softmax learn together from the documents' labels.

Training uses at most TRAIN_DOCS labelled documents of each class, those with the least hash of doc_id, as long as their texts have at most
TRAIN_CHARS characters together (the first is always taken); both bounds are parameters, and no text is cut. Of several labels of a document the highest
counts; null labels, and labels without a document, don't. Without labels of both classes every score is EMPTY_SCORE. Scoring covers every
whole text and word. A score depends on the text alone. Null and empty texts and texts without letters have the score EMPTY_SCORE. Repeated
rows each get their own row; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table
from tidemark.llm.shingles import mixed

BUCKETS, DIM, WINDOW, GRAMS = 1 << 16, 8, 3, (3, 4, 5)
TRAIN_DOCS, TRAIN_CHARS, STEPS, SEED = 1200, 8_000_000, 120, 11
#: Weight of the toxic class in training; under a half, so that clean documents are left alone.
TOXIC_SHARE = 0.3
FOLDS, HELD_OUT, EMPTY_SCORE = 5, 0, 0.0
#: Characters whose subwords are made at once, and of the longest run of characters whose margins are kept.
GRAM_CHARS, RUN_CHARS = 1 << 18, 64
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def _parts(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of up to GRAM_CHARS characters together, or of a single longer word."""
    first = total = 0
    for i, w in enumerate(words):
        if i > first and total + len(w) > GRAM_CHARS:
            yield first, i
            first, total = i, 0
        total += len(w) + 2
    yield first, len(words)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' subwords, the n-grams and the marked word itself, and the number of the word that each belongs to, ascending."""
    parts = [(a, _grams(words[a:b])) for a, b in _parts(words)]
    return np.concatenate([b for _, (b, _) in parts]), np.concatenate([o + a for a, (_, o) in parts])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w}>" for w in words]
    size = np.array([len(m) for m in marked])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    place = (np.arange(len(points)) - first[owner]).astype(np.uint64)
    found, owners = [np.add.reduceat(mixed(points + (place << np.uint64(32))), first)], [np.arange(len(words))]
    for n in GRAMS:
        if len(points) < n:
            continue
        h = points[: len(points) - n + 1]
        for i in range(1, n):
            h = mixed(h) + points[i : len(points) - n + 1 + i]
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append(mixed(h + np.uint64(n << 32))[inside])
        owners.append(owner[: len(h)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mixed(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int32)[order], owner[order].astype(np.int32)


def words_of(run: str) -> list[str]:
    """The words in a run of characters without white space."""
    return LETTERS.findall(run.lower())


def window_means(x: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Means over each width neighbours; over all if there are fewer."""
    width = min(width, len(x))
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[width:] - sums[:-width]) / width


class Model:
    """The embeddings times the difference of the two softmax columns, one number a bucket for the window and one for the whole text, and the bias: all that a score needs."""

    def __init__(self, bucket: np.ndarray, whole: np.ndarray, bias: float, trained: bool = True) -> None:
        self.bucket, self.whole, self.bias, self.trained = bucket.astype(np.float32), whole.astype(np.float32), float(bias), trained

    @property
    def parts(self) -> tuple:
        return self.bucket, self.whole, self.bias, self.trained

    def margins(self, words: list[str]) -> np.ndarray:
        """How much each word speaks for the toxic class, in a window (real part) and in the average of the text (imaginary part)."""
        out = np.zeros(len(words), np.complex128)
        for a, b in _parts(words) if words else ():
            flat, owner = grams(words[a:b])
            n = np.bincount(owner, None, b - a)
            out[a:b] = (np.bincount(owner, self.bucket[flat], b - a) + 1j * np.bincount(owner, self.whole[flat], b - a)) / n
        return out


class Scorer:
    """Scores of texts; the margins of recent short runs of characters without white space are kept."""

    def __init__(self, model: Model, bound: int = 400_000) -> None:
        self._model, self._bound, self._kept = model, bound, {}

    def scores(self, texts: list[str]) -> list[float]:
        runs = [t.split() for t in texts]
        if len(self._kept) > self._bound:
            self._kept.clear()
        kept = self._kept
        new = list({r for own in runs for r in own if r not in kept})
        words = [words_of(r) for r in new]
        margins, at = self._model.margins([w for own in words for w in own]).tolist(), 0
        for r, own in zip(new, words, strict=True):
            kept[r] = margins[at] if len(own) == 1 else tuple(margins[at : at + len(own)])
            at += len(own)
        out = [self._score(own) for own in runs]
        for r in new:  # so that the store is bounded in bytes
            if len(r) > RUN_CHARS:
                del kept[r]
        return out

    def _score(self, runs: list[str]) -> float:
        found = map(self._kept.__getitem__, runs)
        try:
            m = np.fromiter(found, np.complex128, len(runs))
        except (TypeError, ValueError):  # a run of several words, or of none
            m = np.array([x for r in map(self._kept.__getitem__, runs) for x in (r if isinstance(r, tuple) else (r,))], np.complex128)
        if not len(m) or not self._model.trained:
            return EMPTY_SCORE
        return float(1 / (1 + np.exp(-np.clip(window_means(m.real).max() + m.imag.mean() + self._model.bias, -50, 50))))


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """Fit embeddings and softmax to document labels by gradient steps over all documents at once."""
    y = np.array(labels, np.float64)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for r in t.split() for w in words_of(r)], np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in keep], y[keep]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, False)
    flat, owner = grams(list(vocabulary))
    size = np.bincount(owner, None, len(vocabulary))
    del owner
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.concatenate(docs)
    n = np.array([len(d) for d in docs])
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    width = np.minimum(WINDOW, n)
    # windows of document i start at its words first[i] .. first[i] + n[i] - width[i]
    count = n - width + 1
    w_doc = np.repeat(np.arange(len(n), dtype=np.int32), count)
    w_first = np.concatenate([[0], np.cumsum(count)[:-1]])
    w_start = ((first - w_first)[w_doc] + np.arange(count.sum())).astype(np.int32)
    w_size = width.astype(np.int32)[w_doc]
    balance = np.where(y == 1, TOXIC_SHARE / y.sum(), (1 - TOXIC_SHARE) / (1 - y).sum())

    rng = np.random.default_rng(seed)
    # columns of the softmax: the two classes for the window, and the two for the average of the text
    table_, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 4)), 0.0
    out[:, 2:] = 0
    moments = [np.zeros_like(table_), np.zeros_like(table_), np.zeros_like(out), np.zeros_like(out), 0.0, 0.0]
    for step in range(1, steps + 1):
        sharp = 0.5 * 40 ** (step / steps)
        delta = out[:, 1::2] - out[:, ::2]
        bucket = table_ @ delta
        margin = np.add.reduceat(bucket[flat, 0], starts) / size
        average = np.add.reduceat((np.add.reduceat(bucket[flat, 1], starts) / size)[word], first) / n
        sums = np.concatenate([[0.0], np.cumsum(margin[word])])
        window = (sums[w_start + w_size] - sums[w_start]) / w_size
        top = np.maximum.reduceat(window, w_first)
        share = np.exp(sharp * (window - top[w_doc]))
        share /= np.add.reduceat(share, w_first)[w_doc]
        logit = np.add.reduceat(share * window, w_first) + average + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) * balance
        pull = share * error[w_doc] / w_size
        # each window passes its pull to its words: a difference array over word positions
        edge = np.bincount(w_start, pull, len(word) + 1) - np.bincount(w_start + w_size, pull, len(word) + 1)
        per_word = [np.bincount(word, pulls, len(size)) / size for pulls in (np.cumsum(edge)[:-1], np.repeat(error / n, n))]
        per_bucket = np.stack([np.bincount(flat, np.repeat(p, size), BUCKETS) for p in per_word], 1)
        g_delta = table_.T @ per_bucket
        grads = (per_bucket @ delta.T + 1e-7 * table_, np.stack([-g_delta[:, 0], g_delta[:, 0], -g_delta[:, 1], g_delta[:, 1]], 1) + 1e-5 * out, error.sum())
        params = [table_, out, bias]
        for i, g in enumerate(grads):
            m, v = moments[2 * i] * 0.9 + 0.1 * g, moments[2 * i + 1] * 0.99 + 0.01 * g * g
            moments[2 * i], moments[2 * i + 1] = m, v
            params[i] = params[i] - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        table_, out, bias = params
    return Model(table_ @ (out[:, 1] - out[:, 0]), table_ @ (out[:, 3] - out[:, 2]), bias)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, text and label of the sample: at most per_class documents of each class with at most chars characters together, outside the held-out fold."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class rows of two numbers
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(chosen, "doc_id").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    upto = rows.withColumns({"place": F.row_number().over(order), "upto": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return upto.filter((F.col("upto") <= chars) | (F.col("place") == 1)).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """Trained in one task on the bounded sample; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({tuple(r.values()) for batch in batches for r in batch.to_pylist()})
        bucket, whole, bias, trained = train([r[1] for r in rows], [r[2] for r in rows]).parts
        yield pa.RecordBatch.from_pydict({"bucket": [bucket.tobytes()], "whole": [whole.tobytes()], "bias": [bias], "trained": [trained]})

    # a task without rows may not run at all
    found = training_rows(docs, labels, **how).coalesce(1).mapInArrow(run, "bucket binary, whole binary, bias double, trained boolean").collect()
    if not found:
        return train([], [])
    return Model(*(np.frombuffer(found[0][c], np.float32) for c in ("bucket", "whole")), found[0]["bias"], found[0]["trained"])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model.parts)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"), docs[text_col].alias("text"))

    def make():
        scorer = Scorer(Model(*held.value))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = scorer.scores([t or "" for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        return one

    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model.parts)

    def make():
        scorer = Scorer(Model(*held.value))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([s < 0.5 for s in scorer.scores([t or "" for t in batch.column(text_col).to_pylist()])], pa.bool_()))

        return one

    return map_rows(docs, make, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
