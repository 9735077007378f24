"""Toxicity scores from subword bags: averaged embeddings under a linear softmax, trained jointly in numpy.

A word is lower-cased, cleared of marks, digits written for letters are read as letters and repeated letters as one;
its features are its character n-grams between boundary marks, hashed into a table of embeddings. A word is the mean
of its features, a text the mean of its words, and the softmax of a linear layer on that mean gives the score. Only
features whose presence goes with the label beyond doubt (log-likelihood ratio above `least_evidence`) are trained and
all others stay zero, so single texts and wrong labels cannot be learnt by heart; a misspelling that was never seen
still shares n-grams with the words that were. Texts that share their least word 5-gram and label count once in
training, so a group of copies has one vote.

Training reads at most `max_rows` labelled rows (`MAX_ROWS`, the ones with the smallest hash of their doc_id), none of
which is held out; scoring covers every row and whole texts. Labels that are null or of unknown documents are left
out. Null and empty texts score by the bias alone, as do texts without a word; with no labels at all every score is 0.
Rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import slices

#: Most labelled rows that training takes to the driver.
MAX_ROWS = 8000
FOLDS = 5
THRESHOLD = 0.5
BUCKETS = 1 << 17
SIZE = 8
NGRAMS = (3, 4, 5)
#: Pieces kept per worker, about 100 bytes each.
CACHED_WORDS = 1_000_000
# Marks and digits that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ENDS = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")


def letters(piece: str) -> str:
    """The letters that a reader sees in a piece between spaces."""
    word = piece.lower().strip(MARKS)
    if word.isalpha():
        return word
    return INNER.sub("", ENDS.sub("", word).translate(LOOKALIKES))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words (not empty) at once, and the number of the word of each; repeated letters are one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), "<u4")
    word = np.repeat(np.arange(len(words)), sizes)
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    codes, word = codes[fresh].astype(np.uint64), word[fresh]
    ids, owners = [], []
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        mixed = np.full(m, n, np.uint64)
        for j in range(n):
            mixed = (mixed ^ codes[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = word[:m] == word[n - 1 :]
        ids.append((mixed[inside] >> np.uint64(20)) & np.uint64(BUCKETS - 1))
        owners.append(word[:m][inside])
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners)


class SubwordModel:
    """Embeddings, linear layer and bias of two classes."""

    def __init__(self, embeddings: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.embeddings, self.layer, self.bias = embeddings, layer, bias

    def tables(self) -> tuple[np.ndarray, float]:
        """The margin of each feature and of the bias: the layer is linear, so it can be applied to features first."""
        return (self.embeddings @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and the weight of each in the mean."""
    pieces = Counter((text or "").split())
    counts = Counter()
    for piece, times in pieces.items():
        if word := letters(piece):
            counts[word] += times
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, owners = features(list(counts))
    times = np.array(list(counts.values()), np.float64)
    each = times / times.sum() / np.bincount(owners, minlength=len(times))
    unique, at = np.unique(ids, return_inverse=True)
    return unique.astype(np.int32), np.bincount(at, weights=each[owners]).astype(np.float32)


def least_gram(text: str | None, n: int = 5) -> int:
    """The smallest hash of the word n-grams of a text: equal for most near copies."""
    words = (text or "").lower().split()
    return min((zlib.crc32(" ".join(words[i : i + n]).encode("utf-8", "replace")) for i in range(max(1, len(words) - n + 1))), default=0)


def evidence(met: np.ndarray, positive: np.ndarray, n: int, n_positive: int) -> np.ndarray:
    """Log-likelihood ratio of presence and label for features met in `met` texts, `positive` of them labelled 1."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    share = n_positive / max(n, 1)
    absent = n - met
    return 2 * (
        part(positive, met * share) + part(met - positive, met * (1 - share))
        + part(n_positive - positive, absent * share) + part(absent - n_positive + positive, absent * (1 - share))
    )


def train(
    rows: list[tuple[str | None, int]], epochs: int = 10, rate: float = 0.3, gain: float = 100.0, decay: float = 1e-6,
    least_evidence: float = 30.0, seed: int = 7,
) -> SubwordModel:
    """Fit embeddings, layer and bias together on (text, label) rows with Adagrad; the row order decides the batches.

    `gain` scales the mean, in which a few words of a long text weigh little.
    """
    once: dict[tuple[int, int], str | None] = {}
    for text, label in rows:
        once.setdefault((least_gram(text), label), text)
    random = np.random.default_rng(seed)
    embeddings = random.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    layer, bias = random.normal(0, 0.3, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    labels = np.array([y for _, y in once], np.int64)
    n, positive = len(labels), int(labels.sum())
    if n == 0 or positive in (0, n):
        return SubwordModel(np.zeros_like(embeddings), layer, np.array((0, 50) if positive else (50, 0), np.float32))
    bags = [bag(t) for t in once.values()]
    met, met_positive = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for (i, _), y in zip(bags, labels):
        met[i] += 1
        met_positive[i] += y
    usable = evidence(met, met_positive, n, positive) > least_evidence
    embeddings[~usable] = 0
    bags = [(i[usable[i]], w[usable[i]] * np.float32(gain)) for i, w in bags]
    seen_e, seen_l, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full(layer.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    onehot = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = random.permutation(n)
        for a, b in slices(n, max(1, min(64, n // 8))):
            part = order[a:b]
            unique, at = np.unique(np.concatenate([bags[k][0] for k in part]), return_inverse=True)
            x = np.zeros((len(part), len(unique)), np.float32)
            x[np.repeat(np.arange(len(part)), [len(bags[k][0]) for k in part]), at] = np.concatenate([bags[k][1] for k in part])
            hidden = x @ embeddings[unique]
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - onehot[part]) / len(part)
            to_layer, to_bias = hidden.T @ error, error.sum(axis=0)
            to_embeddings = x.T @ (error @ layer.T) + decay * embeddings[unique]
            seen_e[unique] += (to_embeddings**2).mean(axis=1)
            seen_l += to_layer**2
            seen_b += to_bias**2
            embeddings[unique] -= step * to_embeddings / np.sqrt(seen_e[unique])[:, None]
            layer -= 0.2 * step * to_layer / np.sqrt(seen_l)
            bias -= step * to_bias / np.sqrt(seen_b)
    return SubwordModel(embeddings * np.float32(gain), layer, bias)


class Scorer:
    """Scores texts; the margin of each piece is kept, up to a bound."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins, bias
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.margin, self.is_word = np.zeros(1 << 14), np.zeros(1 << 14)

    def learn(self, pieces: list[str]) -> None:
        k = len(self.index)
        while k + len(pieces) > len(self.margin):
            self.margin, self.is_word = np.resize(self.margin, 2 * len(self.margin)), np.resize(self.is_word, 2 * len(self.is_word))
        self.index.update(zip(pieces, range(k, k + len(pieces))))
        words = [letters(p) for p in pieces]
        found = np.array([bool(w) for w in words])
        mean = np.zeros(len(words))
        if found.any():
            ids, owners = features([w for w in words if w])
            mean[found] = np.bincount(owners, weights=self.margins[ids]) / np.bincount(owners)
        # a piece without a letter does not count as a word
        self.margin[k : k + len(pieces)], self.is_word[k : k + len(pieces)] = mean, found

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > CACHED_WORDS:
            self.forget()
        cut = [(t or "").split() for t in texts]
        every = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn(list(dict.fromkeys(every[i] for i in new)))
            at[new] = [self.index[every[i]] for i in new]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        total = np.bincount(owner, weights=self.margin[at], minlength=len(cut))
        n = np.bincount(owner, weights=self.is_word[at], minlength=len(cut))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -60, 60)))


def held_out() -> Column:
    """Whether a row is held out from training."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str | None, int]]:
    """At most `max_rows` (text, label) rows outside the held-out fold, in the order of a hash of their doc_id; of the texts of one doc_id the first."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    taken = marked.where(~held_out()).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken), "doc_id")
    # one row of each doc_id, so that repeated rows cannot pass the bound
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [(r.text, int(r.toxic > 0)) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text or ""))]


def shared_tables(spark: SparkSession, model: SubwordModel):
    """The margin of each feature, sent to executors: one float per bucket, half a megabyte for any corpus."""
    margins, bias = model.tables()
    return spark.sparkContext.broadcast((margins.astype(np.float32).tobytes(), bias))


def scorer(shared) -> Scorer:
    raw, bias = shared.value
    return Scorer(np.frombuffer(raw, np.float32).astype(np.float64), bias)


def score_documents(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = shared_tables(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scorer(shared)
        for batch in batches:
            for a, e in slices(batch.num_rows, 256):
                part = batch.slice(a, e - a)
                scores = tool.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold; filtered where they are read."""
    shared = shared_tables(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scorer(shared)
        for batch in batches:
            for a, e in slices(batch.num_rows, 256):
                part = batch.slice(a, e - a)
                yield part.filter(pa.array(tool.scores(part.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on the labelled rows of `labelled` and score `docs`."""
    return score_documents(docs, train(labelled_rows(labelled, labels, max_rows)))
