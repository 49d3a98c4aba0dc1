"""Quality classifier: logistic regression on hashed word n-grams.

Features are words and word pairs, hashed to a fixed number of weights, present or
absent, divided by the root of their number, the words' shapes, hashed likewise, and
tenths of five shares of the whole text (``_habits``). Weights are learned with follow-the-regularised-leader updates (per-weight
rates, L1 and L2). A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Weights are hashed into so many slots.
BITS = 20
#: At most so many labelled rows are learned from, drawn by a hash of the id; the documented bound.
TRAIN_ROWS = 12_000
#: Learning rate and its offset, the two penalties, and the passes over the labelled rows.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.01, 0.05, 4
#: Texts are worked on in groups of about so many bytes.
BATCH_BYTES = 1 << 20
#: Value of the features of a whole text and of the intercept.
HABIT = 0.3


class Features:
    """Sparse rows: slot and value of each entry, and the bounds of the rows.

    An n-gram's value is 1/sqrt(n-grams in the row). Habits of the whole text (``_habits``) have
    slots for each tenth that they reach, with the value HABIT.
    """

    def __init__(self, texts, bits: int = BITS):
        buf, starts, _ = common.text_bytes(texts)
        words = common.Words(buf, starts, common.BLANK_SEPARATED)
        h = words.hashes()
        doc = words.doc
        pair_at = common.window_starts(words.count, words.first, 2)
        pairs = common.rolling(h, 2, seed=5)[pair_at] if len(pair_at) else np.zeros(0, np.uint64)
        shape_h, shape_doc = _shapes(words, doc)
        slot = np.concatenate((h, pairs, shape_h)) >> np.uint64(64 - bits)
        row = np.concatenate((doc, doc[pair_at], shape_doc))
        keys = np.unique((row.astype(np.uint64) << np.uint64(bits)) | slot)
        self.n = len(starts)
        gram_row = (keys >> np.uint64(bits)).astype(np.int64)
        size = np.bincount(gram_row, minlength=self.n)
        habit_slot, habit_row = _habits(words, h, pair_at, doc, self.n, bits)
        self.row = np.concatenate((gram_row, habit_row))
        self.slot = np.concatenate(((keys & np.uint64((1 << bits) - 1)).astype(np.int64), habit_slot))
        self.value = np.concatenate((1 / np.sqrt(size[gram_row]), np.full(len(habit_row), HABIT)))
        order = np.argsort(self.row, kind="stable")
        self.row, self.slot, self.value = self.row[order], self.slot[order], self.value[order]
        self.bound = np.searchsorted(self.row, np.arange(self.n + 1))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.slot] * self.value, minlength=self.n)


def _habits(words: common.Words, h: np.ndarray, pair_at: np.ndarray, doc: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of a text's words, in tenths: words said twice in a row, first occurrences, words that
    end in no letter or digit, words without any, words with two capitals or more."""
    total = np.maximum(words.count, 1)
    by_doc = np.argsort(h, kind="stable")
    by_doc = by_doc[np.argsort(doc[by_doc], kind="stable")]
    first = np.ones(len(h), bool)
    first[1:] = (h[by_doc][1:] != h[by_doc][:-1]) | (doc[by_doc][1:] != doc[by_doc][:-1])
    letter = np.zeros(256, bool)
    letter[48:58] = letter[65:91] = letter[97:123] = letter[128:] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    letters = np.concatenate(([0], np.cumsum(letter[words.buf])))
    uppers = np.concatenate(([0], np.cumsum(upper[words.buf])))
    in_word = letters[words.end] - letters[words.start]
    shares = [
        np.bincount(doc[pair_at], weights=h[pair_at] == h[pair_at + 1], minlength=n) / total,
        np.bincount(doc[by_doc], weights=first, minlength=n) / total,
        np.bincount(doc, weights=~letter[words.buf[words.end - 1]], minlength=n) / total,
        np.bincount(doc, weights=in_word == 0, minlength=n) / total,
        np.bincount(doc, weights=uppers[words.end] - uppers[words.start] > 1, minlength=n) / total,
    ]
    slots, rows = [], []
    for k, share in enumerate(shares):
        for tenth in range(10):
            reached = np.flatnonzero(share * 10 >= tenth + 0.5)
            key = int(common.mix(np.array([1000 + 10 * k + tenth], np.uint64))[0] >> np.uint64(64 - bits))
            slots.append(np.full(len(reached), key, np.int64))
            rows.append(reached)
    return np.concatenate(slots), np.concatenate(rows)


def _shapes(words: common.Words, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with letters and digits folded into classes: case and punctuation habits."""
    fold = np.arange(256, dtype=np.uint8)
    fold[48:58], fold[65:91], fold[97:123], fold[128:] = 48, 65, 97, 97
    folded = fold[words.buf]
    keep = np.ones(len(folded), bool)
    keep[1:] = folded[1:] != folded[:-1]  # runs of a class count once
    squeezed = np.flatnonzero(keep)
    start = np.searchsorted(squeezed, words.start)
    end = np.searchsorted(squeezed, words.end)
    part = object.__new__(common.Words)
    part.buf, part.start, part.end = folded[squeezed], start, np.maximum(end, start + 1)
    return part.hashes(seed=3), doc


class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - y) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(examples: Iterable[tuple[Features, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights; the last of 2**bits + 1 is the intercept."""
    model = FTRL((1 << bits) + 1)
    data = [(f.slot.astype(np.int32), f.value.astype(np.float32), f.bound, y) for f, y in examples]
    bias = np.array([1 << bits], np.int32), np.array([HABIT], np.float32)
    for p in range(epochs):
        for slot, value, bound, y in data:
            for i in np.random.default_rng(p).permutation(len(y)):
                part = slice(bound[i], bound[i + 1])
                model.update(np.append(slot[part], bias[0]), np.append(value[part], bias[1]), float(y[i]))
    return model.weights().astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Learn from labelled rows (null labels, ids and repeated ids aside), ``max_rows`` of them at most.

    Those are the ones with the smallest hashes of their ids, so that the choice doesn't depend on
    partitions. Their texts go to one task; the bound on rows keeps it a fixed size. No labelled
    row, or one class only: weights that are all zero but for the intercept's trend.
    """
    common.small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("doc_id"))
        .agg(F.min(label_col).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = train((Features(b.column("text")), np.asarray(b.column("y"), np.float64)) for b in common.text_batches(batches, "text", BATCH_BYTES))
        common.trim()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w[at].astype("<f4").tobytes()], pa.binary())], names=["slot", "weight"])

    weights = np.zeros((1 << BITS) + 1, np.float32)
    for r in one.mapInArrow(learn, "slot binary, weight binary").collect():  # one row of at most 2**BITS weights
        weights[np.frombuffer(r["slot"], "<i4")] = np.frombuffer(r["weight"], "<f4")
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts get the intercept's score.

    Ids, null or repeated, pass through. The weights (4 MB, a fixed size) are broadcast.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        bias = float(w[-1])
        for b in common.text_batches(batches, "text", BATCH_BYTES):
            f = Features(b.column("text"))
            z = f.dot(w) + bias * HABIT
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").combine_chunks(), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, weights: np.ndarray, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and the score of each row as the last one; cases as in ``score``.

    A column that has the name already stays, and the score's name gets underscores before it until it is free.
    """
    from pyspark.sql import types as T

    name = common.free_name(docs.columns, name)
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in common.text_batches(batches, text_col, BATCH_BYTES):
            z = Features(b.column(text_col)).dot(w) + float(w[-1]) * HABIT
            scored = b.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield from scored.combine_chunks().to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
