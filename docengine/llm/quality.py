"""Quality scores by supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax output."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import held_out, labelled_sample, lasting, slices, text_of

#: Training rows at most; buckets of words and of character n-grams, and of word pairs; dimensions; passes; first learning rate.
ROWS, BUCKETS, DIMENSIONS, PASSES, RATE = 6_000, 2**17, 8, 6, 0.5
#: Texts of a step.
BATCH = 16
NGRAMS = (2, 3)
CACHE = 200_000
#: Bucket of a word that follows itself.
SAME = 0


def bucket(piece: str) -> int:
    return 1 + xxhash.xxh32_intdigest(piece) % (BUCKETS - 1)


def grams(word: str) -> dict[str, None]:
    """The distinct character n-grams of a word with marks at both ends, in order."""
    marked = f"<{word}>"
    return dict.fromkeys([marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)])


class Known(dict):
    """What f gives for pieces, computed once each while they fit."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, piece: str):
        if len(self) >= CACHE:
            self.clear()
        x = self[piece] = self.f(piece)
        return x


class Vocabulary:
    """Words as numbers into growing arrays: of each word its hash, and its buckets (in training) or what their projections add up to."""

    def __init__(self, projected: np.ndarray | None = None):
        self.projected = projected
        self.hashes, self.sums, self.counts = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16), np.zeros(1 << 16, np.int64)
        self.pieces = Known(bucket if projected is None else lambda piece: float(projected[bucket(piece)]))
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.buckets: list[list[int]] = []

    def number(self, word: str) -> int:
        n = self.ids[word] = len(self.ids)
        if n >= len(self.hashes):
            self.hashes, self.sums, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.sums, self.counts))
        inner, whole = grams(word), f"<{word}>"
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        if self.projected is None:
            self.buckets.append([bucket(whole), *map(self.pieces.__getitem__, inner)])
        else:
            self.sums[n] = self.projected[bucket(whole)] + sum(map(self.pieces.__getitem__, inner))
            self.counts[n] = 1 + len(inner)
        return n

    def text(self, words: list[str]) -> np.ndarray:
        if len(self.ids) >= CACHE:
            self.clear()
        get, number = self.ids.get, self.number
        return np.fromiter((n if (n := get(w)) is not None else number(w) for w in words), np.int64, len(words))


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; one for all words that repeat the word before."""
    mixed = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    mixed ^= mixed >> np.uint64(32)
    return np.where(hashes[:-1] == hashes[1:], SAME, 1 + (mixed % np.uint64(BUCKETS - 1)).astype(np.int64))


@dataclass
class Model:
    """vectors (BUCKETS, DIMENSIONS), output (2, DIMENSIONS), bias (2)."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def _features(sample: DataFrame) -> DataFrame:
    """(_id, _label, _buckets, _counts) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in slices(batches):
            ids, counts = [], []
            for text in batch.column(1).to_pylist():
                at = known.text(text.split())
                words, times = np.unique(at, return_counts=True)
                found = [np.repeat(np.array(known.buckets[w]), n) for w, n in zip(words.tolist(), times.tolist(), strict=True)]
                if len(at) > 1:
                    found.append(pair_buckets(known.hashes[at]))
                b, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                ids.append(b.astype(np.int32))
                counts.append(c.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, kind), pa.array(counts, kind)], ["_id", "_label", "_buckets", "_counts"])

    return sample.mapInArrow(run, f"_id {dict(sample.dtypes)['_id']}, _label int, _buckets array<int>, _counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str, held: F.Column, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Embeddings and softmax weights from at most `rows` labelled texts, by numpy stochastic gradient descent, BATCH texts a step.

    A text's vector is the mean of the vectors of all its words' buckets:
    words, character n-grams and neighbouring pairs, each as often as it
    occurs. Texts come in an order drawn with a fixed seed. Without labels
    all scores are 0.5. Repeated rows of labelled texts count each; columns of other names are ignored.
    """
    table = _features(labelled_sample(docs, labels, label, held, rows, id_col, text_col)).orderBy(F.xxhash64("_id"), "_id", F.size("_buckets")).toArrow()
    y = table.column("_label").to_numpy()
    state = np.random.RandomState(7)
    vectors = (state.rand(BUCKETS, DIMENSIONS) - 0.5) / DIMENSIONS
    output, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    ids, counts = table.column("_buckets").combine_chunks(), table.column("_counts").combine_chunks()
    start = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]) if len(y) else np.zeros(1, np.int64)
    flat, times = (ids.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float32)) if len(y) else (np.zeros(0, np.int32), np.zeros(0, np.float32))
    steps, done = PASSES * max(len(y), 1), 0
    for _ in range(PASSES):
        order = state.permutation(len(y))
        for first in range(0, len(y), BATCH):
            texts = order[first : first + BATCH]
            rate = RATE * (1 - done / steps)
            done += len(texts)
            sizes = start[texts + 1] - start[texts]
            of = np.repeat(np.arange(len(texts)), sizes)
            at = np.repeat(start[texts] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            b, share = flat[at], times[at]
            share = share / np.maximum(np.bincount(of, share, len(texts)), 1)[of]
            add = lambda where, x, n: np.stack([np.bincount(where, x[:, d], n) for d in range(DIMENSIONS)], 1)
            hidden = add(of, share[:, None] * vectors[b], len(texts))
            z = hidden @ output.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(texts)), y[texts]] -= 1
            back = p @ output
            output -= rate * (p.T @ hidden) / len(texts) ** 0.5
            bias -= 0.1 * rate * p.mean(0)
            # a text's buckets share the step by their part in its mean, scaled so that it does not fade with its length; a bucket takes the mean of its texts' steps
            used, place = np.unique(b, return_inverse=True)
            weight = np.minimum(share * 50, 1)
            step = add(place, weight[:, None] * back[of], len(used)) / np.bincount(place, minlength=len(used))[:, None] ** 0.5
            vectors[used] -= rate * step
    return Model(vectors, output, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and _score (0 to 1, higher: label 1 likelier) for every row, repeated ones too; no shuffle. An empty table gives no rows.

    The output layer is linear in the mean, so each bucket's vector is
    projected to one number before it is sent: the executors get a table whose
    size BUCKETS fixes. Null and empty texts have the bias alone.
    """
    direction = (model.output[1] - model.output[0]).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors.astype(np.float64) @ direction, float(model.bias[1] - model.bias[0])))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projected, bias = shared.value
        known = lasting(f"quality-{name}", lambda: Vocabulary(projected))
        for batch in slices(batches):
            z = []
            for text in batch.column(1).to_pylist():
                at = known.text(text.split())
                total = float(known.sums[at].sum())
                n = int(known.counts[at].sum())
                if len(at) > 1:
                    pairs = pair_buckets(known.hashes[at])
                    total += float(projected[pairs].sum())
                    n += len(pairs)
                z.append(bias + total / max(n, 1))
            s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["_id", "_score"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _score double")


def quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Scores of all docs by a model fitted to labels.quality: doc_id, held_out, score. Nulls, repeats, empty tables and clashing columns as in fit() and score(); null ids are held out."""
    held = held_out("doc_id", 4, 2)
    found = score(docs, fit(docs, labels, "quality", held, rows))
    return found.select(F.col("_id").alias("doc_id"), held_out("_id", 4, 2).alias("held_out"), F.col("_score").alias("score"))
