"""Toxicity scores by a classifier that is regularised by counterfactual identity terms."""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import held_out, labelled_sample, lasting, slices, text_of

#: Terms that name groups of people, with their forms; those of one line may stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("women's", "men's", "girls'", "boys'"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("asians", "latinos", "arabs", "africans", "europeans"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("gays", "lesbians", "bisexuals"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétien", "musulman", "juif", "hindou", "athée"),
    ("chrétienne", "musulmane", "juive", "hindoue"),
    ("chrétiens", "musulmans", "juifs", "hindous", "athées"),
    ("chrétiennes", "musulmanes", "juives", "hindoues"),
    ("noir", "blanc", "arabe", "asiatique", "africain", "européen"),
    ("noirs", "blancs", "arabes", "asiatiques", "africains", "européens"),
    ("immigré", "réfugié", "étranger"),
    ("immigrés", "réfugiés", "étrangers"),
    ("frau", "mann", "junge"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christ", "muslim", "jude", "hindu", "atheist"),
    ("christen", "muslime", "juden", "hindus", "atheisten"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch"),
    ("christliche", "muslimische", "jüdische", "hinduistische"),
    ("schwarze", "weiße", "asiatische", "arabische", "afrikanische", "europäische"),
    ("einwanderer", "flüchtling", "ausländer"),
    ("einwanderern", "flüchtlinge", "ausländern"),
    ("mujer", "hombre", "niña", "niño"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristiano", "musulmán", "judío", "hindú", "ateo"),
    ("cristiana", "musulmana", "judía", "atea"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "ateos"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("inmigrante", "refugiado", "extranjero"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
#: Training rows at most; hash buckets; lengths of word beginnings; weight of the counterfactual penalty and of the ridge.
ROWS, BUCKETS, PREFIXES, PENALTY, RIDGE = 8_000, 2**20, (3, 4, 5, 6), 4.0, 2e-4
#: Steps and rate of the fit; a bucket counts if it is in LEAST_ROWS texts and its share of the two labels' texts differs by LEAST_Z standard errors.
STEPS, RATE, LEAST_ROWS, LEAST_Z = 150, 0.1, 4, 5.0
CACHE = 200_000
#: Of each term the line that it is first in, and its place there; what ends a sentence.
PLACE = {w: (line, i) for line in reversed(IDENTITY_TERMS) for i, w in enumerate(line)}
MOST = max(map(len, IDENTITY_TERMS))
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str) -> set[str]:
    """The distinct words of a text, without case and outer punctuation."""
    return {w.strip(string.punctuation) for w in text.lower().split()} - {""}


def buckets(word: str) -> list[int]:
    """Hash buckets of a word and of its beginnings."""
    return [xxhash.xxh32_intdigest(word) % BUCKETS, *(xxhash.xxh32_intdigest("^" + word[:n]) % BUCKETS for n in PREFIXES if len(word) >= n)]


def swaps(text: str) -> list[list[int]]:
    """How the buckets of a text's sentences change when all identity terms in a sentence are swapped for others of their lines: signed numbers of buckets from 1, one list for each distinct change."""
    named = {frozenset(words & PLACE.keys()) for sentence in SENTENCE.split(text) if (words := words_of(sentence))}
    found = []
    for terms in sorted(map(sorted, named)):
        for shift in range(1, MOST):
            lines = [(line, i + shift) for line, i in map(PLACE.__getitem__, terms)]
            if all(shift >= len(line) for line, _ in lines):
                break
            other = {line[i % len(line)] for line, i in lines}
            change = [b + 1 for w in sorted(other - set(terms)) for b in buckets(w)] + [-b - 1 for w in sorted(set(terms) - other) for b in buckets(w)]
            if change:
                found.append(change)
    return found


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _features(sample: DataFrame) -> DataFrame:
    """(_label, _own, _times, _swaps): distinct buckets of each text and their counts, and the changes under swaps of identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, times, changes = [], [], []
            for text in batch.column(1).to_pylist():
                found, counts = np.unique(np.array([b for w in words_of(text) for b in buckets(w)], np.int32), return_counts=True)
                own.append(found)
                times.append(counts.astype(np.float32))
                changes.append(swaps(text))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(own, kind), pa.array(times, pa.list_(pa.float32())), pa.array(changes, pa.list_(kind))], ["_label", "_own", "_times", "_swaps"])

    return sample.mapInArrow(run, "_label int, _own array<int>, _times array<float>, _swaps array<array<int>>")


def fit(docs: DataFrame, labels: DataFrame, label: str, held: F.Column, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> Model:
    """Logistic regression on at most `rows` labelled texts, with a penalty on score changes under swaps of identity terms.

    Each sentence of a text with identity terms has counterfactuals: the terms
    swapped for each of the others of their lines. The loss is the mean over texts of log-loss plus penalty times
    the mean of (z - z')**2 over a text's counterfactuals, where z is a
    sentence's logit and z' the counterfactual's, plus a ridge. Features are
    counts of hashed words and word beginnings over a text's distinct words;
    those that do not tell the labels apart get no weight. Without labels all
    scores are 0.5. Repeated rows of labelled texts count each; columns of other names are ignored.
    """
    table = _features(labelled_sample(docs, labels, label, held, rows, id_col, text_col)).toArrow()
    y = table.column("_label").to_numpy().astype(np.float64)
    if not len(y):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    own, swapped = table.column("_own").combine_chunks(), table.column("_swaps").combine_chunks()
    each = swapped.flatten()
    signed = each.flatten().to_numpy().astype(np.int64)
    change_at, change_cols, change_sign = np.repeat(np.arange(len(each)), each.value_lengths().to_numpy()), np.abs(signed) - 1, np.sign(signed).astype(np.float64)
    per_text = swapped.value_lengths().to_numpy()
    part = np.repeat(1 / np.maximum(per_text, 1), per_text)
    at = np.repeat(np.arange(len(y), dtype=np.int32), own.value_lengths().to_numpy())
    cols, times = own.flatten().to_numpy(), table.column("_times").combine_chunks().flatten().to_numpy()
    del table, own
    there = np.bincount(cols, minlength=BUCKETS)
    toxic = np.bincount(cols[y[at] == 1], minlength=BUCKETS)
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    share = there / len(y)
    z = (toxic / n1 - (there - toxic) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    wide = (there >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z)
    change = wide[change_cols]
    change_at, change_cols, change_sign = change_at[change], change_cols[change], change_sign[change]
    keep = wide[cols]
    at, cols, times = at[keep], cols[keep], times[keep]
    w, bias = np.zeros(BUCKETS), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    weight /= weight.mean()
    for step in range(1, STEPS + 1):
        z = np.bincount(at, times * w[cols], len(y)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = weight * (p - y) / len(y)
        g = np.bincount(cols, times * error[at], BUCKETS) + RIDGE * w
        if len(change_at):
            delta = np.bincount(change_at, change_sign * w[change_cols], len(each)) * part
            g += np.bincount(change_cols, 2 * penalty / len(y) * delta[change_at] * change_sign, BUCKETS)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = RATE * (1 - step / (STEPS + 1))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-4)
    return Model(w.astype(np.float32), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, _score (0 to 1, higher: more likely toxic) and carried columns as _carry_<name>, for every row, repeated ones too; no shuffle. An empty table gives no rows; other columns are ignored, whatever their names.

    A text's logit is the bias plus the weights of its distinct words' buckets.
    Null and empty texts have the bias alone. The model's size is fixed by
    BUCKETS; it goes to the executors as a broadcast variable.
    """
    kept = [F.col(id_col).alias("_id"), *[F.col(c).alias(f"_carry_{c}") for c in carry]]
    rows = docs.select(*kept, text_of(text_col).alias("_text"))
    names, name = rows.columns[:-1], uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_text")

    class Scores(dict):
        def __missing__(self, word: str) -> float:
            if len(self) >= CACHE:
                self.clear()
            s = self[word] = float(shared.value[0][buckets(word)].sum(dtype=np.float64))
            return s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias = lasting(f"toxicity-{name}", Scores), shared.value[1]
        for batch in slices(batches):
            # sorted: sums of floats do not depend on a set's order
            z = np.array([bias + sum(map(known.__getitem__, sorted(words_of(t)))) for t in batch.column(len(names)).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*names, "_score"])

    return rows.mapInArrow(run, f"{kinds}, _score double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Scores of all docs by a model fitted to labels.toxic: doc_id, held_out, score. Nulls, repeats, empty tables and clashing columns as in fit() and score(); null ids are held out."""
    held = held_out("doc_id", 5, 0)
    found = score(docs, fit(docs, labels, "toxic", held, rows))
    return found.select(F.col("_id").alias("doc_id"), held_out("_id", 5, 0).alias("held_out"), F.col("_score").alias("score"))
