"""Repetition coverage: characters inside duplicated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import lasting, slices

#: Most of a text's word characters that duplicated n-grams of each length may cover (fixed values from published web-corpus rules).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of a text's word characters that duplicated lines may hold.
LINE_LIMIT = 0.20
SPACE = bytes([0x20, *range(0x09, 0x0E)])
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
#: Word hashes that a task keeps; the table is emptied when it is full.
CACHE = 200_000


class WordHashes(dict):
    """64-bit hashes of words, computed once each while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """A 64-bit polynomial hash of each run of n words, for each n of sizes, each run one step from the run a word shorter."""
    out, h = {}, words.copy()
    base = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(words) < n:
                break
            h = h[: len(words) - n + 1] * base + words[n - 1 :]
        if n in sizes:
            out[n] = h
    return out


def covered(hashes: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Which of total words lie in a run of n that occurs twice or more, and in one that occurred before; None if none does."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return None

    def inside(at: np.ndarray) -> np.ndarray:
        marks = np.zeros(total + 1, np.int64)
        marks[at] += 1
        marks[at + n] -= 1
        return np.cumsum(marks[:total]) > 0

    later = order[1:][same]
    return inside(np.union1d(later, order[:-1][same])), inside(later)


def measure(text: bytes, hashes: WordHashes) -> tuple:
    """The counts of one text: words, word characters, symbols, repeated lines and words, characters in repeated n-grams and lines."""
    split = text.split()
    n = len(split)
    chars = len(text.translate(None, SPACE + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup_lines, dup_line_chars = set(), 0, 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line.translate(None, SPACE + CONTINUATION))
            elif line and line.strip(SPACE):
                seen.add(line)
    repeat_words, inside = 0, dict.fromkeys(NGRAM_LIMITS, 0)
    if n > min(NGRAM_LIMITS):
        words = np.fromiter(map(hashes.__getitem__, split), np.uint64, n)
        lengths = None
        for k, h in window_hashes(words, sorted({8, *NGRAM_LIMITS})).items():
            found = covered(h, k, n)
            if found is None:
                break  # longer runs repeat only where shorter ones do
            if k == 8:
                repeat_words = int(found[0].sum())
            if k in NGRAM_LIMITS:
                if lengths is None:
                    lengths = np.fromiter((len(w.translate(None, CONTINUATION)) for w in split), np.int64, n)
                inside[k] = int(lengths[found[1]].sum())
    return n, chars, symbols, dup_lines, repeat_words, dup_line_chars, *inside.values()


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in NGRAM_LIMITS])


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, COUNTS (long), and _repetitive, the verdict.

    A text is repetitive if the characters of words inside n-grams that
    occurred before exceed NGRAM_LIMITS[n] of all word characters, for one n,
    or those of lines equal to an earlier line exceed LINE_LIMIT. The limits
    are those published for repeats without the first occurrence, so it
    does not count here; it does in n_repeat_words.

    Windows are compared by 64-bit hashes, lines byte by byte. A task holds
    one text and a few arrays of its words at a time. No shuffle. Null and
    empty texts have no words and are not repetitive. Repeated rows give
    repeated results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_bytes"))
    schema = f"_id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} long" for c in COUNTS)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = lasting("word hashes", WordHashes)
        for batch in slices(batches):
            found = [measure(x.as_py(), hashes) for x in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", *COUNTS])

    out = rows.mapInArrow(counts, schema)
    over = F.col("dup_line_chars") > F.lit(LINE_LIMIT) * F.col("word_chars")
    for n, most in NGRAM_LIMITS.items():
        over = over | (F.col(f"dup_chars_{n}") > F.lit(most) * F.col("word_chars"))
    return out.withColumn("_repetitive", over)
