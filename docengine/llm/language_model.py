"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays in the shared folder, mapped into memory by the workers that score."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import lasting, shared_dir, text_of, written
from docengine.llm.grams import PACKED, SLICE, Splitter, batch_of, dealt, gathered, mixed, ranges, shard_of, summed, text_slices

#: Words of the longest n-gram.
ORDER = 2
#: Hashes of the end of a text, a token of its own, and of what stands before its first word.
END, START = np.uint64(1), np.uint64(2)
SPACE = b" \t\n\x0b\x0c\r"
#: What is kept of each n-gram below the longest: different words before it, occurrences; and of it as a context: what follows it, by how often.
LOWER = ("kinds", "count", "total", "once", "twice", "more")


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and what holds for the whole corpus: tokens, distinct tokens, for each length the discounts of counts 1, 2 and more, and of single words how many have those counts."""

    folder: str
    order: int
    shards: int
    tokens: int
    vocabulary: int
    discounts: tuple[tuple[float, float, float], ...]
    kinds: int
    by_kinds: tuple[int, int, int]


def sequence(texts: list[bytes], order: int, split: Splitter) -> np.ndarray:
    """The tokens of texts in a row, as hashes: before each text order - 1 starts, after it an end."""
    x, start, _, _ = split(b"\n".join(texts))
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    out = np.full(len(x) + order * len(texts), START)
    out[np.arange(len(x)) + of * order + order - 1] = x
    out[np.cumsum(np.bincount(of, minlength=len(texts)) + order) - 1] = END
    return out


def suffixes(words: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of words, from left to right."""
    h = words[0]
    for w in words[1:]:
        h = mixed(h, w)
    return h


def _texts(batches: list[pa.RecordBatch], at: int) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for b in batches for t in b.column(at)]


def _save(folder: str, level: int, shard: int, columns: dict[str, np.ndarray]) -> None:
    """Arrays of a range of hashes, each in as few bytes as it needs; written aside and renamed, so a repeated task replaces what an earlier one wrote."""
    os.makedirs(f"{folder}/{level}", exist_ok=True)
    for name, values in columns.items():
        values = values if name == "key" else values.astype(np.min_scalar_type(int(values.max())))
        part = f"{folder}/{level}/{shard}-{name}.npy"
        with open(aside := f"{part}.{uuid.uuid4().hex}", "wb") as f:
            np.save(f, values)
        os.replace(aside, part)


def mounted(spark) -> str:
    """A new folder for arrays under spark.checkpoint.dir, which has to be a mounted file system: files of other stores cannot be mapped."""
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError("workers map the model into memory: spark.checkpoint.dir has to be on a mounted file system")
    return f"{unquote(at.path)}/docengine-model-{uuid.uuid4().hex}"


def fit(docs: DataFrame, held: Column, text_col: str = "text", order: int = ORDER) -> Model:
    """Counts of the n-grams of all texts that are not held out.

    Tasks count slices of texts. For each length, from the longest, the counts
    are dealt by ranges of the n-gram's hash; a task adds up one range, writes
    its sorted arrays, and deals on what the next shorter length needs: for
    each n-gram without its first word how many different ones there were, for each
    context how many words follow it once, twice and more often. So the most frequent word is one
    row for each range. The number of ranges follows the size of the texts.
    """
    if order < 2:
        raise ValueError("an n-gram model has an order of 2 or more")
    spark = docs.sparkSession
    folder, shards = mounted(spark), ranges(docs, text_col)
    rows = docs.where(~held).select(F.encode(text_of(text_col), "UTF-8").alias("_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lasting("model words", lambda: Splitter(SPACE))
        for run in text_slices(batches):
            x = sequence(_texts(run, 0), order, split)
            words = [x[i : len(x) - order + 1 + i] for i in range(order)]
            full = words[-1] != START
            words = [w[full] for w in words]
            keys, (n,), words = summed(suffixes(words), [np.ones(len(words[0]), np.uint64)], words)
            yield batch_of(list(dealt(order, keys, [*words, n], shards, order)))

    def add(level: int):
        def run(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            if level == order:
                *words, n = gathered(table, order)
                keys, (n,), words = summed(suffixes(words), [n], words)
                counts, kept = (n, n), {"key": keys, "count": n}
            else:
                found = gathered(table, level)
                words, values = found[:level], found[level:]
                keys, values, words = summed(suffixes(words), values, words)
                counts, kept = (values[0], values[1]), {"key": keys} | dict(zip(LOWER, values, strict=True))
            _save(folder, level, shard, kept)
            adjusted, raw = counts
            totals = [*((adjusted == i).sum() for i in (1, 2, 3, 4)), (adjusted > 2).sum(), adjusted.sum(), raw.sum(), (raw > 0).sum()]
            out = []
            real = adjusted > 0  # a start is only a context
            if level > 1:
                ones = np.ones(int(real.sum()), np.uint64)
                after = [w[real] for w in words[1:]]
                k1, v1, w1 = summed(suffixes(after), [ones, raw[real]], after)
                before = [w[real] for w in words[:-1]]
                a = adjusted[real]
                of = [a, (a == 1).astype(np.uint64), (a == 2).astype(np.uint64), (a > 2).astype(np.uint64)]
                k2, v2, w2 = summed(suffixes(before), of, before)
                none = lambda k: [np.zeros(len(k), np.uint64)]
                keys = np.concatenate([k1, k2])
                columns = [np.concatenate(c) for c in zip([*w1, *v1, *none(k1) * 4], [*w2, *none(k2) * 2, *v2], strict=True)]
                keys, values, firsts = summed(keys, columns[level - 1 :], columns[: level - 1])
                out += dealt(level - 1, keys, [*firsts, *values], shards, level - 1)
            batch = batch_of([*out, (shard, 0, 0, None)])
            sums = pa.array([None] * len(out) + [[int(x) for x in totals]], pa.list_(pa.int64()))
            return pa.Table.from_batches([batch]).append_column("totals", sums)

        return run

    each, totals = rows.mapInArrow(count, PACKED), {}
    for level in range(order, 0, -1):
        each = written(each.groupBy("shard").applyInArrow(add(level), PACKED + ", totals array<long>"), "counts")
        totals[level] = [x or 0 for x in each.agg(*[F.sum(F.element_at("totals", i)) for i in range(1, 9)]).head()]
        each = each.where("totals is null").drop("totals")
    base = totals[1]
    discounts = tuple(discount(totals[k][:4]) for k in range(1, order + 1))
    return Model(folder, order, shards, base[6], base[7], discounts, base[5], (base[0], base[1], base[4]))


def discount(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4; 0.5, 1 and 1.5 where a corpus is too small to tell or a value is out of range."""
    out, y = [], n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.0
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if y and n[i - 1] and n[i] else -1.0
        out.append(d if 0 < d <= i else i / 2)
    return tuple(out)


class Arrays:
    """The arrays of a model, mapped when first asked for."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def column(self, level: int, shard: int, name: str) -> np.ndarray:
        if (level, shard, name) not in self.maps:
            path = f"{self.model.folder}/{level}/{shard}-{name}.npy"
            self.maps[level, shard, name] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
        return self.maps[level, shard, name]

    def look_up(self, level: int, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """For each key the named values, 0 for what the corpus does not have; each range of hashes is gone through in order."""
        asked, back = np.unique(keys, return_inverse=True)
        bounds = np.searchsorted(shard_of(asked, self.model.shards), np.arange(self.model.shards + 1))
        out = [np.zeros(len(asked)) for _ in names]
        for s in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            mine, held = slice(bounds[s], bounds[s + 1]), self.column(level, s, "key")
            if not len(held):
                continue
            at = np.minimum(np.searchsorted(held, asked[mine]), len(held) - 1)
            good = held[at] == asked[mine]
            for o, name in zip(out, names, strict=True):
                o[mine] = np.where(good, self.column(level, s, name)[at], 0)
        return [o[back] for o in out]


def taken(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The counts less their discounts."""
    return counts - np.choose(np.minimum(counts, 3).astype(np.int64), (0.0, *d))


def probabilities(x: np.ndarray, model: Model, arrays: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token that is no start: whether it is one, its count in the corpus, and its probability after the words before it."""
    real = x != START
    kinds, count, *follow = arrays.look_up(1, x, LOWER)
    d = model.discounts[0]
    rest = sum(a * b for a, b in zip(d, model.by_kinds, strict=True)) if model.kinds else 1.0
    p = (taken(kinds, d) + rest / (model.vocabulary + 1)) / max(model.kinds, 1)
    for level in range(2, model.order + 1):
        # follow: of the n-grams of level - 1 words that end at each place; the context ends at the place before
        total, once, twice, more = (np.concatenate(([0.0], v[:-1])) for v in follow)
        h = suffixes([np.concatenate((np.zeros(back, np.uint64), x[: len(x) - back])) for back in range(level - 1, -1, -1)])
        if level == model.order:
            (seen,), follow = arrays.look_up(level, h, ("count",)), []
        else:
            seen, *follow = arrays.look_up(level, h, LOWER[:1] + LOWER[2:])
        d = model.discounts[level - 1]
        kept = d[0] * once + d[1] * twice + d[2] * more
        p = np.where(total > 0, (taken(seen, d) + kept * p) / np.maximum(total, 1), p)
    return real, count, p


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, n_tokens, n_known, base_score, score and the carried columns, one row for each document; see perplexity()."""
    rows = docs.select(F.encode(text_of(text_col), "UTF-8").alias("_bytes"), F.col(id_col).alias("_id"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lasting("model words", lambda: Splitter(SPACE))
        arrays = Arrays(model)
        for held in text_slices(batches, SLICE // 4):
            x = sequence(_texts(held, 0), model.order, split)
            real, count, p = probabilities(x, model, arrays)
            x, count, p = x[real], count[real], p[real]
            begin = np.concatenate(([0], np.flatnonzero(x == END)[:-1] + 1))
            base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
            add = lambda v: np.add.reduceat(v, begin)
            columns = [pa.array(c) for c in (add(np.ones(len(x), np.int64)), add((count > 0).astype(np.int64)), add(base), add(np.log10(p)))]
            at = 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(c[at : at + batch.num_rows] for c in columns)], [*batch.schema.names[1:], *names])
                at += batch.num_rows

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns[1:]) + ", n_tokens long, n_known long, base_score double, score double")


def perplexity(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: _id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z); tokens are words and one end. score is the
    log10 probability of all tokens under a model of all texts that are not
    held out, of n-grams up to `order` words, with modified Kneser-Ney discounts, interpolated
    down to a uniform share of the distinct tokens and one unknown. base_score is the
    sum of log10((c + 1) / (N + V + 1)) over single tokens, n_known those with c > 0.
    10 ** (-score / n_tokens) is the perplexity.

    Tasks map the arrays that they need, sorted by hash; a look-up goes through
    the keys of a slice of texts in order. Exact up to collisions of 64-bit hashes.

    Null text counts as empty: an end only. Repeated rows count and are scored
    each. If nothing is learned from, each token has probability 1. An empty
    table gives no rows. Columns beside those named have no influence.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held.alias("held_out"))
    model = fit(rows, F.col("held_out"), "_text", order)
    found = score(rows, model, "_id", "_text", carry=("held_out",))
    return found.select("_id", F.col("_carry_held_out").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: CRC-32 of a number as text, by the table of its polynomial (fixed value 0xEDB88320).
CRC32 = """
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM (SELECT DISTINCT doc_id FROM documents),
         (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""

#: The same for order 2 in DuckDB SQL.
ORACLE = rf"""
    WITH h AS ({CRC32}),
         d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(crc % 7 = 2, true) AS held_out,
                      list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents LEFT JOIN h USING (doc_id)),
         x AS (SELECT i, held_out, unnest(list_prepend('', w[:-2])) AS v, unnest(w) AS w FROM d),
         b AS (SELECT v, w, count(*) AS c FROM x WHERE NOT held_out GROUP BY ALL),
         u AS (SELECT w, sum(c) AS c, count(*) AS k FROM b GROUP BY w),
         f AS (SELECT v, sum(c) AS total, count(*) FILTER (c = 1) AS once, count(*) FILTER (c = 2) AS twice, count(*) FILTER (c > 2) AS more FROM b GROUP BY v),
         n AS (SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4, count(*) AS kinds FROM b),
         m AS (SELECT count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 4) AS n4, count(*) FILTER (k > 2) AS n3m, count(*) AS v, coalesce(sum(c), 0) AS n FROM u),
         a AS (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM n), e AS (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM m),
         s AS (SELECT 1 - 2 * a.y * a.n2 / a.n1 AS d1, 2 - 3 * a.y * a.n3 / a.n2 AS d2, 3 - 4 * a.y * a.n4 / a.n3 AS d3, 1 - 2 * e.y * e.n2 / e.n1 AS e1, 2 - 3 * e.y * e.n3 / e.n2 AS e2, 3 - 4 * e.y * e.n4 / e.n3 AS e3,
                      a.kinds, e.v, e.n, e1 * e.n1 + e2 * e.n2 + e3 * e.n3m AS rest FROM a, e),
         p AS (SELECT x.i, coalesce(u.c, 0) AS c, s.n, s.v, f.total,
                      (coalesce(u.k - CASE u.k WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, 0) + rest / (s.v + 1)) / s.kinds AS p1,
                      coalesce(b.c - CASE b.c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) AS left_over, d1 * f.once + d2 * f.twice + d3 * f.more AS kept
               FROM s, x LEFT JOIN u USING (w) LEFT JOIN f ON f.v = x.v LEFT JOIN b ON b.v = x.v AND b.w = x.w),
         r AS (SELECT i, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, sum(log10((c + 1)::DOUBLE / (n + v + 1))) AS base_score,
                      sum(log10(CASE WHEN total > 0 THEN (left_over + kept * p1) / total ELSE p1 END)) AS score FROM p GROUP BY i)
    SELECT doc_id, held_out, n_tokens, n_known, CAST(train_tokens AS BIGINT) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM r JOIN d USING (i)"""
