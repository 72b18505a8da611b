"""Near-duplicate classes by Order MinHash sketches and banded alignment."""

from __future__ import annotations

import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import components, lasting, slices, text_of, written

#: Words of a k-mer; least similarity; sketches of a text; k-mers of a sketch.
K, SIMILARITY, SKETCHES, TUPLE = 5, 0.8, 48, 4
#: Members outside a bucket's largest component beyond which it is split; cells of the table of k-mer frequencies.
SPLIT, CELLS = 4, 2**18
CACHE = 200_000


class Words(dict):
    """64-bit hashes of words without case and outer punctuation."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest((word.strip(string.punctuation) or word).encode())
        return h


def kmers(text: str, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, in order, and the number of equal runs before each; of a shorter text the one run of all its words."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    k = min(k, len(h))
    runs = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    runs ^= runs >> np.uint64(31)
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(runs))
    label = np.empty(len(runs), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return runs, label


def sketches(runs: np.ndarray, label: np.ndarray, seeds: np.ndarray, most: int) -> list[int]:
    """For each seed: the `most` k-mers of least seeded hash, in the order of the text, hashed to one number.

    Every other sketch takes only first occurrences, so that texts that
    differ in how often they repeat a phrase meet as well.
    """
    if not len(runs):
        return []
    out = np.empty(len(seeds), np.uint64)
    for half, from_ in enumerate((runs + label * np.uint64(0xD6E8FEB86659FD93), runs[label == 0])):
        own = seeds[half::2]
        mixed = (from_ ^ own[:, :1]) * own[:, 1:]
        mixed ^= mixed >> np.uint64(32)
        if len(from_) > most:
            least = np.sort(np.argpartition(mixed, most - 1, axis=1)[:, :most], axis=1)
        else:
            least = np.broadcast_to(np.arange(len(from_)), (len(own), len(from_)))
        h = own[:, 0].copy()
        for column in from_[least].T:
            h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[half::2] = h
    return out.view(np.int64).tolist()


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shared k-mers in common order, over all k-mers of either text; each text gives its distinct ones.

    The alignment is the longest common subsequence of the two k-mer
    sequences, inside the band of diagonals that a similarity of `least`
    leaves open: len(a) + len(b) - 2 L insertions and deletions at most.
    """
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (n + m) * (1 - least) / (1 + least) + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least / (1 + least) * (n + m) - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        length = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        length = len(tails)
    return length / (n + m - length)


def _sketched(docs: DataFrame, k: int, count: int, size: int) -> DataFrame:
    """docs (_text) with _sketches."""
    state = np.random.RandomState(20240229)
    seeds = np.stack([state.randint(1, 2**63, count, np.int64).astype(np.uint64), state.randint(1, 2**63, count, np.int64).astype(np.uint64) | np.uint64(1)], 1)
    kept = [c for c in docs.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lasting("words", Words)
        for batch in slices(batches):
            found = [sketches(*kmers(t, words, k), seeds, size) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.list_(pa.int64()))], [*kept, "_sketches"])

    kinds = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "_text")
    return docs.mapInArrow(run, f"{kinds}, _sketches array<long>")


def _kmer_table(docs: DataFrame, k: int) -> DataFrame:
    """(_v, _kmers, _size): each text's distinct k-mers in order of their first occurrence, 64 bits each, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lasting("words", Words)
        for batch in slices(batches):
            found = [runs[label == 0].tobytes() for runs, label in (kmers(t, words, k) for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array([len(x) // 8 for x in found], pa.int64())], ["_v", "_kmers", "_size"])

    return docs.mapInArrow(run, "_v binary, _kmers binary, _size long")


def _verified(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts align well enough."""
    both = pairs.join(table.withColumnsRenamed({"_v": "a", "_kmers": "_ka"}), "a").join(table.withColumnsRenamed({"_v": "b", "_kmers": "_kb"}), "b").select("a", "b", "_ka", "_kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                good.append(aligned_similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """buckets (_key, _v, _at, _size) of more than one component, with each member's component _c, whether that is the bucket's largest (_main), and the number _others of members outside it."""
    buckets = buckets.join(labels.withColumnsRenamed({"id": "_v", "component": "_l"}), "_v", "left").withColumn("_c", F.coalesce("_l", "_v")).drop("_l")
    parts = buckets.groupBy("_key", "_c").agg(F.count("*").alias("_n"))
    sizes = parts.groupBy("_key").agg(F.max_by("_c", F.struct("_n", "_c")).alias("_largest"), (F.sum("_n") - F.max("_n")).alias("_others")).where("_others > 0")
    return buckets.join(sizes, "_key").withColumn("_main", F.col("_c") == F.col("_largest")).drop("_largest")


def _crossing(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members (_key, _v, _c, _main, _at, _size) of a bucket from different components whose k-mers from _at on are enough for a similarity of `least`."""
    left = members.where("not _main").select(*[F.col(c).alias(f"{c}_a") for c in members.columns])
    right = members.select(*[F.col(c).alias(f"{c}_b") for c in members.columns])
    enough = F.least(F.col("_size_a") - F.col("_at_a"), F.col("_size_b") - F.col("_at_b")) >= (F.col("_size_a") + F.col("_size_b")) * (least / (1 + least)) - 1e-9
    meet = (F.col("_key_a") == F.col("_key_b")) & (F.col("_c_a") != F.col("_c_b")) & (F.col("_main_b") | (F.col("_v_a") < F.col("_v_b"))) & enough
    return left.join(right, meet).select(F.least("_v_a", "_v_b").alias("a"), F.greatest("_v_a", "_v_b").alias("b"))


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How often the k-mers of texts (_v, _kmers) fall into each of CELLS cells: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) % np.uint64(CELLS), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array([x.tobytes() for x in np.split(total, 64)])], ["_part", "_counts"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_part": parts["_part"][:1], "_counts": [sum(np.frombuffer(x, np.int64) for x in parts["_counts"]).tobytes()]})

    kinds = "_part long, _counts binary"
    parts = dict(map(tuple, texts.select("_kmers").mapInArrow(count, kinds).groupBy("_part").applyInPandas(add, kinds).collect()))
    return np.concatenate([np.frombuffer(parts.get(n, bytes(CELLS // 8)), np.int64) for n in range(64)])


def _prefixes(texts: DataFrame, least: float) -> DataFrame:
    """Buckets (_key, _v, _at, _size) of texts (_v, _kmers, _size) by k-mers, in which all pairs of similarity `least` meet.

    K-mers are put in order of their cell's frequency, then of hash. Texts of n
    k-mers that share `least` of them share one of the first n - least n + 1 in
    any order that holds for all texts; _at is its place. So a passage that many
    texts have brings only those together that have little else.
    """
    often = _frequencies(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = []
            for x in batch.column(1).to_pylist():
                own = np.frombuffer(x, np.uint64)
                most = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                keys.append(own[np.lexsort((own, often[own % np.uint64(CELLS)]))[:most]].view(np.int64))
            if keys:
                of = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                columns = [pa.array(np.concatenate(keys)), batch.column(0).take(of), pa.array(np.concatenate([np.arange(len(x)) for x in keys])), batch.column(2).take(of)]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_v", "_at", "_size"])

    return texts.select("_v", "_kmers", "_size").mapInArrow(run, "_key long, _v binary, _at long, _size long")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, similarity: float = SIMILARITY, count: int = SKETCHES, size: int = TUPLE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The near-duplicate class of each row: _id, _class (least id of the class), _component and _text_key (digests of a text of the class and of the row's own), carried columns as _carry_<name>.

    Two texts are linked if they share at least `similarity` of their distinct
    k-mers of words (without case and outer punctuation; white space separates
    words) in a common order, as the banded alignment counts them; a class is
    what the links connect, with identical texts.

    1. Identical texts are one vertex, by SHA-256, before anything else.
    2. Of each text, `count` Order MinHash sketches: the `size` k-mers, labelled
       by occurrence, of least hash, in the text's order (every other sketch
       from first occurrences only). Texts that share a sketch meet in a
       bucket. A pair of similarity 0.8 misses all of 48 sketches of 4 with
       probability 0.59 ** 48; if the two repeat phrases differently often, 0.59 ** 24.
    3. In each bucket all members are aligned with the one that meets most
       texts in all its buckets, as an original meets its copies; the links' components follow. A bucket of one component is done, so a group of
       thousands of near copies costs one comparison per member and sketch.
    4. In buckets with several components, members outside the largest one are
       aligned with all members of other components whose length allows the
       similarity. Buckets with more than SPLIT members outside, as a very common
       passage makes them, are dealt anew by the rarest k-mers of each text, one of
       which any two texts of that similarity share. So every pair that shares a
       bucket is aligned, linked through others, or cannot be similar enough.

    No step has a cap. Null or wordless text is linked to identical texts only. Ties, repeated rows
    and other columns have no influence. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    rows = rows.withColumn("_v", F.substring(F.unhex(F.sha2("_text", 256)), 1, 16))
    sketched = _sketched(rows.select("_v", "_text"), k, count, size)
    # a sketch's number in the list is part of its hash: equal hashes are equal sketches
    sketched = sketched.withColumn("_sketches", F.transform("_sketches", lambda h, i: F.xxhash64(h, i)))
    vertices = written(sketched.groupBy("_v").agg(F.any_value("_sketches").alias("_sketches")), "sketches")
    every = vertices.select("_v", F.explode("_sketches").alias("_key"))
    buckets = written(every.join(every.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1"), "_key"), "buckets")
    texts = rows.select("_v", "_text").join(buckets.select("_v").distinct(), "_v", "left_semi")
    table = written(_kmer_table(texts, k).dropDuplicates(["_v"]), "kmers")
    degrees = buckets.groupBy("_v").agg(F.sum("_n").alias("_degree"))
    buckets = buckets.select("_key", "_v")
    pivots = buckets.join(degrees, "_v").groupBy("_key").agg(F.max_by("_v", F.struct("_degree", "_v")).alias("_pivot"))
    spokes = buckets.join(pivots, "_key").where("_v <> _pivot").select(F.least("_v", "_pivot").alias("a"), F.greatest("_v", "_pivot").alias("b"))
    stars = written(spokes.distinct(), "stars")
    edges = written(_verified(stars, table, similarity), "links")
    labels = components(edges)
    sized = buckets.join(table.select("_v", "_size"), "_v").withColumn("_at", F.lit(0).cast("long"))
    open_ = written(_open(sized, labels), "open")
    pairs = _crossing(open_.where(F.col("_others") <= SPLIT), similarity)
    large = written(table.join(open_.where(F.col("_others") > SPLIT).select("_v").distinct(), "_v", "left_semi"), "large")
    dealt = written(_open(written(_prefixes(large, similarity), "prefixes"), labels), "dealt")
    pairs = pairs.union(_crossing(dealt, similarity)).distinct().join(stars, ["a", "b"], "left_anti")
    more = _verified(written(pairs, "crossing"), table, similarity)
    labels = components(written(edges.union(more), "links"))
    owner = rows.select("_id", "_v", *[f"_carry_{c}" for c in carry])
    owner = owner.join(labels.withColumnsRenamed({"id": "_v", "component": "_l"}), "_v", "left").withColumn("_c", F.coalesce("_l", "_v")).drop("_l")
    names = owner.groupBy("_c").agg(F.min("_id").alias("_class"))
    return owner.join(names, "_c").withColumnsRenamed({"_v": "_text_key", "_c": "_component"})


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each near-duplicate class, that of the least id; columns as they were.

    The texts meet the decisions once, by their digests. Null ids come last.
    """
    found = near_classes(docs, id_col, text_col, **options)
    place = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_text_key"))
    kept = found.groupBy("_component").agg(F.min(place).alias("_least")).select(F.col("_least._text_key").alias("_v"), F.col("_least._id").alias("_keep"))
    rows = docs.select(F.struct("*").alias("_doc"), F.substring(F.unhex(F.sha2(text_of(text_col), 256)), 1, 16).alias("_v"))
    stay = rows.join(written(kept, "kept"), "_v").where(F.col("_doc")[id_col].eqNullSafe(F.col("_keep"))).dropDuplicates(["_v"])
    return stay.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
