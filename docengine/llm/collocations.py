"""Frequent phrases and their cohesion by language: Toivonen's sampling with a negative border, counts exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import lasting, text_of, written
from docengine.llm.grams import PACKED, Splitter, batch_of, dealt, gathered, mixed, ranges, summed, text_slices

#: Words of the longest phrase, least occurrences, one in SAMPLE documents proposes, phrases with SAMPLE_LEAST occurrences there are proposed.
LONGEST, LEAST, SAMPLE, SAMPLE_LEAST = 4, 30, 8, 2
#: Bits of the set of proposed phrases that tasks hold: 8 MB at any size of the corpus. A false member is counted without need, and exactly.
BITS = 26
#: What parts two pieces of a text.
PARTING = b".,;:!?\n\x0b\x0c\r"
#: Phrases are named from one in NAMING documents, the rest from all.
NAMING = 16
#: Keys of phrases that a task remembers to have named.
NAMED = 3_000_000


def splitter() -> Splitter:
    return lasting("phrase words", lambda: Splitter(b" \t", PARTING))


class Slice:
    """The words of some documents in a row, and hashes of (language, phrase) by length for each first word."""

    def __init__(self, batches: list[pa.RecordBatch], longest: int):
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for b in batches for t in b.column(0)]
        self.langs = [x for b in batches for x in b.column(1).to_pylist()]
        self.data = b"\n".join(texts)
        x, self.start, self.end, piece = splitter()(self.data)
        self.document = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")
        known = {lang: xxhash.xxh3_64_intdigest(lang.encode(), seed=7) for lang in set(self.langs)}
        seeds = np.array([known[lang] for lang in self.langs], np.uint64)
        self.hash, self.valid = [], []
        for k in range(1, longest + 1):
            n = max(len(x) - k + 1, 0)
            self.hash.append(mixed(seeds[self.document], x) if k == 1 else mixed(self.hash[-1][:n], x[k - 1 :]))
            self.valid.append(piece[:n] == piece[k - 1 :])

    def phrase(self, i: int, k: int) -> str:
        return b" ".join(self.data[self.start[i] : self.end[i + k - 1]].lower().split()).decode()

    def inside(self, k: int, bits: np.ndarray) -> np.ndarray:
        """Where a phrase of k words begins whose first and whose last k - 1 words are both in the set."""
        h = self.hash[k - 2]
        known = has(bits, h)
        return self.valid[k - 1] & known[:-1] & known[1:] if len(h) > 1 else np.zeros(len(self.valid[k - 1]), bool)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_set(keys: DataFrame) -> np.ndarray:
    """The set of hashes as 2^BITS bits, or-ed in Spark; at most 2^(BITS - 6) numbers reach the driver."""
    at = F.shiftrightunsigned(F.col("key"), 64 - BITS)
    found = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITS}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(2 ** (BITS - 6), np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint8)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.encode(text_of(text_col), "UTF-8").alias("_bytes"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"))


def _drawn(docs: DataFrame, one_in: int, text_col: str, id_col: str) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64(F.col(id_col), F.length(text_of(text_col))), F.lit(one_in)) == 0)


def counted(rows: DataFrame, shards: int, least: int, longest: int = LONGEST, inside: Broadcast | None = None, known: Broadcast | None = None) -> DataFrame:
    """(k, key, f): phrases of k words that occur at least `least` times in the rows.

    With inside, only phrases of more than one word whose first and last k - 1 words are in that set, and all
    words; with known too, only those of them that were not counted under the set known.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in text_slices(batches):
            found, out = Slice(held, longest), []
            for k in range(1, longest + 1):
                if k == 1 or inside is None:
                    take = found.valid[k - 1] if known is None else np.zeros(0, bool)
                else:
                    take = found.inside(k, inside.value)
                    if known is not None:
                        take &= ~found.inside(k, known.value)
                if take.any():
                    keys, n = np.unique(found.hash[k - 1][take], return_counts=True)
                    out += dealt(k, keys, [keys, n], shards)
            del found
            yield batch_of(out)

    def add(table: pa.Table) -> pa.Table:
        out = []
        for k in range(1, longest + 1):
            if (found := gathered(table, k)) is not None:
                keys, (n,), _ = summed(found[0], [found[1]])
                often = n >= least
                out.append(pa.table({"k": np.full(int(often.sum()), k, np.int32), "key": keys[often].view(np.int64), "f": n[often].astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({"k": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "f": pa.array([], pa.int64())})

    return rows.mapInArrow(count, PACKED).groupBy("shard").applyInArrow(add, "k int, key long, f long")


def named(rows: DataFrame, members: Broadcast, longest: int = LONGEST) -> DataFrame:
    """(key, lang, phrase): the phrases in the set, each about once for each task that meets it."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for held in text_slices(batches):
            found = Slice(held, longest)
            for k in range(1, longest + 1):
                h = found.hash[k - 1]
                at = np.flatnonzero(found.valid[k - 1])
                at = at[has(members.value, h[at])]
                keys, first = np.unique(h[at], return_index=True)
                new = [(key, i) for key, i in zip(keys.view(np.int64).tolist(), at[first].tolist(), strict=True) if key not in seen]
                seen.update(key for key, _ in new)
                for a in range(0, len(new), 50_000):
                    part = new[a : a + 50_000]
                    columns = [pa.array([key for key, _ in part], pa.int64()), pa.array([found.langs[found.document[i]] for _, i in part], pa.string()), pa.array([found.phrase(i, k) for _, i in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "phrase"])
            if len(seen) > NAMED:
                seen.clear()
            del found

    return rows.mapInArrow(name, "key long, lang string, phrase string")


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """(k, key, f) of all phrases of 1 to `longest` words that occur at least `least` times in their language, written out.

    1. A sample (one in `sample` documents by hash) proposes the phrases that it holds at least sample_least times.
    2. One pass over all texts counts these and their negative border: all
       words, and the phrases that are not proposed but whose first and last
       k - 1 words are. Part of a phrase is never rarer than the phrase, so a frequent phrase not counted so
       contains one of the border that is frequent, too: a failure of the sample.
    3. While there are failures, they join the set, and a pass counts what they add to its border.

    The sample decides what a pass counts and how many passes there are, never the result.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows, shards = _rows(docs, text_col, lang_col), ranges(docs, text_col)
    bits = bit_set(counted(_rows(_drawn(docs, sample, text_col, id_col), text_col, lang_col), shards, sample_least, longest - 1))
    inside = sc.broadcast(bits)
    found = written(counted(rows, shards, least, longest, inside), "phrases")
    fresh = found
    while (more := bit_set(fresh.where(F.col("k") < longest)) & ~bits).any():
        known, bits = inside, bits | more
        inside = sc.broadcast(bits)
        fresh = written(counted(rows, shards, least, longest, inside, known), "phrases")
        found = found.unionByName(fresh)
    return found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """Phrases of 2 to `longest` words that occur at least `least` times: lang, phrase, k, a, l, r, n, score, and whether one is _covered.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends and
    those into words at blanks and tabs. a counts the phrase in its language,
    n all words there. Each cut into a first part that occurs l times and a
    rest that occurs r times scores floor(2000000 a / (l + r)); the lowest
    counts, of equal ones that after the fewest words. A phrase is covered if a longer one that contains
    it occurs at least 0.8 times as often.

    Counts are exact up to collisions of 64-bit hashes of (language, phrase).
    Tasks hold the sets of phrases as 2^BITS bits; counts are added up by
    ranges of the hash, whose number follows the size of the texts, so no
    frequent phrase or language meets in one task. Frequent phrases get their texts from one in
    NAMING documents, what is not found there from all.

    Null text counts as empty, null lang as und. Repeated rows count each. An
    empty table, or texts without repeated phrases, give no rows. Columns
    beside those named have no influence.
    """
    sc = docs.sparkSession.sparkContext
    counts = frequent(docs, text_col, lang_col, id_col, least, longest, sample, sample_least)
    rows = _rows(docs, text_col, lang_col)
    of = lambda frame, wanted: frame.groupBy("key").agg(F.first(F.struct("lang", "phrase")).alias("_of")).join(wanted, "key").select("key", "k", "f", "_of.*")
    some = written(of(named(_rows(_drawn(docs, NAMING, text_col, id_col), text_col, lang_col), sc.broadcast(bit_set(counts)), longest), counts), "names")
    rest = counts.join(some.select("key"), "key", "left_anti")
    phrases = some.unionByName(written(of(named(rows, sc.broadcast(bit_set(rest)), longest), rest), "names"))
    in_lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    words = docs.select(in_lang, F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+")).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    split = F.split("phrase", " ")
    part = lambda begin, length: F.array_join(F.slice(split, begin, length), " ")
    count = lambda c: phrases.select("lang", F.col("phrase").alias(f"_{c}"), F.col("f").alias(c))
    longer_than_one = phrases.where("k > 1").select("key", "lang", "phrase", "k", F.col("f").alias("a"))
    cuts = longer_than_one.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("_l", part(F.lit(1), F.col("cut"))).withColumn("_r", part(F.col("cut") + 1, F.col("k")))
    scored = cuts.join(count("l"), ["lang", "_l"]).join(count("r"), ["lang", "_r"])
    scored = scored.withColumn("score", F.expr("2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)"))
    worst = scored.groupBy("key", "lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_worst"))
    longer = phrases.where("k > 2").select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k")))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    out = worst.join(longer, ["lang", "phrase"], "left").join(words, "lang")
    covered = F.coalesce(F.col("_longer") >= F.col("a") - F.floor(F.col("a") / 5), F.lit(False))  # 5 f >= 4 a, without overflow
    return out.select("lang", "phrase", "key", "k", "a", "_worst.l", "_worst.r", "n", "_worst.score", covered.alias("_covered"))


def best(found: DataFrame, most: int = 2_000, deals: int = 64) -> DataFrame:
    """The first `most` phrases of each language that are not covered, by score, then count, then phrase, with rank (from 1): first of each deal of a language, then of the language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt_out = found.where("not _covered").withColumn("_deal", F.pmod("key", F.lit(deals)))
    first = dealt_out.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).where(F.col("_at") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


ORACLE = rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
         p AS (SELECT lang, i, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
         w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
         n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
         g AS (SELECT lang, k, array_to_string(phrase, ' ') AS phrase, phrase AS words, f FROM (
                 SELECT lang, k, w[s:s + k - 1] AS phrase, count(*) AS f
                 FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL) WHERE f >= {LEAST}),
         c AS (SELECT g.lang, g.k, g.phrase, g.f AS a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * g.f) // (l.f + r.f) AS score
               FROM (SELECT *, unnest(range(1, k)) AS cut FROM g WHERE k > 1) g
               JOIN g l ON l.lang = g.lang AND l.phrase = array_to_string(g.words[1:cut], ' ') JOIN g r ON r.lang = g.lang AND r.phrase = array_to_string(g.words[cut + 1:], ' ')),
         m AS (SELECT lang, phrase, any_value(a) AS a, arg_min(l, cut) AS l, arg_min(r, cut) AS r, any_value(score) AS score
               FROM (SELECT *, min(score) OVER (PARTITION BY lang, phrase) AS lowest FROM c) WHERE score = lowest GROUP BY lang, phrase),
         o AS (SELECT lang, array_to_string(words[s:s + j - 1], ' ') AS phrase, max(f) AS longer
               FROM (SELECT *, unnest(range(1, k - j + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS j FROM g WHERE k > 2)) GROUP BY ALL),
         t AS (SELECT m.*, n.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
               FROM m JOIN n USING (lang) LEFT JOIN o USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 80 * a, false))
    SELECT lang, rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000"""
