"""Lexical and dense retrieval, fusion and reranking for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Cells of a table of questions that goes to the tasks; numbers that a task makes at once; words of chunks that it looks up at once; candidates it takes up before it drops all but the best.
CELLS, NUMBERS, WORDS, HELD = 2**23, 2**19, 2**19, 200_000
#: Filters of every search (fixed values); a question cannot lift them.
DEFAULT_FILTERS = {"corpus_id": "reformed_congregational_corpus_v1", "retrieval_namespace": "alliance"}


def top(rows: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their place; Spark drops others before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def merged_filters(given: Column, defaults: dict[str, str]) -> Column:
    """A question's filters (a map) with the defaults: filters without a value go, and those that contradict a default."""
    fixed = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda key, value: value.isNotNull() & ~F.map_contains_key(fixed, key))
    return F.map_concat(fixed, own)


def filter_columns(questions: DataFrame, given: str, names: tuple[str, ...]) -> DataFrame:
    """Questions with one column for each name, the value that their filters (a map) ask for; null asks for nothing."""
    return questions.withColumns({n: F.try_element_at(given, F.lit(n)) for n in names})


def _sorted_out(questions: DataFrame, filters: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Questions with _g, a number for what they filter by, and of a chunk the numbers whose filters it meets.

    Filters are equalities. What questions of a stated batch ask for is a small table; each chunk looks its values up in it, by column, and
    keeps the numbers that all columns allow. Without filters there is one number, 0.
    """
    if not filters:
        return questions.withColumn("_g", F.lit(0)), F.array(F.lit(0))
    asked = sorted({tuple(r) for r in questions.select(*filters).distinct().collect()}, key=str)
    table = questions.sparkSession.createDataFrame([(*a, i) for i, a in enumerate(asked)], questions.select(*filters, F.lit(0).alias("_g")).schema)
    numbered = questions.join(F.broadcast(table.select(*[F.col(f).alias(f"_f{i}") for i, f in enumerate(filters)], "_g")), reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_f{i}")) for i, f in enumerate(filters)]))
    allowed = None
    for i, f in enumerate(filters):
        by_value: dict = {}
        for g, values in enumerate(asked):
            by_value.setdefault(values[i], []).append(g)
        free = F.array(*map(F.lit, by_value.pop(None, []))).cast("array<int>")
        known = F.create_map(*[x for value, gs in by_value.items() for x in (F.lit(value), F.array(*map(F.lit, gs)))]) if by_value else None
        mine = free if known is None else F.concat(F.coalesce(F.try_element_at(known, F.col(f)), F.array().cast("array<int>")), free)
        allowed = mine if allowed is None else F.array_intersect(allowed, mine)
    return numbered.drop(*[f"_f{i}" for i in range(len(filters))]), allowed


def _scored(rows: DataFrame, kinds: str, score, ids: pa.Array, k: int, ascending: bool) -> DataFrame:
    """question_id, chunk_id, score: the k best chunks of each question, of what a task reads.

    score gives, for a batch of rows (chunk_id first), blocks (rows, questions, values, which of them count). A task holds the
    candidates that are no worse than a question's k-th so far, drops all others whenever HELD more have come, and gives out what is left at its end.
    """
    sign = 1.0 if ascending else -1.0

    def best(held: list[pa.Table]) -> pa.Table:
        every = pa.concat_tables(held).sort_by([("of", "ascending"), ("key", "ascending"), ("chunk_id", "ascending")])
        of = every["of"].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        place = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
        return every.filter(pa.array(place < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most, worst = [], 0, HELD, np.full(len(ids), np.inf)
        for batch in batches:
            for row, question, values, there in score(batch):
                key = np.round(sign * values, 6)
                at, of = np.nonzero(there & (key <= worst[question][None, :]))
                if not len(at):
                    continue
                held.append(pa.table({"of": question[of].astype(np.int32), "key": key[at, of], "chunk_id": batch.column(0).take(pa.array(row[at]))}))
                size += len(at)
                if size > most:
                    held = [best(held)]
                    size = len(held[0])
                    most = size + HELD
                    of, key = held[0]["of"].to_numpy(), held[0]["key"].to_numpy()
                    last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if size else np.zeros(0, np.int64)
                    full = np.bincount(of, minlength=len(ids))[of[last]] == k
                    worst[of[last[full]]] = key[last[full]]
        if held:
            found = best(held).combine_chunks()
            for part in found.to_batches(10_000):
                yield pa.RecordBatch.from_arrays([ids.take(part.column(0)), part.column(2), pa.array(sign * part.column(1).to_numpy())], ["question_id", "chunk_id", "score"])

    return rows.mapInArrow(run, kinds)


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 10, filters: tuple[str, ...] = ()) -> DataFrame:
    """question_id, chunk_id, score, rank: the k chunks of each question with the best Okapi BM25 score.

    chunks (chunk_id, text), questions (question_id, text), both with the columns of filters: a
    question looks only at chunks whose values equal its own, and their statistics are the ones that count; null asks for nothing.
    Question words count as often as they occur; negative idf becomes EPSILON times the
    mean idf. Ties go to the smaller id. Questions with fewer than k chunks that share
    a word have fewer rows: chunks without one score 0 and are not ranked.

    Frequencies in documents are one count by filter and word, of the vocabulary's size, which also holds the
    number of chunks and words. The questions are a stated batch: in blocks, tables of words by questions of up to CELLS cells, they go to the tasks,
    which score each chunk where it is, so that no pair of
    chunk and word is shuffled. A batch of more than CELLS words is joined by word.
    """
    questions, allowed = _sorted_out(questions.select("question_id", "text", *filters), filters)
    words = chunks.select("chunk_id", tokens("text").alias("words"), allowed.alias("_gs")).where(F.size("_gs") > 0)
    # the empty word stands for the chunk itself: as often as there are chunks, with the words of all
    once = words.select(F.size("words").alias("size"), F.explode("_gs").alias("_g"), "words").select("size", "_g", F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("term"))
    counts = once.groupBy("_g", "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("size"))).alias("size"))
    totals = counts.where("term = ''").select("_g", F.col("df").alias("n"), (F.col("size") / F.col("df")).alias("mean"))
    df = counts.where("term <> ''").join(totals, "_g").select("_g", "term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"), "mean")
    floor = df.groupBy("_g").agg((F.avg("idf") * EPSILON).alias("floor"))
    asked = questions.select("question_id", "_g", F.explode(tokens("text")).alias("term")).groupBy("question_id", "_g", "term").agg(F.count("*").alias("times"))
    weighed = asked.join(df, ["_g", "term"]).join(floor, "_g").select("question_id", "_g", "term", (F.col("times") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("weight"), "mean")
    if asked.count() <= CELLS:
        scores = _scored_words(words, weighed, k)
    else:
        tf = words.select("chunk_id", "_gs", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("chunk_id", "_gs", "length", "term").agg(F.count("*").alias("tf"))
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        scores = weighed.join(tf, "term").where(F.array_contains("_gs", F.col("_g"))).groupBy("question_id", "chunk_id").agg(F.sum(part).alias("score"))
    return top(scores.withColumn("score", F.round("score", 6)), "question_id", [F.desc("score"), F.asc("chunk_id")], k)


def _scored_words(words: DataFrame, weighed: DataFrame, k: int) -> DataFrame:
    """Scores of the best chunks by a table of (question, word) weights that the tasks hold in blocks of questions."""
    table = weighed.toArrow()
    kinds = f"question_id {dict(weighed.dtypes)['question_id']}, chunk_id {dict(words.dtypes)['chunk_id']}, score double"
    coded, terms = (table.column(c).combine_chunks().dictionary_encode() for c in ("question_id", "term"))
    ids, known = coded.dictionary, {t: i for i, t in enumerate(terms.dictionary.to_pylist())}
    if not known:
        return words.sparkSession.createDataFrame([], kinds)
    question, term = coded.indices.to_numpy(), terms.indices.to_numpy()
    group, weight, mean = (table.column(c).to_numpy() for c in ("_g", "weight", "mean"))
    wide = max(1, CELLS // len(known))
    blocks = []
    for g in np.unique(group):
        of_g = np.unique(question[group == g])
        for at in range(0, len(of_g), wide):
            mine = of_g[at : at + wide]
            rows = (group == g) & np.isin(question, mine)
            own, place = np.unique(term[rows], return_inverse=True)
            matrix, asks = np.zeros((len(own), len(mine))), np.zeros((len(own), len(mine)), bool)
            matrix[place, np.searchsorted(mine, question[rows])] = weight[rows]
            asks[place, np.searchsorted(mine, question[rows])] = True
            number = np.full(len(known), -1)
            number[own] = np.arange(len(own))
            blocks.append((int(g), float(mean[rows][0]), mine, matrix, number, None if (weight[rows] > 0).all() else asks))
    shared = words.sparkSession.sparkContext.broadcast((known, blocks))

    def score(batch: pa.RecordBatch) -> Iterator[tuple]:
        end = np.cumsum(batch.column(1).value_lengths().to_numpy(), dtype=np.int64)
        at = 0
        while at < len(end):  # rows with about WORDS words between them
            upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + WORDS, "right")))
            for row, *found in of_slice(batch.slice(at, upto - at)):
                yield row + at, *found
            at = upto

    def of_slice(batch: pa.RecordBatch) -> Iterator[tuple]:
        known, blocks = shared.value
        held, groups = batch.column(1), batch.column(2)
        lengths = held.value_lengths().to_numpy()
        flat = held.flatten().dictionary_encode()
        number = np.array([known.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1])[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(lengths)), lengths)
        pair, tf = np.unique((of * len(known) + number)[number >= 0], return_counts=True)
        row, word = pair // len(known), pair % len(known)
        in_row, in_group = np.repeat(np.arange(len(groups)), groups.value_lengths().to_numpy()), groups.flatten().to_numpy()
        for g, mean, questions, matrix, place, asks in blocks:
            mine = np.zeros(len(lengths), bool)
            mine[in_row[in_group == g]] = True
            use = mine[row] & (place[word] >= 0)
            r, w, t = row[use], place[word[use]], tf[use]
            part = t * (K1 + 1) / (t + K1 * (1 - B + B * lengths[r] / mean))
            step = max(1, NUMBERS // matrix.shape[1])
            begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
            end = np.append(begin[1:], len(r))
            at = 0
            while at < len(begin):  # rows with about `step` words between them
                upto = max(at + 1, int(np.searchsorted(end, begin[at] + step, "right")))
                a, b = begin[at], end[upto - 1]
                cut = begin[at:upto] - a
                values = np.add.reduceat(part[a:b, None] * matrix[w[a:b]], cut)
                there = values > 0 if asks is None else np.logical_or.reduceat(asks[w[a:b]], cut)
                yield r[begin[at:upto]], questions, values, there
                at = upto

    return _scored(words, kinds, score, ids, k, False)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(vectors: DataFrame, questions: DataFrame, k: int = 10, where: Column | None = None, filters: tuple[str, ...] = ()) -> DataFrame:
    """question_id, chunk_id, distance, rank: the k nearest vectors of each question by cosine distance, exact.

    vectors (chunk_id, vector), questions (question_id, vector), both with the columns of filters: a question looks only
    at vectors whose values equal its own, null asks for nothing. Filters come before anything is ranked; where sifts the vectors for all.

    The questions are a stated set. In blocks of about CELLS numbers they go to the tasks, one pass over the vectors for
    each; a task multiplies its Arrow batches with a block and holds the best k of each question.
    """
    vectors = vectors if where is None else vectors.where(where)
    size = questions.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()["n"]
    questions, allowed = _sorted_out(questions.select("question_id", "vector", *filters), filters)
    rows = vectors.select("chunk_id", "vector", allowed.alias("_gs")).where(F.size("_gs") > 0)
    kinds = f"question_id {dict(questions.dtypes)['question_id']}, chunk_id {dict(rows.dtypes)['chunk_id']}, score double"
    blocks = -(-size // CELLS)
    found = vectors.sparkSession.createDataFrame([], kinds)
    for n in range(blocks):
        block = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == n)
        found = found.unionByName(_near(rows, block.toArrow(), kinds, k))
    return top(found.select("question_id", "chunk_id", F.round("score", 6).alias("distance")), "question_id", [F.asc("distance"), F.asc("chunk_id")], k)


def _near(rows: DataFrame, asked: pa.Table, kinds: str, k: int) -> DataFrame:
    if not len(asked):
        return rows.sparkSession.createDataFrame([], kinds)
    wanted = asked.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), -1)
    ids, group = asked.column("question_id").combine_chunks(), asked.column("_g").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((wanted / np.linalg.norm(wanted, axis=1, keepdims=True), [(int(g), np.flatnonzero(group == g)) for g in np.unique(group)]))

    def score(batch: pa.RecordBatch) -> Iterator[tuple]:
        wanted, groups = shared.value
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        in_row, in_group = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy()), batch.column(2).flatten().to_numpy()
        for g, questions in groups:
            mine = in_row[in_group == g]
            wide = min(len(questions), isqrt(NUMBERS))
            for first in range(0, len(questions), wide):
                some = questions[first : first + wide]
                aim = wanted[some].T
                for at in range(0, len(mine), NUMBERS // wide):
                    part = mine[at : at + NUMBERS // wide]
                    values = 1 - v[part] @ aim
                    yield part, some, values, np.ones(values.shape, bool)

    return _scored(rows, kinds, score, ids, k, True)


def fuse(lists: list[tuple[str, DataFrame]], rrf_k: int = 60, k: int = 10) -> DataFrame:
    """question_id, chunk_id, score, sources, rank: reciprocal-rank fusion of ranked lists (name, rows with rank).

    Ties go to the chunk of the earlier list and rank, as they were first seen.
    """
    every = None
    for place, (name, rows) in enumerate(lists):
        part = rows.select("question_id", "chunk_id", F.col("rank").alias("_r"), F.lit(place).alias("_list"), F.lit(name).alias("_name"))
        every = part if every is None else every.unionByName(part)
    found = every.groupBy("question_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("_r"))), 8).alias("score"), F.min(F.struct("_list", "_r")).alias("_seen"), F.array_join(F.sort_array(F.collect_set("_name")), ",").alias("sources")
    )
    return top(found, "question_id", [F.desc("score"), F.asc("_seen"), F.asc("chunk_id")], k).drop("_seen")


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def overlap_score(question: Column, text: Column) -> Column:
    """Part of a question's distinct words that a text holds: the scorer where no neural one is given."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))) / F.size(asked)).otherwise(F.lit(0.0))


def reranker_text(text: Column, labels: list[tuple[str, Column]], most: int = 3500) -> Column:
    """Labelled metadata lines and the text, cut."""
    lines = [F.when(F.nullif(c.cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in labels]
    return F.regexp_replace(F.concat_ws("\n", *lines, text).substr(1, most), r"\s+\z", "")


def rerank(candidates: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """Candidates (question_id, chunk_id, rank ...) by a new score; ties keep their former order. Adds rerank_score and pre_rerank_rank."""
    once = first_of_each(candidates, ["question_id", "chunk_id"], [F.asc("rank")])
    scored = once.withColumn("rerank_score", F.round(score, 6)).withColumnRenamed("rank", "pre_rerank_rank")
    return top(scored, "question_id", [F.desc("rerank_score"), F.asc("pre_rerank_rank")], k)


def rank_changes(rows: DataFrame) -> DataFrame:
    """Per question: how many moved up, down or not, and by how much at most."""
    gain = F.col("pre_rerank_rank") - F.col("rank")
    return rows.groupBy("question_id").agg(
        F.count_if(gain > 0).alias("moved_up"), F.count_if(gain < 0).alias("moved_down"), F.count_if(gain == 0).alias("unchanged"), F.max(gain).cast("long").alias("max_gain"), F.min(gain).cast("long").alias("max_loss")
    )
