"""Retrieval with filters by question against plain Python, at sizes that force blocks, dropped candidates and the join."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docengine.operators import retrieval as R

WORDS = "igreja graça fé norma artigo membro the of und la".split()


def data(seed, n=150, q=9):
    draw = random.Random(seed)
    say = lambda k: " ".join(draw.choice(WORDS) for _ in range(draw.randrange(k)))
    chunks = [(i, say(14), draw.choice(["a", "b", None]), draw.choice(["x", "y"])) for i in range(n)]
    questions = [(i, say(6), draw.choice(["a", "b", "none", None]), draw.choice(["x", None])) for i in range(q)]
    return chunks, questions


def plain_bm25(chunks, questions, k, filtered):
    out = {}
    for q, text, *wanted in questions:
        mine = [c for c in chunks if not filtered or all(w is None or w == v for w, v in zip(wanted, c[2:], strict=True))]
        if not mine:
            continue
        words = {c[0]: re.findall(r"\w+", c[1]) for c in mine}
        mean = sum(map(len, words.values())) / len(mine)
        df = Counter(w for ws in words.values() for w in set(ws))
        idf = {w: math.log(len(mine) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf) if idf else 0
        idf = {w: floor if v < 0 else v for w, v in idf.items()}
        asked = [w for w in re.findall(r"\w+", text) if w in idf]
        scores = []
        for c, ws in words.items():
            tf = Counter(ws)
            if any(tf[w] for w in asked):
                scores.append((-round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in asked), 6), c))
        for rank, (s, c) in enumerate(sorted(scores)[:k], 1):
            out[q, rank] = (c, round(-s, 5))
    return out


@pytest.mark.parametrize("cells, held, filtered", [(2**23, 200_000, True), (12, 7, True), (40, 3, False), (0, 5, True), (0, 5, False)])
def test_bm25(spark, monkeypatch, cells, held, filtered):
    """cells 0: the batch is joined by word."""
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "NUMBERS", 30)
    chunks, questions = data(cells + held)
    c, q = spark.createDataFrame(chunks, "chunk_id int, text string, one string, two string"), spark.createDataFrame(questions, "question_id int, text string, one string, two string")
    got = R.bm25(c.repartition(3), q, 5, ("one", "two") if filtered else ()).collect()
    assert {(r["question_id"], r["rank"]): (r["chunk_id"], round(r["score"], 5)) for r in got} == plain_bm25(chunks, questions, 5, filtered)


@pytest.mark.parametrize("cells, held", [(2**23, 200_000), (20, 6)])
def test_dense(spark, monkeypatch, cells, held):
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "NUMBERS", 16)
    draw = random.Random(5)
    vector = lambda: [round(draw.uniform(-1, 1), 2) for _ in range(4)]
    rows = [(f"c{i:03}", vector(), draw.choice(["a", "b"])) for i in range(60)] + [("c000b", [1.0, 0.0, 0.0, 0.0], "a"), ("c000a", [2.0, 0.0, 0.0, 0.0], "a")]
    asked = [(i, vector(), draw.choice(["a", "b", None, "none"])) for i in range(12)] + [(99, [1.0, 0.0, 0.0, 0.0], None)]
    got = R.dense(spark.createDataFrame(rows, "chunk_id string, vector array<double>, kind string").repartition(3), spark.createDataFrame(asked, "question_id int, vector array<double>, kind string"), 4, filters=("kind",)).collect()
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {}
    for q, v, kind in asked:
        near = sorted((round(1 - cosine(v, w), 6) + 0.0, c) for c, w, k in rows if kind is None or k == kind)
        want |= {(q, n): c for n, (_, c) in enumerate(near[:4], 1)}
    assert {(r["question_id"], r["rank"]): r["chunk_id"] for r in got} == want and want[99, 1] == "c000a"


def test_what_a_task_makes_at_once(monkeypatch):
    """A search makes tables of at most NUMBERS cells whatever the numbers of rows and questions, looks up WORDS words at once, and drops candidates once for each HELD that come."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(R, "NUMBERS", 64)
    monkeypatch.setattr(R, "WORDS", 50)
    monkeypatch.setattr(R, "HELD", 100)

    class Rows:
        """Stands for a table: runs the operator's task on one batch of 400 rows, and keeps its scorer."""

        dtypes = [("chunk_id", "bigint")]

        def __init__(self, *columns):
            self.batch = pa.RecordBatch.from_arrays([pa.array(range(400)), *map(pa.array, columns)], ["chunk_id", "x", "_gs"])
            self.sparkSession = self.sparkContext = self

        def broadcast(self, value):
            return type("Shared", (), {"value": value})

        def mapInArrow(self, run, _):
            return pa.Table.from_batches(list(run(iter([self.batch]))))

    cells, drops, scored, before = [], [], R._scored, pa.concat_tables

    def watched(rows, kinds, score, ids, k, ascending):
        def counted(batch):
            for part in score(batch):
                cells.append(part[2].size)
                yield part

        return scored(rows, kinds, counted, ids, k, ascending)

    monkeypatch.setattr(R, "_scored", watched)
    monkeypatch.setattr(R.pa, "concat_tables", lambda tables: drops.append(1) or before(tables))
    draw = np.random.default_rng(3)
    vectors, asked = draw.normal(size=(400, 3)), draw.normal(size=(150, 3))
    found = R._near(Rows(vectors.tolist(), [[0]] * 400), pa.table({"question_id": range(150), "vector": asked.tolist(), "_g": [0] * 150}), "", 5).to_pylist()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(1 - unit(vectors) @ unit(asked).T, axis=0)[:5]
    assert {(r["question_id"], r["chunk_id"]) for r in found} == {(q, int(c)) for q in range(150) for c in best[:, q]}
    assert max(cells) <= 64 and len(drops) <= 150 * 400 // 100 // 10  # 750 candidates stay: each drop waits for 100 others
    cells.clear()

    class Weighed:
        dtypes = [("question_id", "int")]

        def toArrow(self):
            return pa.table({"question_id": [0, 1, 1], "term": ["a", "a", "b"], "_g": [0, 0, 0], "weight": [1.0, 0.5, 2.0], "mean": [9.0] * 3})

    sizes, unique = [], np.unique
    monkeypatch.setattr(R.np, "unique", lambda x, **o: sizes.append(len(x)) or unique(x, **o))
    texts = [["a"] * (i % 7) + ["b"] * (i % 3) + ["c"] * (i % 5) for i in range(400)]
    found = R._scored_words(Rows(texts, [[0]] * 400), Weighed(), 400).to_pylist()
    assert len(found) == sum("a" in t for t in texts) + sum("a" in t or "b" in t for t in texts) and max(sizes) <= 50 and max(cells) <= 64 * 2


def test_nothing_asked_and_nothing_there(spark):
    c, q = spark.createDataFrame([(1, "a b")], "chunk_id int, text string"), spark.createDataFrame([(1, "zz"), (2, None)], "question_id int, text string")
    assert R.bm25(c, q).count() == 0 and R.bm25(c.limit(0), q).count() == 0 and R.bm25(c, q.limit(0)).count() == 0
    v = spark.createDataFrame([(1, [1.0])], "chunk_id int, vector array<double>")
    assert R.dense(v, v.limit(0).withColumnRenamed("chunk_id", "question_id")).count() == 0


def test_merged_filters(spark):
    given = F.create_map(F.lit("document_id"), F.lit("d"), F.lit("corpus_id"), F.lit("other"), F.lit("chunk_type"), F.lit(None).cast("string"))
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(R.merged_filters(given, R.DEFAULT_FILTERS)) == R.DEFAULT_FILTERS | {"document_id": "d"}
    assert one(R.merged_filters(F.lit(None).cast("map<string,string>"), R.DEFAULT_FILTERS)) == R.DEFAULT_FILTERS and one(R.merged_filters(given, {})) == {"document_id": "d", "corpus_id": "other"}
    row = R.filter_columns(spark.range(1).withColumn("f", given), "f", ("document_id", "chunk_type", "none")).first()
    assert (row["document_id"], row["chunk_type"], row["none"]) == ("d", None, None)
