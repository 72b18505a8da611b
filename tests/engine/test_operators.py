"""Small cases of single operators, sources, plans and streams."""

import json

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import chunks as K
from docengine.operators import consolidation as C
from docengine.operators import evaluation as E
from docengine.operators import lines as L
from docengine.operators import questions as Q
from docengine.operators import retrieval as R
from docengine.operators import structure as S2
from docengine.plans.answering import decisions
from docengine.sources import files as S
from docengine.streaming.events import SCHEMA, new_chunks, read_events, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.strip_page_numbers(F.lit("12\n 3 \nabc\n4\n5"))) == "abc"
    assert one(spark, T.strip_page_numbers(F.lit("1\n2"))) == ""
    got = one(spark, T.normalized_page(F.lit("7\r\na b​  c-\nd\n\n\n\ne\x07 ")))
    assert got["text"] == "a b cd\n\ne"
    assert got["actions"] == [
        "normalized_line_endings", "normalized_nbsp", "removed_invisible_characters", "removed_control_characters", "recomposed_safe_hyphenation", "normalized_whitespace", "removed_isolated_page_number", "normalized_excess_blank_lines",
    ]
    assert one(spark, T.normalized_page(F.lit("x")))["actions"] == ["no_changes"]
    assert one(spark, T.fold_ascii(F.lit("Ação § 2º – ß"))) == "acao  2o  "
    assert one(spark, T.slug(F.lit("Capítulo 3: Da Fé"))) == "capitulo-3-da-fe" and one(spark, T.slug(F.lit("--"))) == "sem-chave"
    assert one(spark, T.truncated(F.lit("abcdef " * 20), 60)).endswith("CONTEXTO]")
    assert one(spark, T.roman_value(F.lit("XIV"))) == 14
    assert one(spark, T.compacted_citations(F.lit("a [3] b [1] c [3] d [9]"), F.lit(3))).asDict() == {"text": "a [1] b [2] c [1] d [9]", "numbers": [3, 1]}
    assert one(spark, T.without_trailing_offer(F.lit("Texto.\n\nSe quiser, posso detalhar."))) == "Texto."
    assert one(spark, T.upper_heading(F.lit("DAS DISPOSIÇÕES"))) and not one(spark, T.upper_heading(F.lit("CAPÍTULO IV")))
    assert one(spark, T.parent_key(F.lit("d"), article=F.lit("5"), paragraph=F.lit("1º"))) == "d::article::5::paragraph::1o"
    assert one(spark, T.parent_key(F.lit("d"), chapter_reference=F.lit("Cap. 2"))) == "d::chapter::cap-2"


@pytest.mark.parametrize(("line", "want"), [("§ 2º x", ("paragraph", "2º")), ("Parágrafo único. x", ("paragraph", "único")), ("i) x", ("alinea", "i")), ("iv - x", ("inciso", "IV")), ("XX - x", None)])
def test_item_marker(spark, line, want):
    got = one(spark, T.item_marker(F.lit(line)))
    assert (got and (got["kind"], got["value"])) == want


def test_merged_markers(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["§", "1º. a", "§", "§", "2º. b", "IV -", "c", "d"])], "document_id string, line_index int, line string")
    marker = (F.col("line") == "§") | F.col("line").rlike(r"^[IVXLCDM]{1,8}\s*[-–—]$")
    follower = (F.col("line") != "§") | F.col("_next").rlike(r"^[0-9]+[º°]?\.")
    got = [r["line"] for r in L.merged_markers(lines, marker, follower).orderBy("line_index").collect()]
    assert got == ["§ 1º. a", "§", "§ 2º. b", "IV - c", "d"]


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "question_id int, chunk_id string, rank int")


def test_fusion_and_rerank(spark):
    got = R.fuse([("vector", ranked(spark, "ab")), ("bm25", ranked(spark, "bc"))], k=3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"] and got[0]["sources"] == "bm25,vector"
    c = ranked(spark, ["low", "high", "medium"]).union(ranked(spark, ["low"]))
    score = F.when(F.col("chunk_id") == "high", 0.9).when(F.col("chunk_id") == "medium", 0.5).otherwise(0.1)
    got = R.rerank(c, score).orderBy("rank").collect()
    assert [(r["chunk_id"], r["pre_rerank_rank"]) for r in got] == [("high", 2), ("medium", 3), ("low", 1)]


def test_budget_skips_what_does_not_fit(spark):
    assert one(spark, L.greedy_fit(F.array(*map(F.lit, (5, 9, 3, 2))), 10)) == [1, 3, 4]
    assert one(spark, L.greedy_fit(F.array(F.lit(50), F.lit(1)), 10)) == [1]


def test_fitted_groups_over_many_batches(spark):
    sizes = [(q, i, (i * 37 + (q or 0)) % 23 if i % 5 else None) for q in (1, 2, None) for i in range(300)]
    rows = spark.createDataFrame(sizes, "q int, at int, n int")
    with_small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(with_small)
    spark.conf.set(with_small, "7")
    try:
        got = sorted((str(r["q"]), r["at"]) for r in C.fitted(rows, ["q"], "at", "n", 500).collect())
    finally:
        spark.conf.set(with_small, before)
    want = []
    for q in (1, 2, None):
        total = 0
        for g, i, n in sizes:
            if g == q and (i == 0 or total + (n or 0) <= 500):
                total += n or 0
                want.append((str(q), i))
    assert got == sorted(want)
    assert C.fitted(rows.where("false"), ["q"], "at", "n", 500).count() == 0


def test_forward_pairs(spark):
    marks = {"a": "LxRLRL", "b": "RRL", "c": "LLRRxL", "d": "LR"}
    lines = spark.createDataFrame([(d, i, x) for d, m in marks.items() for i, x in enumerate(m, 1)], "document_id string, line_index long, line string")
    want = set()
    for d, m in marks.items():
        for i in (i for i, x in enumerate(m, 1) if x == "L"):
            right = m.find("R", i) + 1
            if right:
                want.add((d, i, right, m.find("L", right) if "L" in m[right:] else len(m)))
    assert {tuple(r) for r in S2.forward_pairs(lines, F.col("line") == "L", F.col("line") == "R").collect()} == want


def test_consolidation(spark):
    rows = [(1, "p1", "d1", "a", 2.0, "expanded", "doctrinal", 1), (1, "p1", "d1", "b", 1.0, "anchor_only", "contextual", 3), (1, "p2", "d2", "c", 10.0, "anchor_only", "introductory", 1), (1, "p3", "d1", "d", 1.9, "expanded", "normative", 1)]
    g = C.grouped(spark.createDataFrame(rows, "question_id int, parent_key string, document_id string, chunk_id string, score double, status string, priority string, page int")).withColumn("doctrinal_query", F.lit(True))
    g = g.withColumn("ranking_score", C.ranking_score(F.col("best_score"), F.col("priority"), F.col("status"), F.lit(True), F.lit(False)))
    got = {r["parent_key"]: r for r in C.pruned(g).collect()}
    assert set(got) == {"p1", "p3"} and got["p1"]["chunk_ids"] == ["a", "b"] and (got["p1"]["page_start"], got["p1"]["page_end"]) == (1, 3)
    assert got["p1"]["ranking_score"] == pytest.approx(2 + 0.75 + 0.5 + 0.7)
    order = [r["parent_key"] for r in C.one_per_document(C.pruned(g)).orderBy("rank").collect()]
    assert order == ["p1", "p3"]


def test_evidence(spark):
    base = {"query": "O que ensina a expiação?", "context_count": 1, "total_chars": 900, "priorities": ["doctrinal"], "statuses": ["expanded"], "context_text": "o sangue de cristo", "has_source_map": True}
    cases = [({}, "sufficient_documentary_evidence"), ({"context_count": 0}, "no_context"), ({"total_chars": 10}, "context_too_short"), ({"has_source_map": False}, "missing_source_map"), ({"priorities": ["introductory"]}, "only_introductory_context"),
             ({"context_text": "outra coisa"}, "insufficient_query_context_overlap"), ({"priorities": ["normative"]}, "no_doctrinal_context"), ({"query": "isto nao esta no corpus"}, "requested_material_outside_active_corpus"),
             ({"statuses": ["anchor_only"], "priorities": ["contextual"]}, "only_anchor_context"), ({"query": "O que é?"}, "insufficient_query_specificity")]
    schema = "query string, context_count int, total_chars int, priorities array<string>, statuses array<string>, context_text string, has_source_map boolean, want string"
    rows = [tuple((base | c).values()) + (w,) for c, w in cases]
    for r in Q.evidence(spark.createDataFrame(rows, schema)).collect():
        assert r["reason"] == r["want"], r


def test_chunk_operators(spark):
    c = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n int, id string")
    assert [r["unique_id"] for r in K.unique_ids(c, "id", "n").orderBy("n").collect()] == ["x", "x_duplicata-02", "y"]
    e = K.eligible(spark.createDataFrame([("preface", None, None), ("special_layout", None, True), ("note", None, True)], "chunk_type string, content_role string, is_doctrinal boolean"))
    assert [(r["embedding_eligible"], r["embedding_exclusion_reason"]) for r in e.collect()] == [(False, "non_documentary_context_not_selected"), (False, "summary_or_non_retrievable_layout"), (True, None)]
    assert one(spark, E.join_unique(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a")))) == "a | b"


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps({"chunk_id": "a", "text": "x", "embedding_eligible": True}), "", json.dumps({"chunk_id": "b", "text": "y"}), "{broken"]))
    assert [r["chunk_id"] for r in S.read_chunks(spark, str(tmp_path / "c.jsonl")).orderBy("chunk_id").collect()] == ["a", "b"]
    assert [r["chunk_id"] for r in S.read_chunks(spark, str(tmp_path / "c.jsonl"), only_eligible=True).collect()] == ["a"]
    assert sorted(r["issue"] for r in S.broken_lines(spark, str(tmp_path / "c.jsonl")).collect()) == ["blank_line", "invalid_json"]
    for sep in ";,":
        (tmp_path / "q.csv").write_text("﻿" + sep.join(S.QUESTION_COLUMNS) + "\n" + sep.join([" 1 ", *"abcdefghi"]) + "\n")
        assert S.read_questions(spark, str(tmp_path / "q.csv")).first()["id"] == "1"
    (tmp_path / "p.txt").write_text("===== PAGE 1 =====\nfirst\n\n===== PAGE 2 =====\n")
    assert [(r["page_number"], r["text"], r["is_empty"]) for r in S.read_pages(spark, str(tmp_path / "p.txt")).orderBy("page_number").collect()] == [(1, "first", False), (2, "", True)]
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert sorted(map(tuple, S.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c")]


def test_plan(spark):
    rows = [(i, f"doc{i % 3}", f"p{i // 2}", i, "doctrinal_article", "catechism", f"batismo e graça texto{i} " * 40) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id int, document_id string, parent_key string, position int, chunk_type string, document_type string, text string")
    asked = spark.createDataFrame([(1, "O que ensina sobre batismo e graça texto3?"), (2, "zzz qqq")], "question_id int, text string")
    got = decisions(chunks, asked).collect()
    assert [(r["question_id"], r["can_answer"]) for r in got] == [(1, True)] and got[0]["context_count"] <= 4 and got[0]["total_chars"] <= 18_000


def test_plan_expands_parents(spark):
    """Small parents come whole, large ones with neighbours, lone chunks as anchors; questions without hits get a row."""
    word = lambda i: f"batismo graca alvo{i}"
    rows = [(1, "d1", "small", 1, word(1)), (2, "d1", "small", 2, "irma dois"), (3, "d1", "small", 3, "irma tres"), (4, "d2", "lone", 4, word(4))]
    rows += [(10 + i, "d3", "large", 10 + i, word(13) if i == 3 else f"parte{i} " + "x" * 3000) for i in range(6)] + [(30, "d4", "long", 30, word(30) + "z" * 20_000)]
    chunks = spark.createDataFrame([(*r[:4], "doctrinal_article", "catechism", r[4]) for r in rows], "chunk_id int, document_id string, parent_key string, position int, chunk_type string, document_type string, text string")
    asked = spark.createDataFrame([(1, "alvo1"), (4, "alvo4"), (13, "alvo13"), (30, "alvo30" + "z" * 20_000), (99, "zzz qqq")], "question_id int, text string")
    got = {r["question_id"]: r for r in decisions(chunks, asked, unanswered=True).collect()}
    assert got[1]["context_text"] == f"{word(1)}\n\nirma dois\n\nirma tres" and got[1]["statuses"] == ["expanded"]
    assert got[4]["context_text"] == word(4) and got[4]["statuses"] == ["anchor_only"]
    assert [x.split()[0] for x in got[13]["context_text"].split("\n\n")] == ["batismo", "parte2", "parte4"] and got[13]["total_chars"] == len(got[13]["context_text"])
    assert got[30]["total_chars"] == 18_000 and got[30]["context_text"].endswith("LIMITE DE CONTEXTO]")
    assert (got[99]["reason"], got[99]["can_answer"], got[99]["context_count"]) == ("no_context", False, 0)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", 1, "click", 1.5, "{}") for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = windowed_counts(read_events(spark, str(tmp_path / "events")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT window_start, event_type, n, total FROM counts").collect()))
    assert got == sorted(map(tuple, windowed_counts(spark.read.schema(SCHEMA).parquet(str(tmp_path / "events")), None).collect())) and len(got) == 3
    events.select(F.lit(1).cast("long").alias("chunk_id"), F.lit("x").alias("text"), F.col("ts").alias("at")).write.parquet(str(tmp_path / "chunks"), mode="append")
    chunks = spark.readStream.schema("chunk_id long, text string, at timestamp").parquet(str(tmp_path / "chunks"))
    q = new_chunks(chunks).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM once").count() == 1
