"""The whole way of questions: scope and its retry, fusion, reranking and its disabled form, contexts, budget, decisions."""

import pytest
from pyspark.sql import functions as F

from docengine.plans import flow

CHUNKS = (
    "chunk_id int, document_id string, parent_key string, position int, chunk_type string, document_type string, section_title string, chapter_reference string, is_item boolean, reference string, page_start int, page_end int, text string"
)
ALIASES = (("doc-a", "A", ("confissao antiga",)), ("doc-b", "B", ("catecismo novo",)), ("doc-none", "N", ("regimento vazio",)))
TEXT = "a graca salvadora pela fe somente justifica batismo regeneracao eleicao " * 12


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "doc-a", "doc-a::article::1", 1, TEXT + "primeiro"), (2, "doc-a", "doc-a::article::1", 2, TEXT + "segundo"), (3, "doc-b", "doc-b::article::1", 3, TEXT + "terceiro"), (4, "doc-b", "doc-b::article::2", 4, "outra norma " * 80), (5, "doc-c", "doc-c::chunk::5", 5, "quinto sozinho " * 60)]
    return spark.createDataFrame([(*r[:4], "doctrinal_article", "catechism", None, None, False, f"Art. {r[0]}", r[0], None, r[4]) for r in rows], CHUNKS)


@pytest.fixture(scope="module")
def questions(spark):
    texts = ["batismo regeneracao eleicao graca", "batismo na confissao antiga", "batismo no regimento vazio", "zzz qqq", "quinto sozinho", None]
    return spark.createDataFrame(list(enumerate(texts, 1)), "question_id int, text string")


def test_packages(chunks, questions):
    got = {r["question_id"]: r for r in flow.answer_packages(chunks, questions, aliases=ALIASES).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    one = got[1]
    assert one["context_count"] == 2 and {p.split("::")[0] for p in one["parents"]} == {"doc-a", "doc-b"} and one["can_answer"] and one["total_chars"] <= 18_000 and len(one["sources"]) == 2
    assert (got[2]["scope_document"], got[2]["parents"], got[2]["attempt"]) == ("doc-a", ["doc-a::article::1"], 1)
    assert (got[3]["scope_document"], got[3]["attempt"]) == ("doc-none", 2) and got[3]["context_count"] == 2
    assert all((got[i]["context_count"], got[i]["reason"], got[i]["parents"]) == (0, "no_context", []) for i in (4, 6))
    assert got[5]["statuses"] == ["anchor_only"] and got[5]["parents"] == ["doc-c::chunk::5"] and got[5]["sources"] == ["[1] doc-c, p. 5."]


def test_budget_and_given_filter(chunks, questions):
    asked = questions.where("question_id = 1").withColumn("only", F.lit("doc-b"))
    got = flow.answer_packages(chunks, asked, aliases=ALIASES, given="only", most_chars=900).head()
    assert got["parents"] == ["doc-b::article::1"] and got["total_chars"] == 900 and got["context_text"].endswith("LIMITE DE CONTEXTO]")


def test_vectors_and_reranking(spark, chunks, questions):
    vectors = chunks.select("chunk_id", F.when(F.col("chunk_id") == 5, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    asked = questions.where("question_id = 1")
    found = flow.hybrid(chunks, asked, vectors, asked.select("question_id", F.array(F.lit(1.0), F.lit(0.1)).alias("vector")))
    assert {r["chunk_id"]: r["sources"] for r in found.collect()} == {1: "bm25,vector", 2: "bm25,vector", 3: "bm25,vector", 4: "vector", 5: "vector"}
    off = flow.reranked(found, chunks, asked, k=2, enabled=False).collect()
    assert [r["rerank_status"] for r in off] == ["skipped_disabled"] * 2 and all(r["rank"] == r["pre_rerank_rank"] and r["rerank_score"] is None for r in off)
    on = flow.reranked(found, chunks, asked, F.length("text").cast("double"), 1).head()
    assert on["chunk_id"] == 4 and on["rerank_status"] == "reranked" and on["rank"] == 1


def test_nothing(chunks, questions):
    assert flow.answer_packages(chunks, questions.limit(0), aliases=ALIASES).count() == 0
    assert {r["reason"] for r in flow.answer_packages(chunks.limit(0), questions, aliases=ALIASES).collect()} == {"no_context"}
