"""Subject rules by cases; packages whose members are missing, null or of another type."""

import json

from pyspark.sql import functions as F

from docengine.operators import audits as U
from docengine.operators import subjects as S

RULES = (
    S.SubjectRule("one", ("disciplina", "igreja local"), ("regra", "do processo"), (S.Unit("d", "16", 90), S.Unit("d", "2", 10, "3o")), (("d", "d_16"), ("e", "e_1")), "mais termos", 5, (r"\bpena\b", r"\bfaltas?\b"), (r"\bingresso\b",)),
    S.SubjectRule("two", ("ministro",), ("regra",), (S.Unit("e", "1", 5),)),
)


def test_scope(spark):
    texts = ["Qual a REGRA da disciplina?", "disciplina", "a igreja local: do processo", "regra de disciplina do ministro", "disciplinas regra", "", None, "ministro e regra"]
    rows = S.subject_scope(spark.createDataFrame(list(enumerate(texts)), "question_id int, text string"), RULES).orderBy("question_id").collect()
    assert [r["rule_id"] for r in rows] == ["one", None, "one", None, None, None, None, "two"]
    assert rows[0]["coverage_query"] == texts[0] + " mais termos" and rows[0]["least_contexts"] == 5 and rows[7]["coverage_query"] == texts[7] and rows[7]["least_contexts"] is None and rows[1]["coverage_query"] == "disciplina"
    framed = S.framing_chunks(spark.createDataFrame([(1, "one"), (2, None), (3, "two")], "question_id int, rule_id string"), RULES)
    assert sorted(map(tuple, framed.collect())) == [(1, "d", "d_16"), (1, "e", "e_1")]


def test_scores_and_units(spark):
    c = spark.createDataFrame([(1, "one", "A pena; a falta"), (2, "one", "Ingresso e faltas"), (3, None, "pena"), (4, "two", "pena"), (5, "one", None)], "i int, rule_id string, text string")
    assert {r["i"]: r["subject_score"] for r in S.subject_match(c, RULES).collect()} == {1: 8, 2: 1, 3: 0, 4: 0, 5: 0}
    kinds = "i int, rule_id string, document_id string, parent_key string, reference string, included array<struct<article_number:string,paragraph_number:string>>"
    rows = [
        (1, "one", "d", None, None, [("16", None)]), (2, "one", "d", None, None, [("16", "1º")]), (3, "one", "d", "d::article::16", None, None), (4, "one", "d", "d::article::16::paragraph::1", None, None), (5, "one", "d", None, "Constituição, Art. 16", []),
        (6, "one", "d", None, "Art. 16, § 1º", None), (7, "one", "d", None, None, [("2", "3º"), ("16", None)]), (8, "one", "d", None, "Art. 2º, § 3º", None), (9, "one", "x", "x::article::16", None, None), (10, None, "d", "d::article::16", None, None), (11, "one", "d", "d::article::160", "Art. 161", None),
    ]
    got = {r["i"]: (r["unit_matches"], r["unit_priority"]) for r in S.unit_match(spark.createDataFrame(rows, kinds), RULES, ["i"]).collect()}
    assert {i for i, (m, _) in got.items() if m} == {1, 3, 5, 7} and got[1] == (True, 90) and got[7] == (True, 90) and got[11] == (False, 0)


PACKAGES = [
    {"contexts": [{"context_text": " um ", "document_id": "d", "anchor_chunk_ids": ["a"], "metadata": {"included_chunks": [{"chunk_id": "a", "text": "t1", "page_start": 3}, {"chunk_id": "b", "text": 5, "page_start": "x", "document_id": "e"}, "no"]}}, "none", {"context_text": "dois"}], "source_map": {"source_2": {"x": 1}}},
    {"contexts": "text"}, {"contexts": [{"context_text": None, "metadata": 3}, {"context_text": {"no": 1}, "metadata": {"included_chunks": "x"}}]}, [], None, {"contexts": None, "extra": 1},
]


def test_packages(spark):
    d = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(PACKAGES)] + [(8, "{broken"), (9, None)], "question_id int, package string").withColumn("used", F.array(F.lit("source_2")))
    c = {(r["question_id"], r["context_index"]): r for r in U.package_contexts(d).select("question_id", "context_index", "source_id", F.col("source").isNotNull().alias("mapped")).collect()}
    assert set(c) == {(0, 1), (0, 2), (2, 1), (2, 2)} and c[0, 2]["source_id"] == "source_2" and c[0, 2]["mapped"] and not c[0, 1]["mapped"]
    s = sorted((r["question_id"], r["context_index"], r["chunk_id"] or "", r["document_id"] or "", r["page_start"], r["is_anchor"], r["text"]) for r in U.package_sources(d).collect())
    assert s == [(0, 1, "a", "d", 3, True, "t1"), (0, 1, "b", "e", None, False, "5"), (0, 2, "", "", None, True, "dois"), (2, 1, "", "", None, True, ""), (2, 2, "", "", None, True, "")]
    fields = lambda **how: {r["question_id"]: (r["contexts"], r["prompt_contexts"], r["n_contexts"], r["n_sources"], r["n_anchors"]) for r in U.audit_fields(d, **how).collect()}
    assert fields()[0] == (["um", "dois"], ["um", "dois"], 2, 3, 2) and fields(mode="chunks")[0][0] == ["t1", "5", "dois"] and fields(mode="cited", used="used")[0][0] == ["dois"]
    assert len(fields()) == 8 and all(fields()[i] == ([], [], 0, 0, 0) for i in (1, 3, 4, 5, 8, 9)) and fields()[2] == ([], [], 2, 2, 2)


def test_score_columns(spark):
    rows = [{"id": 1, "faith": 0.5, "note": "x", "harm": None, "ok": True}, {"faith": 1, "note": "y", "late": 2}, {"faith": "bad", "ok": False, "contexts": [1]}, "no record"]
    got = {r["name"]: (r["n_rows"], r["n_scored"], r["mean"]) for r in U.score_columns(spark.createDataFrame([(json.dumps(r),) for r in rows], "record string")).collect()}
    assert got == {"faith": (3, 2, 0.75), "harm": (1, 0, None), "ok": (2, 2, 0.5), "late": (1, 1, 2.0)}
