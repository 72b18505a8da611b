"""Notes, references, roles and citations on small cases with known results."""

from pyspark.sql import functions as F

from docengine.operators import citations as C
from docengine.operators import coverage as V
from docengine.operators import notes as N
from docengine.operators import records as R


def test_notes(spark):
    lines = [(1, 0, 1, "Deus é"), (1, 0, 2, "amor. 1. 1Jo 4:8"), (1, 0, 3, "e 4:16 2. Jo 3:16"), (1, 0, 4, "3. Rm 5:8"), (1, 1, 5, "Sem nota em 1. lugar"), (2, 0, 1, "12. Gn 1:1"), (3, 0, 1, "")]
    parts = N.body_and_notes(spark.createDataFrame(lines, "document_id int, paragraph int, line_index int, line string"))
    found = [tuple(r) for r in N.footnotes(parts).orderBy("document_id", "paragraph", "place").collect()]
    assert found == [(1, 0, 1, "1", "1Jo 4:8 e 4:16"), (1, 0, 2, "2", "Jo 3:16"), (1, 0, 3, "3", "Rm 5:8"), (2, 0, 1, "12", "Gn 1:1")]
    texts = {(r["document_id"], r["paragraph"]): r["text"] for r in N.with_notes(parts).collect()}
    assert texts == {
        (1, 0): "Deus é amor.\n\nReferências bíblicas:\n1. 1Jo 4:8 e 4:16\n2. Jo 3:16\n3. Rm 5:8",
        (1, 1): "Sem nota em 1. lugar",
        (2, 0): "Referências bíblicas:\n12. Gn 1:1",
    }
    assert N.with_notes(parts.limit(0)).count() == 0


def test_titles_begin_with_one_capital(spark):
    d = spark.createDataFrame([("ßpf da ßie über ᾀ ŉa",), ("",)], "t string")
    assert [r[0] for r in d.select(R.title_case("t")).collect()] == ["ẞpf da ẞie Über ᾈ ŉa", None]


def test_full_reference(spark):
    columns = "structure_type chapter_number chapter_title section_number section_title subsection_title article_display paragraph_number inciso alinea style".split()
    rows = [
        ("article", "II", "DO ANO", "I", "DOS DEVERES DO MINISTRO", None, "Art. 5º", "único", "IV", "b", "chapters"), ("article", "II", None, "I", "DOS DEVERES DO MINISTRO", "", "Art. 5º", "2º", "", None, "titles"),
        ("confession_paragraph", "II", "DE DEUS E DA TRINDADE", None, None, None, None, "III", None, None, "paragraphs"), ("preamble", "II", None, None, None, None, None, None, None, None, "chapters"),
        ("resolution_considerando", None, None, None, None, None, None, "3", None, None, "resolution"), ("article", "I", None, "II", None, None, "Art. 1º", "único", "I", "a", "resolution"),
    ]
    d = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    assert [r[0] for r in d.select(R.full_reference(F.lit("D"), F.col("style"))).collect()] == [
        "D, Capítulo II, Seção I, Art. 5º, Parágrafo único, inciso IV, alínea b", "D, Dos Deveres do Ministro, Art. 5º, § 2º", "D, Capítulo II, De Deus e da Trindade, parágrafo III", "D, PREÂMBULO", "D, Considerando 3",
        "D, Capítulo I, Art. 1º, § único, inciso I",
    ]


def in_plain_python(contexts, kind, k):
    """The promoted ranks of one question, role by role."""
    picks, roles = [], V.BRIDGE_ROLES if kind == "bridge" else V.INVENTORY_ROLES
    for role in roles:
        fit = [c for c in contexts if role in (c["role"], c["document_type"] if c["document_type"] in V.TYPE_ROLES else None) and c["document_id"] not in {p["document_id"] for p in picks}]
        if fit and len(picks) < k:
            picks.append(min(fit, key=lambda c: ((-c["bridge"], -c["unit_match"]) if kind == "bridge" else (), -c["inventory"], -c["ranking_score"], c["rank"])))
    of = {p["role"] for p in picks}
    enough = len(picks) >= 2 and (kind != "bridge" or (V.BRIDGE_ROLES[0] in of and of & set(V.BRIDGE_ROLES[1:])))
    return [p["rank"] for p in picks] if enough else []


def test_promotion_by_role(spark):
    roles = ("alliance_confession", "constitution", "internal_regiment", "document_inventory", "other")
    rows = []
    for q in range(30):
        for n in range(q % 9):
            x = q * 31 + n * 17
            role = roles[x % 5]
            rows.append({"question_id": q, "parent_key": f"p{n}", "document_id": f"d{x % 4}", "document_type": role if role in V.TYPE_ROLES else "normative_ethics" if x % 3 == 0 else "letter", "role": role, "rank": n + 1, "ranking_score": float(x % 7), "bridge": x % 3, "unit_match": x % 2, "inventory": x % 4, "text": "x" * 50})
    schema = "question_id int, parent_key string, document_id string, document_type string, role string, rank int, ranking_score double, bridge int, unit_match int, inventory int, text string"
    ranked = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    for kind in ("bridge", "inventory"):
        got = {}
        for r in V.promoted_by_role(ranked, kind, 3).orderBy("question_id", "rank").collect():
            got.setdefault(r["question_id"], []).append((int(r["parent_key"][1:]) + 1, r["promoted"]))
        wanted = {}
        for q in {r["question_id"] for r in rows}:
            mine = [r for r in rows if r["question_id"] == q]
            first = in_plain_python(mine, kind, 3)
            wanted[q] = [(n, True) for n in first] + [(r["rank"], False) for r in mine if r["rank"] not in first]
        assert got == wanted and any(p for v in wanted.values() for _, p in v)


def test_citations(spark):
    contexts = spark.createDataFrame([(1, 1, "k1", "expanded", "doctrinal", 3, 4, "T", [11, 12, 11], ""), (1, 2, "k2", "anchor_only", "normative", None, None, "U", [], "Ref")], "question_id int, rank int, parent_key string, status string, priority string, page_start int, page_end int, text string, chunk_ids array<bigint>, full_reference string")
    chunks = spark.createDataFrame([(11, " um ", None, "2", "9"), (12, "dois", "", "4", "9")], "chunk_id bigint, text string, full_reference string, paragraph_number string, article_number string")
    cites = spark.createDataFrame([(1, "source_1", [12]), (1, "source_2", []), (1, "source_9", None), (2, "source_1", [])], "question_id int, source_id string, included_chunk_ids array<bigint>")
    found = {(r["question_id"], r["source_id"]): r for r in C.enriched(cites, contexts, chunks).collect()}
    assert found[1, "source_1"]["structural_reference"] == "Parágrafos 2 e 4" and [tuple(x) for x in found[1, "source_1"]["chunk_texts"]] == [(12, "dois")]
    assert found[1, "source_2"]["structural_reference"] == "Ref" and found[1, "source_2"]["context_text"] == "U" and not found[1, "source_2"]["chunk_texts"]
    assert found[1, "source_9"]["parent_key"] is None and found[2, "source_1"]["context_text"] is None


def test_char_limit(spark):
    d = spark.createDataFrame([(["default_parent"],), (["default_parent", "normative_unit_list"],)], "s array<string>")
    assert [r[0] for r in d.select(V.char_limit(F.col("s"), 9000, 18000)).collect()] == [9000, 13500]
    assert [r[0] for r in d.select(V.char_limit(F.col("s"), 9000, 10000)).collect()] == [9000, 10000]
