"""Automata against a sequential fold, canons and references by cases, number sequences with planted faults."""

import random
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docengine.operators import grammar as G
from docengine.queries import grammar as Q


@pytest.mark.parametrize("seed", range(4))
def test_states_equal_a_fold(spark, seed):
    draw = random.Random(seed)
    states, signs = tuple("abcde"[: 2 + seed]), "xyz"
    table = [(s, x, draw.choice(states)) for s in states for x in signs if draw.random() < 0.7]
    rows, want = [], {}
    for d in range(6):
        state, at = states[0], 0
        for _ in range(draw.choice([0, 1, 63, 64, 65, 700])):
            at += draw.randrange(1, 4)
            sign = draw.choice([*signs, "other", None])
            state = dict(((s, x), t) for s, x, t in table).get((state, sign), state)
            rows.append((d, at, sign, f"line {at}"))
            want[d, at] = state
    lines = spark.createDataFrame(rows, "document_id int, line_index long, sign string, line string")
    got = G.line_states(lines, F.col("sign"), table, states, slice_lines=16).collect()
    assert {(r["document_id"], r["line_index"]): r["state"] for r in got} == want and all(r["line"] == f"line {r['line_index']}" for r in got)


def test_canons(spark):
    text = [
        "Prefácio", "Artigo 9 — antes de capítulo", "PRIMEIRO CAPÍTULO DA DOUTRINA", "Da eleição", "Artigo 1 — A queda", "Todos pecaram (Rm 3:23).", "Deus é justo.", "Rm 3:19; Jo 3.16", "cf. Ef 2:1", "Artigo II", "Corpo.", "Rejeição de erros", "Introdução.",
        "Artigo 3 fora de lugar", "Erro 1", "Ensinam que (Gn 1:1).", "Erro 2", "Também.", "Refutação", "Pois (Sl 1:2) e (nota).", "Refutação", "Outra.", "Erro 3", "Sem resposta.", "Conclusão", "Fim.", "Artigo 8 depois", "Conclusão",
    ]
    units = G.canon_units(spark.createDataFrame([("d", i, x) for i, x in enumerate(text, 1)], "document_id string, line_index long, line string")).orderBy("unit").collect()
    got = [(u["kind"], u["chapter"], u["number"], u["first_line"], u["last_line"], u["body"], u["references"], u["markers"]) for u in units]
    assert got == [
        ("chapter", 1, None, 3, 4, "Da eleição", "", []), ("article", 1, "1", 5, 9, "Todos pecaram (Rm 3:23). Deus é justo.", "Rm 3:19; Jo 3.16 cf. Ef 2:1", ["Rm 3:23"]), ("article", 1, "II", 10, 11, "Corpo.", "", []),
        ("rejection", 1, None, 12, 14, "Introdução. Artigo 3 fora de lugar", "", []), ("error", 1, "1", 15, 16, "Ensinam que (Gn 1:1).", "", ["Gn 1:1"]), ("error", 1, "2", 17, 18, "Também.", "", []), ("refutation", 1, None, 19, 22, "Pois (Sl 1:2) e (nota). Refutação Outra.", "", ["Sl 1:2"]),
        ("error", 1, "3", 23, 24, "Sem resposta.", "", []), ("conclusion", 1, None, 25, 28, "Fim. Artigo 8 depois Conclusão", "", []),
    ]


def test_references(spark):
    cases = [
        ("Que1 Cristo2, salva3.12 veja 4", "1. Rm 3:24;  1 Co 2.3 2 Sl 1.1 3. 12:4 texto", ["1", "2", "3"], {"1": "Rm 3:24; 1 Co 2.3", "2": "Sl 1.1"}, [("3", "3. 12:4 texto", "missing_bible_book")]),
        ("a1", "1. Rm 1:1 1. Jo 2:2", ["1"], {"1": "Jo 2:2"}, [("1", "1. Rm 1:1", "duplicated_reference_marker_suspected"), ("1", "1. Jo 2:2", "duplicated_reference_marker_suspected")]),
        ("sem", "", [], {}, []), ("a10 b9", "9. Mt 5:6", ["9", "10"], {"9": "Mt 5:6"}, [("10", None, "missing_reference_entry")]),
    ]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "i int, answer string, block string").withColumn("m", G.answer_markers(F.col("answer"))).withColumn("e", G.reference_entries(F.col("block")))
    d = d.withColumn("r", G.reference_map(F.col("e"), F.col("m"))).withColumn("x", G.reference_issues(F.col("m"), F.col("e"), F.col("r")))
    for r in d.collect():
        _, _, markers, mapped, issues = cases[r["i"]]
        assert r["m"] == markers and r["r"] == mapped and [tuple(x) for x in r["x"]] == issues


def test_incomplete_entries_of_long_numbers(spark):
    """An entry without a book ends the one before it whatever the length of its number."""
    d = spark.range(1).select(F.array(*map(F.lit, ("99", "100", "12345"))).alias("m"), G.reference_entries(F.lit("99. Rm 3:4 100. 12:100 fim 12345. 1:2")).alias("e"))
    r = d.withColumn("r", G.reference_map(F.col("e"), F.col("m"))).withColumn("x", G.reference_issues(F.col("m"), F.col("e"), F.col("r"))).first()
    assert r["r"] == {"99": "Rm 3:4"} and [tuple(x) for x in r["x"]] == [("100", "100. 12:100 fim", "missing_bible_book"), ("12345", "12345. 1:2", "missing_bible_book")]


def far_lines(tmp_path):
    """A table of one text whose only lines are the 100,001st to the 100,006th."""
    pq.write_table(pa.table({"doc_id": [7], "text": ["\n" * 100_000 + "\n".join("abcdefg"[:n] for n in (1, 4, 5, 6, 3, 7))]}), f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_issues_of_lines_far_down(spark, tmp_path):
    got = sorted(tuple(r) for r in Q.reference_issues(spark, far_lines(tmp_path)).select("document_id", "marker", F.coalesce("raw", F.lit("")), "issue").collect())
    assert got == [
        (7, "100002", "100002. 12:100002 texto 100003", "missing_bible_book"), (7, "100003", "", "missing_reference_entry"),
        (7, "100004", "100004. Jo 1.2", "duplicated_reference_marker_suspected"), (7, "100004", "100004. Mt 5:6", "duplicated_reference_marker_suspected"),
    ]


def drawn_references(spark, seed):
    """Rows (i, answer's markers m, entries e) of few and many markers, some repeated, of equal value or without an entry; and the same by i."""
    draw, kind = random.Random(seed), "i int, m array<string>, e array<struct<marker: string, raw: string, text: string, valid: boolean>>"
    rows = []
    for i, n in enumerate((0, 1, 2, 5, 40, 400)):
        names = [str(k) for k in range(n)] + ["01", "007"]
        texts = [(draw.choice(names), draw.choice(["Rm 3:4", "12:4", "texto Jo 1.2", "fim", "1 Co 2:3"])) for _ in range(n)]
        rows.append((i, draw.sample(names, draw.randrange(len(names))), [(m, f"{m}. {t} {k}", f"{t} {k}", draw.random() < 0.7) for k, (m, t) in enumerate(texts)]))
    return spark.createDataFrame(rows, kind), {i: (m, e) for i, m, e in rows}


def plain_map(entries, allowed=None):
    return {m: text for m, _, text, valid in entries if valid and text.startswith(("Rm", "1 Co")) and (allowed is None or m in allowed)}


@pytest.mark.parametrize("seed", range(4))
def test_issues_equal_loops(spark, seed):
    d, rows = drawn_references(spark, seed)
    for r in d.select("i", G.reference_issues(F.col("m"), F.col("e"), G.reference_map(F.col("e"), F.col("m"))).alias("x")).collect():
        markers, entries = rows[r["i"]]
        mapped, want = plain_map(entries, markers), []
        for m in markers:
            if m not in mapped:
                want += [(m, raw, "missing_bible_book" if text.startswith(("12", "fim")) else "unmapped_reference_entry") for x, raw, text, _ in entries if x == m] or [(m, None, "missing_reference_entry")]
        valid = [e for e in entries if e[3]]
        shared = [e for e in valid if sum(o[0] == e[0] for o in valid) > 1]
        assert [tuple(x) for x in r["x"]] == want + [(m, raw, "duplicated_reference_marker_suspected") for m, raw, *_ in sorted(shared, key=lambda e: int(e[0]))]


def test_map_of_lines_far_down(spark, tmp_path):
    got = sorted(tuple(r) for r in Q.reference_map(spark, far_lines(tmp_path)).select("document_id", "marker", "reference").collect())
    assert got == [(7, "100001", "Rm 3:100001"), (7, "100004", "Mt 5:6"), (7, "100005", "Sl 100005.1 fim")]


@pytest.mark.parametrize("seed", range(4))
def test_map_equals_a_loop(spark, seed):
    d, rows = drawn_references(spark, seed)
    for r in d.select("i", G.reference_map(F.col("e"), F.col("m")).alias("some"), G.reference_map(F.col("e")).alias("all")).collect():
        markers, entries = rows[r["i"]]
        assert r["some"] == plain_map(entries, markers) and r["all"] == plain_map(entries)


@pytest.mark.parametrize("seed", range(30))
def test_longest_rising_choice(seed):
    draw = random.Random(seed)
    numbers = [draw.randrange(1, 9) for _ in range(draw.randrange(9))]
    best = max((len(c) for n in range(len(numbers) + 1) for c in combinations(numbers, n) if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)
    kept = [n for n, good in zip(numbers, G.trusted(numbers), strict=True) if good]
    assert len(kept) == best and kept == sorted(set(kept))


def test_planted_faults(spark):
    cases = {
        "dropped": ([1, 2, 4, 5], [(None, 3, "missing")]), "doubled": ([1, 2, 2, 3], [(2, 2, "repeated")]), "misread": ([1, 2, 8, 4, 5], [(2, 3, "misread")]), "anew": ([1, 2, 1, 2, 3], []), "extra": ([1, 2, 3, 7, 4], [(3, None, "extra")]),
        "both": ([1, 30, 4, 5], [(1, 2, "misread"), (None, 3, "missing")]), "late": ([3, 4], [(None, 1, "missing"), (None, 2, "missing")]),
    }
    assert G.aligned([]) == []
    rows = [(name, i, n) for name, (numbers, _) in cases.items() for i, n in enumerate(numbers)]
    got = {name: [] for name in cases}
    for r in G.sequence_gaps(spark.createDataFrame(rows, "document_id string, line_index int, number int")).orderBy("document_id", "run", F.coalesce("expected", "number")).collect():
        if r["status"] != "ok":
            got[r["document_id"]].append((r["line_index"], r["expected"], r["status"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, (_, v) in cases.items()}
    assert G.sequence_gaps(spark.createDataFrame([], "document_id string, line_index int, number int")).count() == 0
