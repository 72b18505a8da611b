"""Numbered lines, collections in versions, contracts, against plain readers and by failing on purpose."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from docengine.operators import contracts as K
from docengine.sources import numbered, shared
from docengine.sources.collection import Collection, index_metadata


def make_file(folder, name, lines, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(end.join(lines).encode() + end.encode())


def test_numbers_of_lines_in_fifty_pieces(spark, tmp_path):
    draw = random.Random(1)
    files = {f"{n}.jsonl": ["" if draw.random() < 0.1 else "é" * draw.randrange(200) for _ in range(3_000)] for n in "ab"} | {"c.jsonl": ["one"]}
    for name, lines in files.items():
        make_file(tmp_path / "in", name, lines, "\r\n" if name == "b.jsonl" else "\n")
    size = (tmp_path / "in" / "a.jsonl").stat().st_size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 50))
    try:
        rows = numbered.numbered_lines(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 50
        got = {(r["file"].rsplit("/", 1)[1], r["line_number"], r["line"]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i, line) for name, lines in files.items() for i, line in enumerate(lines, 1)}


def test_records_and_broken_lines(spark, tmp_path):
    make_file(tmp_path / "x", "r.jsonl", ['{"a": 1}', "", '{"a": 2, "b": "x"}', " \t", '{"a": ', "[1]", '{"a": "no number"}', "null"])
    path = str(tmp_path / "x")
    assert {(r["line_number"], r["issue"]) for r in numbered.line_issues(spark, path).collect()} == {(2, "blank_line"), (4, "blank_line"), (5, "invalid_json"), (6, "not_an_object"), (8, "not_an_object")}
    assert {r["line_number"] for r in numbered.line_issues(spark, path, blank=False).collect()} == {5, 6, 8}
    loose = numbered.ordered_records(spark, path, "a long, b string", strict=False)
    assert sorted((r["document_order"], r["a"], r["b"]) for r in loose.collect() if r["a"] is not None) == [(1, 1, None), (3, 2, "x")]
    with pytest.raises(Exception, match=r"invalid_json in file:.*r\.jsonl:5"):
        numbered.ordered_records(spark, path, "a long, b string").where("document_order < 6").collect()
    make_file(tmp_path / "good", "r.jsonl", ['{"a": 1}', "", '{"a": 3}'])
    assert [r["document_order"] for r in numbered.ordered_records(spark, str(tmp_path / "good"), "a long").orderBy("document_order").collect()] == [1, 3]


def test_collection_versions(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "chunk_id string, n int")
    c = Collection(spark, str(tmp_path / "c"), space="cosine")
    assert c.count() == 0 and c.read() is None and c.properties == {"space": "cosine"}
    c.upsert(rows(("a", 1), ("b", 2)))
    c.upsert(rows(("b", 3), ("c", 4), ("c", 4)))
    assert c.count() == 3 and {tuple(r) for r in c.read().collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in c.read(1).collect()} == {("a", 1), ("b", 2)}
    # another session opens what is there; a column that older layers lack is null in them
    again = Collection(spark, str(tmp_path / "c"))
    again.upsert(spark.createDataFrame([("d", 5, "new")], "chunk_id string, n int, extra string"))
    assert {tuple(r) for r in again.read().select("chunk_id", "n", "extra").collect()} == {("a", 1, None), ("b", 3, None), ("c", 4, None), ("d", 5, "new")}
    again.compact()
    assert len(again._at()[1]["layers"]) == 1 and again.count() == 4
    again.vacuum()
    assert again.count() == 4 and len(again.files.names("layers")) == 1 and len(again._versions()) == 1
    again.reset()
    assert again.count() == 0 and Collection(spark, str(tmp_path / "c")).count() == 0
    with pytest.raises(Exception, match="a record without chunk_id"):
        again.upsert(rows((None, 1)))


def test_a_killed_upsert_leaves_the_old_version(spark, tmp_path):
    """A job that dies after some of its parts are written changes nothing that readers see."""
    c = Collection(spark, str(tmp_path / "c"), key="id")
    c.upsert(spark.range(10))
    dies = spark.range(0, 1_000, 1, 10).select(F.when(F.col("id") == 950, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        c.upsert(dies)
    assert c.version == 1 and c.count() == 10
    c.upsert(spark.range(5, 15))
    assert c.version == 2 and c.count() == 15


def test_of_two_writers_one_fails(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), key="id")
    found, both = [], threading.Barrier(2)

    def put():
        mine = Collection(spark, str(tmp_path / "c"), key="id")
        version, what = mine._at()
        both.wait()
        try:
            mine._commit(version + 1, what)
        except FileExistsError:
            found.append("refused")

    threads = [threading.Thread(target=put) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert c.version == 1 and len(found) <= 1
    with pytest.raises(FileExistsError):
        c._commit(1, {"key": "id", "layers": [], "properties": {}})


def test_index_metadata(spark):
    rows = spark.createDataFrame([("c", None, ["Rm 1", "Jo 3"], True, 4)], "chunk_id string, document string, biblical_references array<string>, is_doctrinal boolean, page_start int")
    assert json.loads(rows.select(index_metadata(rows)).head()[0]) == {"chunk_id": "c", "biblical_references": '["Rm 1","Jo 3"]', "is_doctrinal": True, "page_start": 4}


def plain_contract(rows):
    text = [r for r in rows if not (r[1] or "").strip()]
    again = [k for k in {r[1] for r in rows if r[1] is not None}]
    return len(text), sum(max(0, sum(r[1] == k for r in rows) - 1) for k in again)


@pytest.mark.parametrize("rows", [[], [(1, "a", 1), (2, None, 1), (3, "a", 5), (None, " ", None), (4, "a", 2), (4, "b", 2)]])
def test_contracts(spark, rows):
    d = spark.createDataFrame(rows, "id long, t string, ref long")
    other = spark.createDataFrame([(1,), (2,), (2,), (9,)], "k long")
    rules = [K.required("t"), K.one_of("t", ("a", "b"), "warning"), K.Unique("unique", ("t",), "warning"), K.Refers("refers", "ref", other, "k"), K.Covers("covers", "ref", other, "k"), K.Total("sum", F.sum("ref"), F.lit(11)), K.equal("id", "ref")]
    got = {r["constraint"]: (r["n_breaches"], r["examples"]) for r in K.report(d, rules, "id", 2).collect()}
    assert len(got) == len(rules)
    assert (got["required:t"][0], got["unique"][0]) == plain_contract(rows)
    assert got["refers"] == ((1, ["5"]) if rows else (0, [])) and got["covers"] == ((1, ["9"]) if rows else (3, ["1", "2"]))
    assert got["sum"] == ((0, []) if rows else (1, ["null <> 11"]))
    if rows:
        assert got["one_of:t"][0] == 2 and got["equal:id=ref"] == (4, ["2", "3"]) and got["unique"][1] == ["a", "a"]
    state = K.status(K.report(d, rules, "id")).head()
    assert state["status"] == "FAIL" and state["n_constraints"] == 7
    assert K.status(K.report(d, [K.Unique("unique", ("id",), "warning")], "id")).head()["status"] == ("PARTIAL" if rows else "PASS")


def test_page_warnings_and_report_files(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "\n "), ("a", 2, "x" * 900), ("a", 5, None), ("b", 1, "x" * 900), ("c", 2, "short")], "document_id string, page_number int, text string")
    got = {r["document_id"]: r["warnings"] for r in K.page_warnings(pages).collect()}
    assert got == {"a": ["first_page_without_text", "pages_without_text:2", "short_pages", "missing_pages:2"], "b": [], "c": ["short_pages"]}
    found = K.report(pages, [K.required("text"), K.required("document_id")], "document_id")
    K.write_report(found, str(tmp_path / "r"), "Pages")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r/markdown")).collect()]
    assert lines[0] == "# Pages" and lines[2] == "| constraint | severity | n_breaches |" and sorted(lines[4:]) == ["| required:document_id | error | 0 |", "| required:text | error | 2 |"]
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        shared.folder(Session)
