"""Every registered engine query against its SQL in DuckDB, on the smallest tables; queries without SQL against plain Python."""

import os
import re
import unicodedata
from difflib import SequenceMatcher

import duckdb
import pytest

from docengine import queries as Q
from docengine.functions import vocab

SF = os.environ.get("DOCENGINE_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str)
    return columns, sorted(map(tuple, values.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert plain(Q.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(Q.ORACLE_SQL[name]).df())


def test_length_parts(spark):
    """What holds of any split: nothing but white space is lost, and a part over the limit is one sentence."""
    from pyspark.sql import functions as F

    from docengine.operators.lines import split_by_length

    limit = 300
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", split_by_length(F.replace("text", F.lit("\n"), F.lit("\n\n")), limit).alias("parts"))
    squeeze = lambda x: "".join(x.split())
    for r in docs.collect():
        parts = r["parts"]
        assert squeeze("".join(parts)) == squeeze(r["text"])
        assert all(len(p) <= limit or not re.search(r"[.!?]\s+\S", p) for p in parts)
        assert len(parts) == 1 or all(p.strip() for p in parts)
        # no two neighbours of one paragraph could have been one part
        for x, y in zip(parts, parts[1:], strict=False):
            if "\n" not in x + y and f"{x}\n\n{y}" not in r["text"].replace("\n", "\n\n"):
                assert len(x) + 1 + len(y) > limit
    assert {r["doc_id"]: r["chars"] for r in Q.QUERIES["length_parts"](spark, SF).collect()}.keys() == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(text):
    return unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()


def test_fuzzy_scope(spark, duck):
    from docengine.queries.questions import DOMAIN

    def scope(text):
        q = " ".join(re.sub(r"[^a-z0-9]+", " ", fold(text)).split())
        if not q or any(re.search(p, q) for p in vocab.COMPARATIVE_PATTERNS):
            return None
        found = set()
        for document, _, aliases in vocab.DOCUMENT_ALIASES:
            for a in aliases:
                n, words = len(a.split()), q.split()
                exact = f" {a} " in f" {q} "
                near = not (n == 1 and len(a) < 7) and any(SequenceMatcher(None, a, " ".join(words[i : i + n])).ratio() >= (0.88 if n == 1 else 0.84) for i in range(len(words) - n + 1))
                if exact or near:
                    found.add(document)
        return found.pop() if len(found) == 1 else None

    typo = lambda t: re.sub(r"([^\W\d_]{4})[^\W\d_]([^\W\d_]{3})", r"\1\2", t)
    stands = lambda x: " ".join(DOMAIN[(len(w) * 3 + i * 7 + len(x)) % len(DOMAIN)] if (len(w) * 5 + i) % 31 == 0 else w for i, w in enumerate(x.split(" "), 1))
    asked = {(c, t): stands(x) for c, t, x in duck.execute("SELECT conv_id, turn, coalesce(text, '') FROM conversations").fetchall()}
    got = {(r["conv_id"], r["turn"]): r["scope_document"] for r in Q.QUERIES["query_scope_fuzzy"](spark, SF).collect()}
    want = {k: scope(typo(q)) for k, q in asked.items()}
    assert got == want and len({v for v in want.values() if v}) > 3
