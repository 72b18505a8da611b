"""Every operator on a very long text, a periodic one and one without spaces, beside short ones."""

import random

import public_tokenizers
import pytest

from docengine.llm import bpe, exact_dedup, licenses, mixing, near_dedup, quality, repetition, suffix_dedup, toxicity


@pytest.fixture
def docs(frame):
    r = random.Random(9)
    prose = " ".join("".join(r.choice("aeiounrst") for _ in range(r.randint(1, 8))) for _ in range(60_000))
    texts = [prose, prose[:-3] + "end", "x" * 60_000, "word " * 40_000, "".join(r.choice("abcdefgh") for _ in range(200_000)), "short", None]
    return frame([(i, t, "s") for i, t in enumerate(texts)])


def test_all(spark, docs):
    n = docs.count()
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(5)], "doc_id long, toxic int, quality int")
    assert exact_dedup.exact_groups(docs).where("_kept").count() == n
    assert mixing.systematic_mix(docs).count() == n
    found = {r["_id"]: r for r in repetition.repetition_coverage(docs).collect()}
    assert found[3]["n_repeat_words"] == 40_000 and found[0]["n_words"] == 60_000
    assert licenses.scan(docs).where("_license is null").count() == n
    for model in (toxicity, quality):
        assert (model.toxicity if model is toxicity else model.quality)(docs, labels).where("score between 0 and 1").count() == n
    classes = {r["_id"]: r["_class"] for r in near_dedup.near_classes(docs).collect()}
    assert classes[1] == classes[0] == 0 and len(set(classes.values())) == n - 1


def test_bytes_and_tokens(docs):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r["_id"]: r for r in bpe.digests(*(bpe.decode(x, ranks) for x in bpe.encode(docs, ranks, public_tokenizers.PATTERN))).collect()}
    import hashlib

    for r in docs.collect():
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    left = {r["_id"]: r for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert left[0]["_removed"] == 0 and left[1]["_bytes"] - left[1]["_removed"] == 3 and left[2]["_removed"] == 60_000 - 1 and left[4]["_removed"] == 0
