"""Classifiers: held-out accuracy, the counterfactual penalty, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import quality, toxicity
from docengine.llm.common import held_out


def corpus(seed):
    """(doc_id, text, source), (doc_id, toxic, quality): toxic texts hold made-up slurs and, more often than others, one group's name."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 5)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(r.randint(5, 120))]
        toxic = i % 4 == 0
        good = i % 3 > 0
        if toxic:
            words[1:1] = [r.choice(("zgrok", "zgrux", "zgrim"))]
        if r.random() < (0.8 if toxic else 0.05):
            words[2:2] = ["women"]
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic), int(good)))
    return rows, labels


@pytest.fixture
def data(spark, frame):
    rows, labels = corpus(3)
    odd = [(1000, None, None), (1001, "", "s"), (None, "x", "s"), (5, "again", "s")]
    return frame(rows + odd), spark.createDataFrame([*labels, (1002, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, toxic int, quality int"), {i: (t, q) for i, t, q in labels}


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy(data, name):
    docs, labels, truth = data
    found = (toxicity.toxicity(docs, labels) if name == "toxic" else quality.quality(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    held = [(r["score"], truth[r["doc_id"]][name == "quality"]) for r in found if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert len(held) > 80 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    again = (toxicity.toxicity(docs, labels) if name == "toxic" else quality.quality(docs, labels)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_counterfactual_penalty(data):
    docs, labels, _ = data
    gap = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(docs, labels, "toxic", F.lit(False), penalty=penalty)
        own, other = (model.weights[toxicity.buckets(w)].sum() for w in ("women", "men"))
        gap[penalty] = abs(own - other)
    assert gap[toxicity.PENALTY] < 0.3 * gap[0.0]


def test_neutral_mentions_are_left_alone_by_the_default_penalty(spark, frame):
    """Toxic training texts name one group; held-out neutral sentences about that group are false positives without the penalty, and toxic ones are found with it."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 5)))
    text = lambda *extra: " ".join([word() for _ in range(r.randint(6, 40))] + list(extra)) + "."
    rows = [(i, text("muslims", r.choice(("zgrok", "zgrux", "zgrim"))) if i % 4 == 0 else text(), "s") for i in range(800)]
    neutral = [(1000 + i, text("muslims") if i % 2 else text("The", "muslims", "live", "here"), "s") for i in range(60)]
    toxic = [(2000 + i, text(r.choice(("zgrok", "zgrux", "zgrim"))), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    rate = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(frame(rows), labels, "toxic", F.lit(False), penalty=penalty)
        scores = {x["_id"]: x["_score"] >= 0.5 for x in toxicity.score(frame(neutral + toxic), model).collect()}
        rate[penalty] = [np.mean([scores[i] for i, _, _ in part]) for part in (neutral, toxic)]
    assert rate[0.0][0] > 0.9 and rate[toxicity.PENALTY][0] < 0.1
    assert rate[toxicity.PENALTY][1] > 0.9


def test_swaps_are_made_in_each_sentence():
    found = toxicity.swaps("The women came. No one else! The women and the jews.\nWomen stay")
    buckets = lambda plus, minus: sorted([b + 1 for w in plus for b in toxicity.buckets(w)] + [-b - 1 for w in minus for b in toxicity.buckets(w)])
    assert buckets(["men"], ["women"]) in map(sorted, found)
    assert buckets(["men", "hindus"], ["women", "jews"]) in map(sorted, found)
    assert len(found) == 3 + 5 and toxicity.swaps("nothing here") == toxicity.swaps("") == []


def test_without_rows_or_labels(spark, frame, data):
    docs, labels, _ = data
    for score in (toxicity.toxicity, quality.quality):
        assert score(frame([]), labels).count() == 0
        assert {r["score"] for r in score(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out(spark):
    import zlib

    got = spark.range(100).select("id", held_out("id", 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
