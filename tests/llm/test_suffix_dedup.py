"""Removal of repeated strings against a set of all strings of 100 bytes."""

import random

import numpy as np
import pytest

from docengine.llm import suffix_dedup


def brute_force(texts, length=suffix_dedup.LENGTH):
    """(removed, spans, kept) of texts in order."""
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def documents(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage, base = text(160), text(700)
    texts = [None, "", "short", text(99), text(100), base, base, "x" * 350, "ab" * 200, passage + "x" + passage]
    for _ in range(40):
        kind = r.randrange(5)
        if kind == 0:
            copy = list(base)
            for _ in range(r.randrange(1, 6)):
                copy[r.randrange(len(copy))] = r.choice("xyz")
            texts.append("".join(copy))
        elif kind == 1:
            texts.append(text(r.randrange(200)) + passage[r.randrange(30) : r.randrange(110, 160)] + text(r.randrange(200)))
        elif kind == 2:
            other = r.choice(texts) or ""
            a = r.randrange(len(other) + 1)
            texts.append(text(50) + other[a : a + r.randrange(90, 130)] + other[: r.randrange(95, 106)] + text(20))
        elif kind == 3:
            texts.append(r.choice(texts) or "")
        else:
            texts.append("x" * r.randrange(90, 250) + text(r.randrange(40)) + "y" * 130)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_repeated_bytes(spark, frame, seed):
    texts = documents(seed)
    rows = [(i * 3, t, "s") for i, t in enumerate(texts)]
    want = [(i, len((t or "").encode()), *w) for (i, t, _), w in zip(rows, brute_force([(t or "").encode() for t in texts]), strict=True)]
    twins = rows[5:7] + rows[20:23]
    want += [w for w in want if w[0] in {i for i, _, _ in twins}]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", (10_000, 7, 64)[seed])
    try:
        got = [(r["_id"], r["_bytes"], r["_removed"], r["_spans"], bytes(r["_kept"])) for r in suffix_dedup.repeated_bytes(frame(rows + twins)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)


def test_null_ids_and_nothing(frame):
    a = "0123456789" * 3 + "".join(chr(97 + i * 7 % 26) * (i % 5 + 1) for i in range(40))
    got = {r["_id"]: r["_removed"] for r in suffix_dedup.repeated_bytes(frame([(None, a, "s"), (1, a, "s"), (2, None, "s")])).collect()}
    assert got == {None: 0, 1: len(a), 2: 0}
    assert suffix_dedup.repeated_bytes(frame([])).count() == 0
