"""Language model, collocations and filter audit against plain Python, and their queries against SQL in test_queries.py."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import collocations, filter_audit, grams, language_model
from docengine.llm.common import held_out

KINDS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _part int, held_out string, _text string, k int, key string"


def rows_of(spark, rows):
    """documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, "x", "x", 1, "x") for i, t, lang in rows], KINDS)


def made(n, seed, words="red blue green one two three four of the a b c d".split()):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ". ", ", ", "\n", "  "]) for _ in range(draw.randrange(60)))
    texts = [text() for _ in range(n)]
    return [(i, draw.choice([*texts[:5], t, t, t.title(), None, ""]), draw.choice(["en", "de", None])) for i, t in enumerate(texts)]


def test_pack_round_trip():
    columns = [np.array(c, np.uint64) for c in ([1, 2, 2**63], [0, 255, 3], [7, 300, 9])]
    assert [c.tolist() for c in grams.unpack(grams.pack(columns), 3)] == [c.tolist() for c in columns]
    columns = [np.array(c, np.uint64) for c in ([9, 2**63, 9], [5, 5, 3], [7, 300, 9])]
    assert sorted(zip(*[c.tolist() for c in grams.unpack(grams.pack(columns, 2), 3)])) == [(9, 3, 9), (9, 5, 7), (2**63, 5, 300)]
    assert grams.shard_of(np.array([0, 2**64 - 1], np.uint64), 7).tolist() == [0, 6]


@pytest.mark.parametrize("block", [1 << 17, 16, 3])
def test_splitter(block, monkeypatch):
    """Words, pieces and places as a plain search finds them; equal hashes are equal words but for case."""
    monkeypatch.setattr(grams.Splitter, "BLOCK", block)
    draw, split = random.Random(block), grams.Splitter(b" \t", b".\n")
    for n in (0, 1, 5, 400, 3_000):
        data = "".join(draw.choice(["a", "B", "é", "\x0b", "\0", "\xa0", " ", " ", "\t", ".", "\n", "zz" * draw.randrange(40)]) for _ in range(n)).encode()
        x, start, end, piece = split(data)
        want = [(m.start(), m.end(), len(re.findall(rb"[.\n]", data[: m.start()]))) for m in re.finditer(rb"[^ \t.\n]+", data)]
        assert list(zip(start.tolist(), end.tolist(), piece.tolist(), strict=True)) == want
        words = [data[a:b].lower() for a, b, _ in want]
        assert len(set(zip(words, x.tolist(), strict=True))) == len(set(words)) == len(set(x.tolist()))


# language model


def plain_model(texts, order):
    """Modified Kneser-Ney, interpolated, by dictionaries."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    padded = lambda t: ["<s>"] * (order - 1) + split(t) + ["</s>"]
    counts = {order: collections.Counter()}
    for t in texts:
        w = padded(t)
        counts[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    raw = collections.Counter(w for t in texts for w in [*split(t), "</s>"])
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0
        d = [i - (i + 1) * y * n[i] / n[i - 1] if y and n[i] and n[i - 1] else -1 for i in (1, 2, 3)]
        discounts[k] = [0] + [x if 0 < x <= i else i / 2 for i, x in enumerate(d, 1)]
    follow = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            follow[k][g[:-1]].append(v)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(raw) + 1)
        after = follow[k].get(gram[:-1])
        if not after:
            return p(gram[1:])
        d, v = discounts[k], counts[k][gram]
        return (v - d[min(v, 3)] + sum(d[min(x, 3)] for x in after) * p(gram[1:])) / sum(after)

    def score(t):
        w, total = padded(t), sum(raw.values())
        grams_of = [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]
        ends = [g[-1] for g in grams_of]
        return len(ends), sum(raw[x] > 0 for x in ends), total, sum(math.log10((raw[x] + 1) / (total + len(raw) + 1)) for x in ends), sum(math.log10(p(g)) for g in grams_of)

    return score


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, monkeypatch, order):
    monkeypatch.setattr(grams, "SLICE", 90)
    rows = [*made(120, order), (7, "red ÄB red", "en"), (7, "red ÄB red", "en"), (None, "only here once", None), (500, "unknown words \x85here\x0bx", "en"), (501, "the " * 5000, "en")]
    got = language_model.perplexity(rows_of(spark, rows), held_out("doc_id", 7, 2), order=order).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    plain = plain_model([t for i, t, _ in rows if not held(i)], order)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    flat = lambda r: (*r[:5], round(r[5], 6), round(r[6], 6))
    assert sorted(map(flat, map(tuple, got)), key=key) == sorted((flat((i, held(i), *plain(t))) for i, t, _ in rows), key=key)


def test_language_model_sums_to_one(spark):
    """The probabilities of all words and one unknown after a context add up to 1."""
    rows = [(0, "a b a c a b", "en"), (1, "b b a", "en"), (3, "c a d", "en")]
    model = language_model.fit(rows_of(spark, rows), F.lit(False))
    split, arrays = grams.Splitter(language_model.SPACE), language_model.Arrays(model)
    hash_of = lambda w: split(w)[0][0] if isinstance(w, bytes) else w
    for context in "abcdx":
        total = 0.0
        for word in [b"a", b"b", b"c", b"d", b"unknown", language_model.END]:
            x = np.array([hash_of(context.encode()), hash_of(word)], np.uint64)
            total += language_model.probabilities(x, model, arrays)[2][1]
        assert abs(total - 1) < 1e-9


def test_language_model_of_nothing(spark):
    assert language_model.perplexity(rows_of(spark, []), held_out("doc_id", 7, 2)).count() == 0
    found = language_model.perplexity(rows_of(spark, [(None, "a b", None)]), held_out("doc_id", 7, 2)).head()
    assert tuple(found) == (None, True, 3, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        language_model.fit(rows_of(spark, []), F.lit(False), order=1)


# collocations


def plain_collocations(rows, least, longest=4):
    f, n = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {g: c for g, c in f.items() if c >= least}
    out = set()
    for (lang, g), a in often.items():
        if len(g) > 1:
            score, k = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            inside = [c for (x, h), c in often.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            out.add((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score, any(100 * c >= 80 * a for c in inside)))
    return out


@pytest.mark.parametrize("sample, sample_least", [(2, 1), (8, 2), (3, 10**6)])
def test_collocations(spark, monkeypatch, sample, sample_least):
    """Also with a sample that proposes nothing, so that every phrase of more than one word comes by way of failures."""
    monkeypatch.setattr(grams, "SLICE", 150)
    rows = [*made(150, 5), (3, "Of the. of THE; of\tthe  of the\x0bof the:x", "en"), (None, "of the" * 2, None), (900, "one two " * 400, "en")]
    got = collocations.collocations(rows_of(spark, rows), least=4, sample=sample, sample_least=sample_least)
    want = plain_collocations(rows, 4)
    assert {tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score", "_covered").collect()} == want
    top = [tuple(r) for r in collocations.best(got, 5, 3).select("lang", "rank", "phrase", "score").collect()]
    expected = []
    for lang in {w[0] for w in want}:
        mine = sorted((w for w in want if w[0] == lang and not w[7]), key=lambda w: (-w[6], -w[2], w[1].encode()))[:5]
        expected += [(lang, i, w[1], w[6]) for i, w in enumerate(mine, 1)]
    assert sorted(top) == sorted(expected)


def test_collocations_counts_beyond_64_bits(spark):
    a, l, r = 2**62, 2**62 + 5, 2**62 + 9  # noqa: E741
    score = F.expr("2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(score).head()[0] == 2000000 * a // (l + r)


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, " \n", "en")]):
        assert collocations.collocations(rows_of(spark, rows)).count() == 0


# filter audit


def plain_audit(rows, labels):
    parts = collections.defaultdict(list)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        mine = [x for x in labels if i is not None and x[0] == i]
        parts[lang or ""].append((fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part, docs in parts.items():
        removed_by = collections.Counter()
        found = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, own in enumerate(order):
                before = order[:step]
                left = [d for d in docs if not any(d[0][k] for k in before)]
                gone = [d for d in left if d[0][own]]
                removed_by[own] += len(gone)
                all_fail = [d for d in docs if d[0][own]]
                found.append((own, (part, order, step + 1, len(left) - len(gone), len(gone), len(all_fail) - len(gone), sum(sum(d[0].values()) == 1 for d in all_fail), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*row, removed_by[own]) for own, row in found]
    return out


def test_filter_audit(spark):
    draw = random.Random(3)
    text = lambda: " ".join(draw.choice(["a", "b", "C#", "D", *map(str, range(400))]) for _ in range(draw.choice([3, 150, 250, 300])))
    texts = [*[text() for _ in range(40)], "AB cd", "x " * 300, None, ""]
    rows = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(5, "same text", "en"), (5, "same text", "en"), (6, "same text", "fr"), (None, "same text", "en")]
    labels = [(draw.choice([None, *range(60)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(60)]
    table = spark.createDataFrame([(*x, "z", "z") for x in labels], "doc_id long, quality int, toxic int, _id string, text string")
    got = filter_audit.audit(rows_of(spark, rows), table)
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows, labels))
    assert filter_audit.audit(rows_of(spark, rows), table.limit(0)).count() == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit(rows_of(spark, []), table).count() == 0


def test_filter_audit_with_other_filters(spark):
    """Two filters of the caller's own, and that of copies: six orders of three steps."""
    own = lambda t: {"short": F.length(t) < 3, "digit": t.rlike("[0-9]")}
    rows = [(1, "a", "en"), (2, "abc", "en"), (3, "abc", "en"), (4, "ab1", "en"), (5, "1", "en")]
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in filter_audit.audit(rows_of(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), failures=own).collect()}
    assert len(got) == 18 and got["shortdigitE", 1] == (3, 2, 0, 1) and got["shortdigitE", 2] == (2, 1, 1, 1) and got["shortdigitE", 3] == (1, 1, 0, 1)
