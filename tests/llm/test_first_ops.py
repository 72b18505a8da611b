"""Exact dedup, mixing, repetition coverage and byte-level BPE against plain Python."""

import collections
import hashlib
import math
import re
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docengine.llm import bpe, exact_dedup, mixing, repetition

TEXTS = ["", None, "a", "a", "a b", "b a", "long " * 300 + "x", "long " * 300 + "y", "long " * 300 + "x", "  ", "\n\n", "Ünï ß 汉字 🙂 don't\r\n x\x85y z"]


def test_exact_groups(frame):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, "a", "s"), (None, "a", "s"), (None, None, None)]
    got = exact_dedup.exact_groups(frame(rows)).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids)) for i in ids]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["_id"], r["_keep"], r["_size"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["_kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_copies(frame(rows))
    assert kept.columns == frame(rows).columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(frame([])).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share, cap, share the rest again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("block", [200_000, 7])
def test_mixing(frame, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(i, "w " * (i % 17), ["a", "b", None, "c", "a", "a"][i % 6]) for i in range(400)] + [(7, None, "empty"), (7, None, "empty"), (None, "x y", "a")]
    got = mixing.systematic_mix(frame(rows)).collect()
    again = mixing.systematic_mix(frame(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["_source_size"] == sizes[r["_source"]] and math.isclose(r["_target"], want[r["_source"]], abs_tol=1e-6)
        assert 0 <= r["_copies"] <= 2
        taken[r["_source"]] += r["_copies"] * r["_size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 34
    copies = mixing.mixed(frame(rows))
    assert copies.columns == frame(rows).columns and copies.count() == sum(r["_copies"] for r in got)
    assert mixing.mixed(frame([])).count() == 0


def brute_repetition(text):
    words = re.findall(repetition_word, text)
    out, later = {}, {}
    for n in (8, *repetition.NGRAM_LIMITS):
        at = collections.defaultdict(list)
        for i in range(len(words) - n + 1):
            at[tuple(words[i : i + n])].append(i)
        out[n] = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + n)}
        later[n] = {j for p in at.values() for i in p[1:] for j in range(i, i + n)}
    seen, dup = set(), []
    for line in text.split("\n"):
        if re.search(repetition_word, line):
            dup += [line] if line in seen else []
            seen.add(line)
    chars = lambda found: sum(len(words[i]) for i in found)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(dup), len(out[8]), sum(len("".join(re.findall(repetition_word, x))) for x in dup), *[chars(later[n]) for n in repetition.NGRAM_LIMITS])


repetition_word = r"[^\x20\x09-\x0D]+"


def test_repetition(frame):
    texts = [*TEXTS, "a b c d e f g h " * 3, "one two three four five six\nx\none two three four five six\n x\nx", "é ü " * 40, "# $ <b>\n\n#\x0b&|", "a a a a a a a a a a a"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["_id"]: tuple(r[c] for c in repetition.COUNTS) for r in repetition.repetition_coverage(frame(rows)).collect()}
    for i, t, _ in rows:
        assert got[i] == brute_repetition(t or ""), t
    assert repetition.repetition_coverage(frame([])).count() == 0


def test_bpe_of_two_vocabularies(frame):
    """A reused worker encodes with the ranks it is given, not with those of the task before."""
    up = {bytes([i]): i for i in range(256)}
    down = {bytes([i]): 255 - i for i in range(256)}
    docs = frame([(1, "ab c", "s")]).coalesce(1)
    for ranks in (up, down, up, down):
        got = bpe.encode(docs, ranks, public_tokenizers.PATTERN)[0].collect()
        assert [bytes(r["_ids"]) for r in got] == [b"".join(ranks[bytes([x])].to_bytes(4, "little") for x in b"ab c")]


def test_bpe(frame):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, "x" * 700, "x" * 300 + " it's   fine\n\n\n" * 40, "ab " * 500, " " * 400 + "y", "é" * 650 + " we'll 123 " * 30, "a" * 130 + " b's" * 60, "<|endoftext|>" * 30]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(len(texts) - 1, texts[-1], "s")]
    got = bpe.digests(*(bpe.decode(x, ranks) for x in bpe.encode(frame(rows), ranks, public_tokenizers.PATTERN, chunk=64, overlap=32))).collect()
    want = []
    for i, t, _ in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)
    assert [x.count() for x in bpe.encode(frame([]), ranks, public_tokenizers.PATTERN)] == [0, 0]


def test_merge_long_equals_short():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for piece in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "éèüßß".encode() * 9):
        assert bpe._merge_long(piece, ranks) == bpe.merge(piece, ranks)
