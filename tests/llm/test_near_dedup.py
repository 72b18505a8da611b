"""Near-duplicate classes against brute force over all pairs."""

import random
import string

import pytest

from docengine.llm import near_dedup


def shingles(text):
    words = [w.strip(string.punctuation) or w for w in text.lower().split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_classes(rows):
    """Least id of what identical texts and five-word Jaccard similarities of 0.8 or more connect."""
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys, sets = list(texts), [shingles(t) for t in texts]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, t in enumerate(keys):
        least[find(k)] = min([least.get(find(k), 10**9), *texts[t]])
    return sorted((i, least[find(k)]) for k, t in enumerate(keys) for i in texts[t])


@pytest.mark.parametrize("split", [2048, 2])
def test_near_classes(frame, monkeypatch, split):
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    r = random.Random(1)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One two."), (5, "   "), (6, "a b a b a b a b a b"), (7, "a b a b a b a b a b a b a b a b")]
    for _ in range(12):
        base = [word() for _ in range(150)]
        rows.append((len(rows) + 1, " ".join(base)))
        for edits in (0, 1, 2, 3, 12):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(150)] = word()
            rows.append((len(rows) + 1, " ".join(copy)))
    for _ in range(30):
        rows.append((len(rows) + 1, " ".join([word() for _ in range(40)] + passage)))
    big = [word() for _ in range(100)]
    for _ in range(60):
        copy = list(big)
        copy[r.randrange(100)] = word()
        rows.append((len(rows) + 1, " ".join(copy)))
    rows.append(rows[-1])
    got = near_dedup.near_classes(frame([(i, t, "s") for i, t in rows])).select("_id", "_class").collect()
    assert sorted(map(tuple, got)) == brute_classes(rows)


@pytest.mark.parametrize("split", [2048, 2])
def test_pairs_beside_a_hot_passage(frame, monkeypatch, split):
    """Pairs of similarity 0.80 to 0.87 that repeat a phrase differently often, in buckets whose pivots are texts of the same passage that neither is similar to."""
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    r = random.Random(5)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    rows = []
    add = lambda words: rows.append((len(rows) + 1, " ".join(words)))
    for n in range(16):
        passage, phrase = [word() for _ in range((60, 24)[n % 2])], [word() for _ in range(5)]
        copies = [passage + phrase * times + [word() for _ in range((5, 3)[n % 2])] for times in (12, 30)]
        a, b = (shingles(" ".join(c)) for c in copies)
        assert 0.8 <= len(a & b) / len(a | b) < 0.87
        for c in copies:
            add(c)
        for _ in range(20):
            other = [word() for _ in range(len(passage) // 3)]
            add(passage + phrase * 2 + other)
            add(passage + phrase * 2 + other + [word()])
    want = brute_classes(rows)
    assert len({c for _, c in want}) == 336
    got = near_dedup.near_classes(frame([(i, t, "s") for i, t in rows])).select("_id", "_class").collect()
    assert sorted(map(tuple, got)) == want


def test_empty(frame):
    assert near_dedup.near_classes(frame([])).count() == 0
    assert near_dedup.near_classes(frame([(None, "a b", "s"), (None, None, "s")])).count() == 2
