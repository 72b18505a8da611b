"""Licence texts and notices against counting every window."""

from collections import Counter

import pytest

from docengine.llm import licenses


def brute(text, templates, least=licenses.LEAST):
    """(score, name) of each template's best window, counted window by window."""
    words = licenses.words_of(text)
    grams = list(zip(words, words[1:], strict=False))
    found = []
    for name, template in templates:
        w = licenses.words_of(template)
        want = Counter(zip(w, w[1:], strict=False))
        m = sum(want.values())
        width = min(m, len(grams))
        best = max((2 * sum((Counter(grams[i : i + width]) & want).values()) / (width + m) for i in range(len(grams) - width + 1)), default=0) if width else 0
        if best >= least - 1e-9:
            found.append((round(best, 6), name))
    return found


FULL = dict(licenses.FULL_TEXTS)
NAMES = {
    "Released under the MIT License.": "MIT",
    "Copyright 2020 Example Ltd. Released under the MIT License.": "MIT",
    "text before\n# Released under\n# the MIT\n# License.\nand after": "MIT",
    FULL["MIT"].replace(" ", "\n// ", 40): "MIT",
    " ".join(["many other words stand here"] * 50) + FULL["ISC"] + " ".join(["and after it"] * 50): "ISC",
    FULL["GPL-2.0"]: "GPL-2.0",
    FULL["Apache-2.0"].upper(): "Apache-2.0",
    FULL["BSD-2-Clause"]: "BSD-2-Clause",
    FULL["BSD-3-Clause"]: "BSD-3-Clause",
    " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This licence is unlike all others.": None,
    "": None,
    None: None,
    "!!! ...": None,
    "word": None,
}


def test_notices_wrapped_embedded_and_whole_texts(spark, frame):
    rows = [(i, t, "s") for i, t in enumerate(NAMES)]
    got = {r["_id"]: r for r in licenses.scan(frame(rows + rows[:1])).collect()}
    assert [got[i]["_license"] for i in range(len(rows))] == list(NAMES.values())
    assert licenses.scan(frame(rows[:2] + rows[:2])).count() == 4 and licenses.scan(frame(rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_scores_against_every_window(seed):
    import random

    pick = random.Random(seed)
    templates = licenses.NOTICES + tuple((n, t) for n, t in licenses.FULL_TEXTS if len(t) < 2_000)
    known = licenses.Templates(templates, licenses.LEAST)
    parts = [t for _, t in templates] + ["x y z", "of the software of the software", "in the", "the MIT License the MIT License"]
    for _ in range(12):
        text = " ".join(pick.choice(parts) for _ in range(pick.randint(0, 3)))
        words = [w for w in text.split() if pick.random() > 0.08]
        for _ in range(len(words) // 15):
            words.insert(pick.randrange(len(words)), pick.choice(["the", "software", "foo"]))
        text = " ".join(words)
        assert sorted((round(s, 6), known.names[t]) for s, t in known.scores(text)) == sorted(brute(text, templates))
