"""Licence texts and notices in documents: Dice coefficient over word bigrams of windows that slide over the text, against templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import slices, text_of

#: Licence notices by identifier (fixed values: public short notices). The full texts lie in license_texts.
NOTICES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
FULL_TEXTS = tuple((f.stem, f.read_text()) for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))
TEMPLATES = NOTICES + FULL_TEXTS
#: Least Dice coefficient of a match.
LEAST = 0.8
WORDS = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits in lower case; so line ends, comment marks and punctuation do not count."""
    return WORDS.findall(text.lower())


class Templates:
    """Word bigrams of all templates, numbered: how often each template has each, and which templates have one."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least, self.names, self.sizes = least, [], []
        self.words: dict[str, int] = {}
        rows: list[tuple[int, int]] = []
        for name, text in templates:
            split = words_of(text)
            if len(split) < 2:
                continue
            ids = [self.words.setdefault(w, len(self.words)) for w in split]
            rows += [(len(self.names), a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]
            self.names.append(name)
            self.sizes.append(len(ids) - 1)
        of, keys = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 2
        self.bigrams, number = np.unique(keys, return_inverse=True)
        pairs, self.often = np.unique(number * (len(self.names) + 1) + of, return_counts=True)
        self.template = pairs % (len(self.names) + 1)
        self.start = np.searchsorted(pairs // (len(self.names) + 1), np.arange(len(self.bigrams) + 1))
        self.size = np.array(self.sizes, np.int64)

    def found(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of a text's bigrams, the places of those that a template has, and their numbers."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        n = max(len(ids) - 1, 0)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if n else np.zeros(0, np.int64)
        keys = ids[at] << 32 | ids[at + 1] if n else at
        number = np.searchsorted(self.bigrams, keys)
        good = self.bigrams[np.minimum(number, len(self.bigrams) - 1)] == keys if len(self.bigrams) else np.zeros(len(keys), bool)
        return n, at[good], number[good]

    def scores(self, text: str) -> list[tuple[float, int]]:
        """(score, template) of all templates that reach `least` in some window.

        A window has as many bigrams as the template, or all of a shorter text. With n bigrams in the
        window and m in the template the score is 2 shared / (n + m), so a text of n bigrams
        needs m <= n (2 - least) / least, and a template that shares fewer than
        least (n + m) / 2 bigrams with the whole text is passed over.
        """
        n, at, number = self.found(text)
        if not len(at):
            return []
        unique, counts = np.unique(number, return_counts=True)
        spans = self.start[unique + 1] - self.start[unique]
        flat = np.repeat(self.start[unique] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        shared = np.bincount(self.template[flat], np.minimum(self.often[flat], np.repeat(counts, spans)), len(self.size))
        width = np.minimum(self.size, n)
        out = []
        for t in np.flatnonzero(shared * 2 >= self.least * (width + self.size) - 1e-9).tolist():
            mine = flat[self.template[flat] == t]
            allowed = np.zeros(len(self.bigrams), np.int64)
            allowed[np.searchsorted(self.start, mine, "right") - 1] = self.often[mine]
            score = 2 * self.best_window(at, number, allowed, int(width[t]), n) / int(width[t] + self.size[t])
            if score >= self.least - 1e-9:
                out.append((score, t))
        return out

    @staticmethod
    def best_window(at: np.ndarray, number: np.ndarray, allowed: np.ndarray, width: int, n: int) -> int:
        """The most bigrams that a window of `width` shares, of each no more than allowed. The k-th of equal ones counts in windows that begin after the one `allowed` places before it."""
        use = allowed[number] > 0
        at, number = at[use], number[use]
        order = np.lexsort((at, number))
        at, number = at[order], number[order]
        back = np.arange(len(at)) - allowed[number]
        same = (back >= 0) & (number[np.maximum(back, 0)] == number)
        low = np.maximum(np.where(same, at[np.maximum(back, 0)] + 1, 0), np.maximum(at - width + 1, 0))
        change = np.bincount(low, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        return int(np.cumsum(change)[: n - width + 1].max())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per document: _id, _matches (templates found anywhere in the text), _license and _score (the best of them, of equal ones the longest, then the first name; null if none).

    Texts are normalised to words, so a notice is found inside a line, wrapped over
    lines or behind comment marks. The templates are a fixed parameter and go to
    the tasks with the function. A task holds one text's numbers at a time. No shuffle.
    Null, empty and wordless texts match nothing. Repeated rows give repeated
    results; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in slices(batches):
            found = [known.scores(text) for text in batch.column(1).to_pylist()]
            best = [min(x, key=lambda m: (-round(m[0], 9), -known.sizes[m[1]], known.names[m[1]]), default=None) for x in found]
            columns = [pa.array(map(len, found), pa.int64()), pa.array([x and known.names[x[1]] for x in best], pa.string()), pa.array([x and x[0] for x in best], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", "_matches", "_license", "_score"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _matches long, _license string, _score double")


def oracle() -> str:
    """The same in DuckDB SQL: running counts of shared bigrams over all windows of all texts that share enough with a template."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    words = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return rf"""
        WITH t AS (SELECT t, name, {pairs} AS b FROM (SELECT t, name, {words.format('x')} AS w FROM (VALUES {values}) v(t, name, x))),
             g AS (SELECT t, b, count(*) AS allowed FROM (SELECT t, unnest(b) AS b FROM t) GROUP BY ALL),
             z AS (SELECT t, name, len(b) AS m FROM t),
             d AS (SELECT doc_id, row_number() OVER () AS r, {words.format("coalesce(text, '')")} AS w FROM documents),
             p AS (SELECT r, len(w) - 1 AS n, unnest(range(0, len(w) - 1)) AS place, unnest({pairs}) AS b FROM d WHERE len(w) > 1),
             h AS (SELECT p.r, p.n, p.place, p.b, g.t, g.allowed FROM p JOIN g USING (b)),
             c AS (SELECT r, t, n, least(m, n) AS width, m FROM (SELECT r, t, n, sum(least(k, allowed)) AS shared FROM (SELECT r, t, n, b, any_value(allowed) AS allowed, count(*) AS k FROM h GROUP BY r, t, n, b) GROUP BY r, t, n)
                   JOIN z USING (t) WHERE shared * 2 >= {LEAST} * (least(m, n) + m) - 1e-9),
             o AS (SELECT r, t, c.n, c.width, c.m, place, greatest(coalesce(prior + 1, 0), place - c.width + 1, 0) AS low
                   FROM (SELECT h.*, list(place) OVER (PARTITION BY r, t, b ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before, before[len(before) - allowed] AS prior
                         FROM h SEMI JOIN c USING (r, t)) h JOIN c USING (r, t)),
             e AS (SELECT r, t, s, sum(x) AS x FROM (SELECT r, t, low AS s, 1 AS x FROM o UNION ALL SELECT r, t, place + 1, -1 FROM o) GROUP BY ALL),
             f AS (SELECT r, t, s, sum(x) OVER (PARTITION BY r, t ORDER BY s) AS shared FROM e),
             s AS (SELECT c.r, c.t, 2.0::DOUBLE * max(shared) FILTER (s <= n - width) / (any_value(width) + any_value(m)) AS score FROM f JOIN c USING (r, t) GROUP BY c.r, c.t),
             best AS (SELECT r, count(*) AS n, first(name ORDER BY round(score, 9) DESC, m DESC, name) AS name, max(score) AS score FROM s JOIN z USING (t) WHERE score >= {LEAST} - 1e-9 GROUP BY r)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, name AS license, round(score, 6) AS score FROM d LEFT JOIN best USING (r)"""
