"""Grammars over lines: automata, the structure of canons, numbered references, and number sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.structure import BOOKS, biblical_references

#: Lines of a slice that one fold goes through.
SLICE_LINES = 64

# Lines that open something in canons of chapters with articles, rejected errors and their refutations (fixed patterns).
CANON_CHAPTER = r"(?iu)^\s*(?:(?:primeiro|segundo|terceiro|quarto|quinto)\s+cap[ií]tulo|terceiro\s+e\s+quarto\s+cap[ií]tulos|cap[ií]tulo|cap\.?)\b"
CANON_ARTICLE = r"(?iu)^\s*(?:artigo|art\.?)\s+([0-9ivxlcdm]+)\b"
CANON_REJECTION = r"(?iu)^\s*rejei[cç][aã]o de erros\s*$"
CANON_ERROR = r"(?iu)^\s*erro\s+([0-9ivxlcdm]+)\b"
CANON_REFUTATION = r"(?iu)^\s*refuta[cç][aã]o\s*$"
CANON_CONCLUSION = r"(?iu)^\s*conclus[aã]o\s*$"
#: (state, symbol, next state) of canons; what is not here leaves the state as it is.
CANON_STATES = ("start", "chapter", "article", "rejection", "error", "refutation", "conclusion")
CANON_TABLE = (
    *[(s, "chapter", "chapter") for s in CANON_STATES if s != "conclusion"], *[(s, "conclusion", "conclusion") for s in CANON_STATES], ("chapter", "article", "article"), ("chapter", "rejection", "rejection"), ("article", "rejection", "rejection"),
    ("rejection", "error", "error"), ("error", "refutation", "refutation"), ("refutation", "error", "error"),
)
#: A marker before a reference: a number and a full stop before any book, a number alone before a book that has none of its own, a number before chapter and verse without a book (fixed patterns).
NUMBERED = r"(?:sm|rs|reis|cr|j[oó]|jo[aã]o|co|cor[ií]ntios|ts|tessalonicenses|tm|tim[oó]teo|pe|pd|pedro)(?![A-Za-zÀ-ÿ])"
UNNUMBERED = rf"(?!{NUMBERED})" + BOOKS.removeprefix(r"(?:[1-3]\s*)?")
VALID_MARKER = rf"(?iu)(?<!\S)([0-9]+)(?:\.\s*(?={BOOKS}\.?\s*[0-9])|\s+(?={UNNUMBERED}\.?\s*[0-9]))"
INCOMPLETE_MARKER = r"(?<!\S)([0-9]+)\.\s+(?=[0-9]+[.:][0-9])"
BEGINS_WITH_BOOK = rf"(?iu)^\s*{BOOKS}\.?\s*[0-9]"
HOLDS_BOOK = rf"(?iu)\b{BOOKS}\.?\s*[0-9]+[:.][0-9]+"


def next_states(symbol: Column, table, states: tuple[str, ...]) -> Column:
    """What a symbol makes of each state, as an array of numbers; symbols without a rule leave all as they are."""
    number = {s: i for i, s in enumerate(states)}
    moves: dict[str, list[int]] = {}
    for state, sign, then in table:
        moves.setdefault(sign, list(range(len(states))))[number[state]] = number[then]
    same = F.array(*[F.lit(i) for i in range(len(states))])
    known = F.create_map(*[x for sign, then in moves.items() for x in (F.lit(sign), F.array(*map(F.lit, then)))])
    return F.coalesce(F.try_element_at(known, F.coalesce(symbol, F.lit(""))), same)


def line_states(lines: DataFrame, symbol: Column, table, states: tuple[str, ...], name: str = "state", slice_lines: int = SLICE_LINES) -> DataFrame:
    """Lines (document_id, line_index ...) with the state after each, of an automaton that begins each document in the first of the states.

    A document is cut into slices of line numbers. Each slice is folded into
    what it makes of every state, all slices at once; the maps of a document, one small row for each
    slice, are then gone through in order for the state that each slice begins with; last, each slice is
    folded again from there. So a very long document is as many tasks as it has slices, and only its maps meet.
    """
    kind = dict(lines.dtypes)["document_id"]
    held = [c for c in lines.columns if c != "document_id"]
    rows = lines.withColumn("_map", next_states(symbol, table, states)).withColumn("_slice", F.floor(F.col("line_index") / slice_lines))
    slices = rows.groupBy("document_id", "_slice").agg(F.array_sort(F.collect_list(F.struct("line_index", "_map", *[c for c in held if c != "line_index"]))).alias("_lines"))
    same = F.array(*[F.lit(i) for i in range(len(states))])
    whole = F.aggregate("_lines", same, lambda a, x: F.transform(a, lambda s: F.element_at(x["_map"], s + 1)))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, state = object(), 0
        for batch in batches:
            ids, maps, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, move in zip(ids, maps, strict=True):
                if i != document:
                    document, state = i, 0
                out.append(state)
                state = move[state]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["document_id", "_slice", "_start"])

    maps = slices.select("document_id", "_slice", whole.alias("_whole")).repartition("document_id").sortWithinPartitions("document_id", "_slice")
    begun = slices.join(maps.mapInArrow(starts, f"document_id {kind}, _slice long, _start int"), ["document_id", "_slice"])
    zero = F.struct(F.array().cast("array<int>").alias("all"), F.col("_start").alias("now"))
    step = lambda a, x: F.struct(F.concat(a["all"], F.array(F.element_at(x["_map"], a["now"] + 1))).alias("all"), F.element_at(x["_map"], a["now"] + 1).alias("now"))
    folded = begun.withColumn("_states", F.aggregate("_lines", zero, step, lambda a: a["all"]))
    each = folded.select("document_id", F.explode(F.arrays_zip("_lines", "_states")).alias("_x"))
    label = F.element_at(F.array(*map(F.lit, states)), F.col("_x._states") + 1)
    return each.select("document_id", *[F.col(f"_x._lines.{c}").alias(c) for c in held], label.alias(name))


def canon_symbol(line: Column | str) -> Column:
    s = F.col(line) if isinstance(line, str) else line
    out = F.lit(None).cast("string")
    for name, pattern in reversed((("chapter", CANON_CHAPTER), ("article", CANON_ARTICLE), ("rejection", CANON_REJECTION), ("error", CANON_ERROR), ("refutation", CANON_REFUTATION), ("conclusion", CANON_CONCLUSION))):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def is_reference_line(line: Column) -> Column:
    """Whether a line is made of references only: books, chapters and verses, the words e and cf."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(line, r"^[•\s]+", ""), r"(?<=[.!?])\s+[0-9]{2,4}$", ""))
    rest = F.regexp_replace(F.regexp_replace(clean, HOLDS_BOOK, ""), r"[0-9]+(?:[:.,;–\-\s]+[0-9]+)*", "")
    words = F.filter(F.regexp_extract_all(rest, F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)), lambda w: ~F.lower(w).isin("e", "cf"))
    return clean.rlike(HOLDS_BOOK) & ~clean.startswith("—") & (F.size(words) == 0)


def canon_units(lines: DataFrame) -> DataFrame:
    """document_id, unit, kind, chapter, number, heading, first_line, last_line, body, references, markers: what the lines of canons open, in order.

    A unit begins at a line that opens its state: a chapter; an article before
    the chapter's rejection of errors; the rejection; an error after it; a refutation after an error; the conclusion, which ends the canons. Lines of other
    kinds, and heads out of place, are text. references are the lines of references at the end of an article, the rest is body; markers the references in parentheses in it.
    """
    rows = line_states(lines.withColumn("_s", canon_symbol("line")), F.col("_s"), CANON_TABLE, CANON_STATES)
    upto = Window.partitionBy("document_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    first = (F.col("state") == "conclusion") & (F.lag("state").over(Window.partitionBy("document_id").orderBy("line_index")).eqNullSafe("conclusion"))
    opens = (F.col("_s") == F.col("state")) & ~first & ((F.col("_s") != "refutation") | (F.lag("state").over(Window.partitionBy("document_id").orderBy("line_index")) == "error"))
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("unit", F.sum(F.col("_opens").cast("int")).over(upto)).withColumn("chapter", F.sum((F.col("_opens") & (F.col("state") == "chapter")).cast("int")).over(upto))
    rows = rows.where("unit > 0").withColumn("_ref", ~F.col("_opens") & (F.col("state") == "article") & is_reference_line(F.col("line")))
    below = Window.partitionBy("document_id", "unit").orderBy(F.desc("line_index")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_tail", F.min("_ref").over(below))
    kept = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(what, F.struct("line_index", "line")))), lambda x: F.trim(x["line"])), " ")
    found = rows.groupBy("document_id", "unit").agg(
        F.min("state").alias("kind"), F.min("chapter").alias("chapter"), F.max(F.when(F.col("_opens"), F.trim("line"))).alias("heading"), F.min("line_index").alias("first_line"), F.max("line_index").alias("last_line"),
        kept(~F.col("_opens") & ~F.col("_tail")).alias("body"), kept(F.col("_tail")).alias("references"),
    )
    number = F.when(F.col("kind") == "article", F.regexp_extract("heading", CANON_ARTICLE, 1)).when(F.col("kind") == "error", F.regexp_extract("heading", CANON_ERROR, 1))
    return found.select("document_id", "unit", "kind", "chapter", number.alias("number"), "heading", "first_line", "last_line", "body", "references", biblical_references(F.col("body")).alias("markers"))


def reference_entries(block: Column) -> Column:
    """Array of (marker, raw, text, valid): the numbered references of a block, in order.

    A valid marker stands before a book; where there is none of those, a number before chapter and verse alone is an incomplete entry.
    """
    joined = F.trim(F.regexp_replace(block, r"\s+", " "))
    marked = F.regexp_replace(F.regexp_replace(joined, VALID_MARKER, "\x01v$1\x02$0\x03"), INCOMPLETE_MARKER, "\x01i$1\x02$0\x03")
    parts = F.slice(F.split(marked, "\x01"), 2, F.greatest(F.size(F.split(marked, "\x01")) - 1, F.lit(0)))
    def entry(x: Column) -> Column:
        head, text = F.substring_index(x, "\x03", 1), F.substring_index(x, "\x03", -1)
        return F.struct(F.substring_index(head, "\x02", 1).substr(F.lit(2), F.length(head)).alias("marker"), F.trim(F.concat(F.substring_index(head, "\x02", -1), text)).alias("raw"), F.trim(text).alias("text"), x.startswith("v").alias("valid"))
    return F.transform(parts, entry)


def answer_markers(text: Column) -> Column:
    """Distinct numbers that stand right behind a word or a mark, in order of value."""
    found = F.regexp_extract_all(text, F.lit("(?<![0-9]\\.)(?<=[A-Za-zÀ-ÿ).;:,!?\"”])([0-9]+)(?=[^0-9]|$)"), F.lit(1))
    return F.transform(F.array_sort(F.transform(F.array_distinct(found), lambda x: F.struct(x.try_cast("decimal(38,0)").alias("n"), x.alias("x")))), lambda s: s["x"])


def _once(x: Column, use) -> Column:
    """What use makes of x, where x is made once and not anew for each element of a lambda in use."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _row(marker: Column, kind: int, i: Column, *more: Column) -> Column:
    """What _by_marker groups: kind 0 for a marker of an answer, 1 for an entry of a block; i is its place among its kind."""
    return F.struct(marker.alias("marker"), F.lit(kind).alias("kind"), i.alias("i"), *more)


def _by_marker(rows: Column) -> Column:
    """Array of arrays: the rows of each marker, by kind and place. One sort, then slices between the heads of markers, so that work grows with the rows and not with their square."""
    head = lambda r: F.filter(F.transform(r, lambda x, i: F.when(~x["marker"].eqNullSafe(F.get(r, i - 1)["marker"]) | (i == 0), i)), lambda i: i.isNotNull())
    cut = lambda r, h: F.transform(h, lambda i, k: F.slice(r, i + 1, F.coalesce(F.get(h, k + 1), F.size(r)) - i))
    return _once(F.array_sort(rows), lambda r: _once(head(r), lambda h: cut(r, h)))


def reference_map(entries: Column, allowed: Column | None = None) -> Column:
    """Map from marker to reference: valid entries whose text begins with a book, of a marker's the last; only allowed markers if given."""
    rows = F.transform(F.filter(entries, lambda e: e["valid"] & e["text"].rlike(BEGINS_WITH_BOOK)), lambda e, i: _row(e["marker"], 1, i, e["text"].alias("text")))
    if allowed is not None:
        rows = F.concat(F.coalesce(F.transform(allowed, lambda m, i: _row(m, 0, i, F.lit(None).cast("string").alias("text"))), F.array()), rows)
    groups = F.filter(_by_marker(rows), lambda g: (F.element_at(g, -1)["kind"] == 1) & (F.lit(True) if allowed is None else F.get(g, F.lit(0))["kind"] == 0))
    last = F.transform(groups, lambda g: F.element_at(g, -1))
    return F.map_from_entries(F.transform(F.array_sort(F.transform(last, lambda x: F.struct(x["i"], x["marker"], x["text"]))), lambda x: F.struct(x["marker"], x["text"])))


def reference_issues(markers: Column, entries: Column, mapped: Column) -> Column:
    """Array of (marker, raw, issue): markers of the answer without a reference, each once, by what stands in the block for them, then valid entries that share a marker."""
    # sorted by place and entry: first the markers in their order, then the shared ones by number
    found = lambda place, n, i, issue: F.struct(place.alias("place"), n.cast("decimal(38,0)").alias("n"), i.alias("i"), F.lit(issue).alias("issue"))
    none, after = F.lit(None), F.lit(2**31 - 1)

    def of(es: Column, open_: Column) -> Column:
        at = lambda x: F.get(es, x["i"])

        def group(g: Column) -> Column:
            first = F.get(g, F.lit(0))
            listed = F.transform(F.slice(g, 2, F.size(g)), lambda x: found(first["i"], none, x["i"], F.when(at(x)["text"].rlike(HOLDS_BOOK), "unmapped_reference_entry").otherwise("missing_bible_book")))
            missing = F.array(found(first["i"], none, none.cast("int"), "missing_reference_entry"))
            shared = lambda valid: F.when(F.size(valid) > 1, F.transform(valid, lambda x: found(after, x["marker"].try_cast("decimal(38,0)"), x["i"], "duplicated_reference_marker_suspected"))).otherwise(F.array())
            return F.concat(F.when(first["kind"] == 1, F.array()).when(F.size(g) == 1, missing).otherwise(listed), _once(F.filter(g, lambda x: (x["kind"] == 1) & at(x)["valid"]), shared))

        rows = F.concat(F.transform(open_, lambda m, i: _row(m, 0, i)), F.transform(es, lambda e, i: _row(e["marker"], 1, i)))
        return F.transform(F.array_sort(F.flatten(F.transform(_by_marker(rows), group))), lambda x: F.struct(F.coalesce(at(x)["marker"], F.get(open_, x["place"])).alias("marker"), at(x)["raw"].alias("raw"), x["issue"]))

    return _once(entries, lambda es: _once(F.array_except(markers, F.map_keys(mapped)), lambda open_: of(es, open_)))


def trusted(numbers: list[int]) -> list[bool]:
    """Which numbers are of a longest strictly rising choice, found by patience: of equal numbers that could stand at a place the first stays."""
    tops, at, back = [], [], []
    for i, n in enumerate(numbers):
        pile = bisect_left(tops, n)
        if pile == len(tops) or tops[pile] > n:
            tops[pile : pile + 1], at[pile : pile + 1] = [n], [i]
        back.append(at[pile - 1] if pile else -1)
    out, i = [False] * len(numbers), at[-1] if at else -1
    while i >= 0:
        out[i], i = True, back[i]
    return out


def aligned(numbers: list[int]) -> list[tuple[int | None, int | None, str]]:
    """(place, expected number, status) of a run of numbers that should be 1, 2, 3 and on: ok, repeated, misread, extra, and missing ones without a place."""
    good, out, last = trusted(numbers), [], 0
    pending: list[int] = []

    def settle(before: int | None) -> None:
        due = list(range(last + 1, before)) if before is not None else []
        for i in pending:
            if numbers[i] == last:
                out.append((i, last, "repeated"))
            elif due:
                out.append((i, due.pop(0), "misread"))
            else:
                out.append((i, None, "extra"))
        out.extend((None, n, "missing") for n in due)
        pending.clear()

    for i, n in enumerate(numbers):
        if good[i]:
            settle(n)
            out.append((i, n, "ok"))
            last = n
        else:
            pending.append(i)
    settle(None)
    return out


def sequence_gaps(found: DataFrame) -> DataFrame:
    """document_id, run, line_index, number, expected, status of (document_id, line_index, number): numbers that should count up from 1, told apart.

    A 1 begins a new run. In a run a longest rising choice of numbers is ok. Between two of those, the numbers that are due are given
    to the others there in order (misread); what is left is missing, what is over is extra, and a number equal to the one before is repeated.
    A run's numbers meet in one task: as many as a document has lines of that kind.
    """
    kind = dict(found.dtypes)["document_id"]
    upto = Window.partitionBy("document_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    runs = found.withColumn("run", F.sum((F.col("number") == 1).cast("long")).over(upto))
    each = runs.groupBy("document_id", "run").agg(F.array_sort(F.collect_list(F.struct(F.col("line_index").cast("long").alias("line_index"), F.col("number").cast("long").alias("number")))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for document, number, items in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for place, expected, status in aligned([x["number"] for x in items]):
                    at = items[place] if place is not None else {"line_index": None, "number": None}
                    out.append((document, number, at["line_index"], at["number"], expected, status))
            columns = zip(*out, strict=True) if out else [()] * 6
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["document_id", "run", "line_index", "number", "expected", "status"])

    return each.mapInArrow(run, f"document_id {kind}, run long, line_index long, number long, expected long, status string")
