"""Column expressions over text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import vocab


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words_lit(words) -> Column:
    return F.array(*map(F.lit, words))


def fold_ascii(x: Column | str) -> Column:
    """Lower case, accents removed, what is still not ASCII deleted."""
    return F.regexp_replace(F.translate(F.lower(_col(x)), vocab.ACCENTED, vocab.PLAIN), r"[^\x00-\x7F]", "")


def slug(x: Column | str, empty: str = "sem-chave") -> Column:
    """Folded, other runs than letters and digits as one hyphen, none outside; a name for nothing."""
    made = F.regexp_replace(F.regexp_replace(fold_ascii(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(empty))


def scope_text(x: Column | str) -> Column:
    """Folded, other runs than letters and digits as one space, none outside."""
    return F.trim(F.regexp_replace(fold_ascii(x), "[^a-z0-9]+", " "))


def tokens(x: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores of any script, with repetitions."""
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ascii_words(x: Column | str) -> Column:
    """Distinct folded words."""
    return F.array_distinct(F.regexp_extract_all(fold_ascii(x), F.lit(r"\w+"), F.lit(0)))


def topic_terms(x: Column | str) -> Column:
    """Distinct folded words of four letters or more that are no stopwords, without the plural s of words over five."""
    kept = F.filter(ascii_words(x), lambda t: (F.length(t) >= 4) & ~F.array_contains(words_lit(vocab.TOPIC_STOPWORDS), t))
    return F.array_distinct(F.transform(kept, lambda t: F.when(t.endswith("s") & (F.length(t) > 5), F.regexp_replace(t, "s$", "")).otherwise(t)))


def significant_terms(x: Column | str) -> Column:
    """Distinct folded runs of letters and digits, four or longer, that are no stopwords."""
    found = F.array_distinct(F.regexp_extract_all(fold_ascii(x), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(found, lambda t: (F.length(t) >= 4) & ~F.array_contains(words_lit(vocab.EVIDENCE_STOPWORDS), t))


def expand_terms(terms: Column) -> Column:
    """Terms with their synonyms."""
    table = F.create_map(*[c for k, v in vocab.QUERY_TERM_EXPANSIONS.items() for c in (F.lit(k), words_lit(v))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(terms, more))


def any_pattern(x: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | x.rlike(p)
    return found


def any_marker(x: Column, markers) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | x.contains(m)
    return found


#: (action, pattern, replacement) of page normalisation, in order; the steps on white space and page numbers follow.
STEPS = (
    ("normalized_line_endings", r"\r\n?", "\n"),
    ("normalized_nbsp", "\u00a0", " "),
    ("removed_invisible_characters", "[\u200b\u200c\u200d\ufeff]", ""),
    ("removed_control_characters", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    ("recomposed_safe_hyphenation", r"(?<=[A-Za-zÀ-ÿ])-\n\s*(?=[a-zà-ÿ])", ""),
)


def squeeze_lines(x: Column) -> Column:
    """Runs of blanks as one space, none at either end of a line."""
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"(?m)^ | $", "")


def strip_page_numbers(x: Column | str) -> Column:
    """Without lines of one to three digits only at either end of the page."""
    return F.regexp_replace(F.regexp_replace(_col(x), r"\A(?:[ \t]*[0-9]{1,3}[ \t]*(?:\n|\z))+", ""), r"(?:(?:\n|\A)[ \t]*[0-9]{1,3}[ \t]*)+\z", "")


def normalized_page(x: Column | str) -> Column:
    """(text, actions): a page after all normalisation steps, and the names of those that changed it."""
    now, names = _col(x), []

    def step(name: str, after: Column) -> None:
        nonlocal now
        names.append(F.when(now != after, F.lit(name)))
        now = after

    for name, pattern, put in STEPS:
        step(name, F.regexp_replace(now, pattern, put))
    step("normalized_whitespace", squeeze_lines(now))
    step("removed_isolated_page_number", strip_page_numbers(now))
    step("normalized_excess_blank_lines", F.regexp_replace(F.regexp_replace(now, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", ""))
    actions = F.array_compact(F.array(*names))
    return F.struct(now.alias("text"), F.when(F.size(actions) == 0, F.array(F.lit("no_changes"))).otherwise(actions).alias("actions"))


def normalized_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with page_text and actions, as normalized_page() gives them; each step is a column, so none is computed again inside the next."""
    steps = [(name, lambda x, pattern=pattern, put=put: F.regexp_replace(x, pattern, put)) for name, pattern, put in STEPS]
    steps += [
        ("normalized_whitespace", squeeze_lines), ("removed_isolated_page_number", strip_page_numbers),
        ("normalized_excess_blank_lines", lambda x: F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")),
    ]
    out = pages.withColumn("_t0", F.col(text))
    for n, (_, step) in enumerate(steps):
        out = out.withColumn(f"_t{n + 1}", step(F.col(f"_t{n}")))
    actions = F.array_compact(F.array(*[F.when(F.col(f"_t{n}") != F.col(f"_t{n + 1}"), F.lit(name)) for n, (name, _) in enumerate(steps)]))
    out = out.withColumn("page_text", F.col(f"_t{len(steps)}")).withColumn("actions", F.when(F.size(actions) == 0, F.array(F.lit("no_changes"))).otherwise(actions))
    return out.drop(*[f"_t{n}" for n in range(len(steps) + 1)])


def truncated(x: Column | str, limit: Column | int) -> Column:
    """Texts over the limit cut so that the mark fits."""
    x, limit = _col(x), limit if isinstance(limit, Column) else F.lit(limit)
    room = F.greatest(F.lit(0), limit - len(vocab.TRUNCATION_MARK))
    return F.when((limit <= 0) | (F.length(x) <= limit), x).otherwise(F.concat(F.regexp_replace(x.substr(F.lit(1), room), r"\s+\z", ""), F.lit(vocab.TRUNCATION_MARK)))


def page_span(start: Column | str, end: Column | str) -> Column:
    start, end = _col(start).cast("string"), _col(end).cast("string")
    return F.when(start.isNull() & end.isNull(), F.lit("não informado")).when(end.isNull() | (start == end), start).otherwise(F.concat_ws("-", start, end))


ARTICLE = r"^Art\.?\s*([0-9]+)([º°]?)(?:\.|\s*[–—-]|\s+(?=[A-ZÁÉÍÓÚÂÊÔÃÕ]))\s*(.*)$"
CHAPTER = r"(?iu)^CAP[ÍI]TULO\s+([IVXLCDM]+|[0-9]+)\b(?:\s*(.*))?$"
SECTION = r"(?iu)^SE[ÇC][ÃA]O\s+([IVXLCDM]+|[0-9]+)\b(?:\s*(.*))?$"


def upper_heading(line: Column | str) -> Column:
    """Whether a line is a heading in capitals."""
    s = F.trim(_col(line))
    return F.length(s).between(4, 140) & ~s.rlike(ARTICLE) & ~s.rlike(CHAPTER) & ~s.rlike(SECTION) & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= 4) & (F.upper(s) == s) & (F.lower(s) != s)


def item_marker(line: Column | str) -> Column:
    """(kind, value) of a paragraph, alínea or inciso marker at the start of a line, else null."""
    s = F.trim(_col(line))
    number = F.regexp_extract(s, r"^§\s*([0-9]+)([º°]?)", 1)
    sign = F.coalesce(F.nullif(F.regexp_extract(s, r"^§\s*([0-9]+)([º°]?)", 2), F.lit("")), F.lit("º"))
    roman = F.upper(F.regexp_extract(s, r"(?i)^([IVXLCDM]{1,8})\s*(?:[.\-–—])\s*(.*)$", 1))
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(s.rlike(r"(?i)^Par[aá]grafo\s+[úu]nico"), made("paragraph", F.lit("único")))
        .when(s.rlike(r"^§\s*[0-9]+"), made("paragraph", F.concat(number, sign)))
        .when(s.rlike(r"^[a-z]\)"), made("alinea", s.substr(1, 1)))
        .when(roman.isin(vocab.ROMANS), made("inciso", roman))
    )


def roman_value(x: Column | str) -> Column:
    """Value of a roman numeral: a letter before a larger one counts against it."""
    values = F.transform(F.split(F.upper(_col(x)), ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for y in p]), c), F.lit(0)))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(F.reverse(values), zero, lambda a, v: F.struct(F.when(v < a["last"], a["total"] - v).otherwise(a["total"] + v).alias("total"), F.greatest(a["last"], v).alias("last")), lambda a: a["total"])


def parent_key(document: Column, article=None, paragraph=None, lords_day=None, chapter_reference=None, chapter_title=None, section_reference=None, section_title=None, chunk_type=None, chunk_id=None) -> Column:
    """Key of the unit that a chunk belongs to: the first of article and paragraph, catechism day, chapter, section, type, own id that is there."""
    null = F.lit(None).cast("string")
    there = lambda c: F.nullif(F.trim((null if c is None else c).cast("string")), F.lit(""))
    doc = F.coalesce(there(document), F.lit("unknown-document"))
    a, p, kind = there(article), there(paragraph), there(chunk_type)
    made = lambda name, c: F.when(there(c).isNotNull(), F.concat_ws("::", doc, F.lit(name), slug(there(c))))
    return F.coalesce(
        F.when(a.isNotNull() & p.isNotNull(), F.concat_ws("::", doc, F.lit("article"), slug(a), F.lit("paragraph"), slug(p))),
        made("article", article),
        F.when(kind == "catechism_question_answer", made("group", F.coalesce(there(lords_day), there(section_title)))),
        made("chapter", chapter_reference), made("chapter", chapter_title), made("section", section_reference), made("section", section_title), made("chunk-type", chunk_type),
        F.concat_ws("::", doc, F.lit("chunk"), slug(F.coalesce(there(chunk_id), F.lit("unknown-chunk")))),
    )


#: Greek and Hebrew letters, what stands in front of a mark or behind a bracket without a blank, and an offer to say more (fixed patterns).
FOREIGN = "[\u0370-\u03ff\u1f00-\u1fff\u0590-\u05ff]+"
CLOSED_UP = r"\s+(?=[,.;:!?])|(?<=[(\[])\s+"
OFFER = r"(?i)^(?:se\s+(?:(?:voce|você)\s+)?quiser|caso\s+(?:voce|você)\s+queira),?\s+posso\b"


def without_scripts(x: Column | str) -> Column:
    """Without Greek and Hebrew letters and the blanks they leave: none before marks, behind brackets and at either end of a line, one elsewhere."""
    closed = F.regexp_replace(F.regexp_replace(_col(x), FOREIGN, ""), CLOSED_UP, "")
    lines = F.transform(F.split(closed, "\n"), lambda line: F.regexp_replace(F.regexp_replace(line, r"[ \t\f\x0b]{2,}", " "), r"^[ \t\f\x0b]+|[ \t\f\x0b]+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\A\s+|\s+\z", "")


def without_trailing_offer(x: Column | str) -> Column:
    """Paragraphs that are not blank, without a last one that offers more."""
    paragraphs = F.filter(F.split(F.regexp_replace(_col(x), r"\A\s+|\s+\z", ""), r"\n{2,}"), lambda p: F.trim(p) != "")
    return F.array_join(F.when(F.trim(F.try_element_at(paragraphs, F.lit(-1))).rlike(OFFER), F.slice(paragraphs, 1, F.size(paragraphs) - 1)).otherwise(paragraphs), "\n\n")


def compacted_citations(text: Column, n: Column) -> Column:
    """(text, numbers): the valid [n] of a text numbered anew in order of first use, and the numbers they had."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    used = F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n)))
    # two passes, so that a new number is never taken for an old one
    marked = F.aggregate(used, text, lambda t, x: F.replace(t, F.concat(F.lit("["), x.cast("string"), F.lit("]")), F.concat(F.lit("[\x01"), F.array_position(used, x).cast("string"), F.lit("]"))))
    return F.struct(F.replace(marked, F.lit("[\x01"), F.lit("[")).alias("text"), used.alias("numbers"))
