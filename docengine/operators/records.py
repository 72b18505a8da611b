"""Chunk records: full references, defaults of metadata, counts by document and over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a title that stay small (fixed values).
SMALL_WORDS = ("a", "as", "o", "os", "e", "da", "das", "de", "do", "dos", "em", "na", "no")
#: Small letters that upper() makes several letters of, and the one capital that Unicode has for each.
ONE_CAPITAL = tuple(map("".join, zip(*[(c.lower(), c) for c in map(chr, range(0x1E00, 0x2000)) if c != c.lower() and len(c.lower()) == 1 and len(c.lower().upper()) > 1], strict=True)))
#: Types of documents that state doctrine (fixed values).
DOCTRINAL_TYPES = ("confession_of_faith", "catechism", "doctrinal_canons")
#: What parts of a resolution are called in references (fixed values).
RESOLUTION_PARTS = {"resolution_heading": "Cabeçalho", "resolution_ementa": "Ementa", "resolution_intro": "Texto introdutório", "signature": "Assinatura"}
#: Values of normative sources that have none of their own (fixed values).
NORMATIVE_CATEGORY, DOCTRINAL_CATEGORY = "denominational_normative_document", "doctrinal_document"
DENOMINATION, TRADITION = "Aliança das Igrejas Evangélicas Congregacionais do Brasil", "congregacional"


def title_case(title: Column | str) -> Column:
    """Words with a capital each, small words but for the first without; a letter that two capitals would stand for takes its one capital, if there is one, or stays; null for an empty title."""
    words = F.split(F.trim(F.lower(title)), r"\s+")
    letter = lambda w: F.substring(w, 1, 1)
    first = lambda w: F.when(F.length(F.upper(letter(w))) > 1, F.translate(letter(w), *ONE_CAPITAL)).otherwise(F.upper(letter(w)))
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.concat(first(w), w.substr(F.lit(2), F.length(w)))))
    return F.when(F.length(title) > 0, F.array_join(cased, " "))


def full_reference(label: Column, style: Column) -> Column:
    """A chunk's place in its document, from the label of the document down.

    Columns structure_type, chapter_number, chapter_title, section_number, section_title, subsection_title,
    article_display, paragraph_number, inciso, alinea; empty ones are left out. style: chapters (numbers of chapter and
    section), titles (titles of section and subsection), paragraphs (chapter with title, paragraph), resolution (named parts, chapter).
    """
    c = lambda name: F.nullif(F.col(name), F.lit(""))
    plus = lambda prefix, name: F.concat(F.lit(prefix), c(name))
    chapter, kind = plus("Capítulo ", "chapter_number"), F.coalesce("structure_type", F.lit(""))
    sign = F.when((c("paragraph_number") == "único") & (style != "resolution"), "Parágrafo único").otherwise(plus("§ ", "paragraph_number"))
    head = [F.when(style.isin("chapters", "resolution"), chapter), F.when(style == "chapters", plus("Seção ", "section_number")), F.when(style == "titles", title_case("section_title")), F.when(style == "titles", title_case("subsection_title"))]
    item = [c("article_display"), sign, plus("inciso ", "inciso"), F.when(style != "resolution", plus("alínea ", "alinea"))]
    part = F.element_at(F.create_map(*[F.lit(x) for pair in RESOLUTION_PARTS.items() for x in pair]), kind)
    named = F.when(kind == "preamble", "PREÂMBULO").when(style == "resolution", F.coalesce(part, F.when(kind == "resolution_considerando", F.concat(F.lit("Considerando "), F.coalesce(c("paragraph_number"), F.lit("None"))))))
    paragraph = F.concat_ws(", ", label, chapter, title_case("chapter_title"), plus("parágrafo ", "paragraph_number"))
    return F.when(named.isNotNull(), F.concat_ws(", ", label, named)).when(style == "paragraphs", paragraph).otherwise(F.concat_ws(", ", label, *head, *item))


def first_given(*columns: str) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Chunks with what their metadata lack, taken from the next best column; doctrinal documents are marked so. Text stays as it is.

    Columns document_id, doc_id, document, document_title, document_type, source_path, source_category, denomination,
    tradition, tradition_branch, full_reference, section_reference, chapter_reference, section_title, chapter_title,
    document_structure_type, chunk_type, biblical_references, is_doctrinal, content_role.
    """
    normative = F.coalesce(F.replace("source_path", F.lit("\\"), F.lit("/")).contains("/normative/"), F.lit(False))
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    found = chunks.withColumn("document_id", F.trim(first_given("document_id", "doc_id")))
    found = found.withColumn("document", F.trim(first_given("document", "document_title", "document_id"))).withColumns({
        "doc_id": first_given("doc_id", "document_id"),
        "source_category": given("source_category", F.when(normative, NORMATIVE_CATEGORY).otherwise(DOCTRINAL_CATEGORY)),
        "denomination": given("denomination", F.when(normative, DENOMINATION).otherwise("")),
        "tradition": given("tradition", F.when(normative, TRADITION).otherwise(F.lower(F.coalesce("tradition_branch", F.lit(""))))),
        "full_reference": first_given("full_reference", "section_reference", "chapter_reference", "section_title", "chapter_title"),
        "document_structure_type": first_given("document_structure_type", "chunk_type"),
        "biblical_references": F.coalesce("biblical_references", F.array().cast("array<string>")),
    })
    doctrinal = F.coalesce(F.trim("document_type").isin(*DOCTRINAL_TYPES), F.lit(False)) & (F.col("source_category") == DOCTRINAL_CATEGORY)
    return found.withColumns({
        "document_title": first_given("document_title", "document"),
        "is_doctrinal": F.when(doctrinal, True).otherwise(F.col("is_doctrinal")),
        "content_role": F.when(doctrinal & (F.col("content_role") == "normative"), "doctrinal").otherwise(F.col("content_role")),
    })


def chunk_counts(chunks: DataFrame, longest: int = 3200) -> DataFrame:
    """document_id, chunk_count, chunk_types (a map of counts), long_chunks, most_chars, article_count of (document_id, chunk_type, article_number, text).

    Counts meet by type first, so that a document's chunks are never gathered.
    """
    size = F.length("text")
    by_type = chunks.groupBy("document_id", "chunk_type").agg(F.count("*").alias("n"), F.count_if(size > longest).alias("long"), F.max(size).alias("most"))
    articles = chunks.groupBy("document_id").agg(F.count_distinct("article_number").alias("article_count"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_type", F.lit("")), "n"))))
    return by_type.groupBy("document_id").agg(F.sum("n").alias("chunk_count"), types.alias("chunk_types"), F.sum("long").alias("long_chunks"), F.max("most").alias("most_chars")).join(articles, "document_id")


def consolidated(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """document_id, chunk_count, expected_count, issue: the chunks that each document has in the corpus against what its own run made (document_id, expected_count)."""
    both = counts.select("document_id", "chunk_count").join(expected, "document_id", "full").na.fill(0, ["chunk_count", "expected_count"])
    return both.withColumn("issue", F.when(F.col("chunk_count") != F.col("expected_count"), "consolidated_count_does_not_match_document_sum"))
