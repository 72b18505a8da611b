"""Articles to chunks against a plain fold over lines, and single cases."""

import random
import re

import pytest

from docengine.operators import articles as A

LINES = "document_id string, line_index long, page long, line string"
ARTICLE = re.compile(r"^Art\.?\s*([0-9]+)([º°]?)(?:\.|\s*[–—-]|\s+(?=[A-ZÁÉÍÓÚÂÊÔÃÕ]))\s*(.*)$")


def marker(line):
    if re.match(r"(?i)^Par[aá]grafo\s+[úu]nico", line):
        return "paragraph", "único"
    if m := re.match(r"^§\s*([0-9]+)([º°]?)", line):
        return "paragraph", m[1] + (m[2] or "º")
    if re.match(r"^[a-z]\)", line):
        return "alinea", line[0]
    if (m := re.match(r"(?i)^([IVXLCDM]{1,8})\s*[.\-–—]", line)) and m[1].upper() in "I II III IV V VI VII VIII IX X XI XII XIII XIV XV".split():
        return "inciso", m[1].upper()
    return None


def joined(lines):
    blocks = []
    for line in lines:
        if blocks and not (ARTICLE.match(line) or marker(line)):
            blocks[-1] = blocks[-1][:-1] + line if blocks[-1].endswith("-") else f"{blocks[-1]} {line}"
        else:
            blocks.append(line)
    return "\n\n".join(blocks)


def parts_of(text, most):
    if len(text) <= most:
        return [text]
    parts, now = [], ""
    for paragraph in text.split("\n\n"):
        more = f"{now}\n\n{paragraph}" if now else paragraph
        if len(more) <= most:
            now = more
            continue
        parts, now = (parts + [now] if now else parts), ""
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            more = f"{now} {sentence}" if now else sentence
            if len(more) <= most:
                now = more
            else:
                parts, now = (parts + [now] if now else parts), sentence
    return parts + [now] if now else parts


def plain(lines, most):
    """(structure type, paragraph, inciso, alínea, first page, last page, text) of one article."""
    whole = joined([x for _, x in lines])
    if len(whole) <= most:
        return [("normative_article", None, None, None, lines[0][0], lines[-1][0], whole)]
    state, units, prefix = {}, [], [lines[0][1]]
    for page, line in lines[1:]:
        if m := marker(line):
            state = {k: v for k, v in state.items() if k != "alinea" and (m[0] == "alinea" or k == "paragraph" != m[0])} | {m[0]: m[1]}
            units.append((m[0], dict(state), [(page, line)]))
        elif units:
            units[-1][2].append((page, line))
        else:
            prefix.append(line)
    if not units:
        return [("normative_article", None, None, None, lines[0][0], lines[-1][0], p) for p in parts_of(whole, most)]
    out = []
    for kind, s, own in units:
        out += [(kind, s.get("paragraph"), s.get("inciso"), s.get("alinea"), own[0][0], own[-1][0], p) for p in parts_of(joined(prefix + [x for _, x in own]), most)]
    return out


@pytest.mark.parametrize("most", [90, 400])
def test_chunks_against_a_fold(spark, most):
    draw = random.Random(most)
    heads = ["", "", "", "", "§ 1º ", "§ 2 ", "Parágrafo único. ", "I - ", "IV – ", "iii. ", "a) ", "b) ", "MM - ", "Art. 9º – "]
    word = lambda: draw.choice(["dever", "igreja", "membro.", "norma", "co-", "fim!"])
    rows, want = [], {}
    for d in range(30):
        lines = [(1, f"Art. {d + 1}º – Caput dever.")]
        lines += [(1 + i // 4, draw.choice(heads if i else heads[:-1]).replace("Art. 9º – ", "") + " ".join(word() for _ in range(draw.randrange(1, 9)))) for i in range(draw.randrange(14))]
        rows += [(f"d{d}", i, page, line) for i, (page, line) in enumerate(lines, 1)]
        want[f"d{d}"] = plain(lines, most)
    chunks = A.article_chunks(A.article_lines(spark.createDataFrame(rows, LINES)), most)
    got = {d: [] for d in want}
    for r in chunks.orderBy("document_id", "place").collect():
        got[r["document_id"]].append((r["structure_type"], r["paragraph_number"], r["inciso"], r["alinea"], r["page_start"], r["page_end"], r["text"]))
    assert got == want


def test_ids_contexts_and_records(spark):
    text = [
        "PREÂMBULO", "Nós, reunidos em nome de Deus,", "CAPÍTULO I", "DA IGREJA", "E DOS SEUS FINS", "SEÇÃO II DOS MEMBROS", "Art. 1º – Curto (Rm 3:21).", "Art. 2 - Longo caput.", "§ 1º Primeiro.", "I - inciso um.", "a) alínea.", "§ 1º Primeiro outra vez.",
        "CAPÍTULO II – DAS NORMAS", "Art. 3. " + "Sem itens. " * 9,
    ]
    lines = spark.createDataFrame([("const", i, 1 + i // 5, x) for i, x in enumerate(text, 1)], LINES)
    documents = spark.createDataFrame([("const", "Constituição da Aliança", "normative_ethics", "Constituição", "chapters", None, None, "pt")], "document_id string, title string, document_type string, label string, style string, default_topic string, default_subtopic string, language string")
    got = {r["chunk_id"]: r for r in A.document_chunks(lines, documents, [("membership", "duties", ("caput",))], 60).collect()}
    assert list(sorted(got)) == [
        "const_artigo-001", "const_artigo-002_paragrafo-1o", "const_artigo-002_paragrafo-1o_duplicata-02", "const_artigo-002_paragrafo-1o_inciso-i", "const_artigo-002_paragrafo-1o_inciso-i_alinea-a",
        "const_artigo-003_parte-01", "const_artigo-003_parte-02", "const_preambulo-01",
    ]
    one = got["const_artigo-001"]
    assert (one["chapter_number"], one["chapter_title"], one["section_number"], one["section_title"]) == ("I", "DA IGREJA E DOS SEUS FINS", "II", "DOS MEMBROS")
    assert one["full_reference"] == "Constituição, Capítulo I, Seção II, Art. 1º" and one["biblical_references"] == ["Rm 3:21"] and one["chunk_type"] == "ethics_article" and one["topic"] == "denominational_governance" and one["language"] == "pt"
    assert one["embedding_text"].split("\n")[0] == "Documento: Constituição da Aliança" and one["embedding_text"].endswith("Texto: " + one["text"])
    two = got["const_artigo-002_paragrafo-1o_inciso-i"]
    assert two["text"] == "Art. 2 - Longo caput.\n\nI - inciso um." and two["item_label"] == "inciso I" and two["topic"] == "membership" and two["warnings"] == ["article_split_by_structural_children"]
    assert got["const_artigo-002_paragrafo-1o_duplicata-02"]["warnings"][-1] == "duplicate_chunk_id_disambiguated"
    last = got["const_artigo-003_parte-02"]
    assert (last["chapter_number"], last["section_number"]) == ("II", None) and last["warnings"] == ["article_split_by_length_without_structural_children"]
    assert got["const_preambulo-01"]["full_reference"] == "Constituição, PREÂMBULO" and got["const_preambulo-01"]["page_start"] == 1


def test_nothing(spark):
    empty = spark.createDataFrame([], LINES)
    assert A.article_chunks(A.article_lines(empty)).count() == 0
    assert A.article_chunks(A.article_lines(spark.createDataFrame([("d", 1, 1, "sem artigo")], LINES))).count() == 0
