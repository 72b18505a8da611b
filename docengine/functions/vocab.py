"""Closed vocabularies that rules branch on. All are fixed values, needed as they are for equal results."""

#: Accented letters and what they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿºª"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyoa"

DOCTRINAL_CHUNK_TYPES = (
    "doctrinal_article", "confessional_paragraph", "confession_paragraph", "confessional_section", "catechism_question_answer", "error_refutation", "conclusion_paragraph", "numbered_doctrinal_point",
)
DOCTRINAL_DOCUMENT_TYPES = ("confession_of_faith", "catechism", "doctrinal_canons")
NORMATIVE_DOCUMENT_TYPES = ("constitution", "internal_regiment", "normative_ethics", "administrative_resolution")
INTRODUCTORY_CHUNK_TYPES = ("introductory_context", "preface", "summary", "index", "bibliographic_note", "special_layout")
NON_RETRIEVABLE_CHUNK_TYPES = ("special_layout", "signature")

# Term sets, folded to ASCII (folded texts are matched against them).
DOCTRINAL_TERMS = [
    "doutrina", "ensina", "ensino", "salvacao", "batismo", "eleicao", "justificacao", "pecado", "pecados", "queda", "humano", "humana", "humanos", "humanas", "regeneracao", "regenerado", "regenerada",
    "regenerados", "regeneradas", "regenerar", "chamado", "vocacao", "eficaz", "expiacao", "escrituras", "sacramentos", "perseveranca", "fe", "graca", "doutrinario", "doutrinarios",
]
NORMATIVE_TERMS = [
    "alianca", "constituicao", "regimento", "codigo", "etica", "resolucao", "filiacao", "filiada", "filiado", "igreja", "local", "deveres", "ordenacao", "ministro", "ministerio", "pastor", "disciplina",
    "emancipacao", "congregacao", "campo", "missao", "missoes", "missionario", "missionarios", "contribuicao", "candidato", "requisito", "requisitos", "processo", "artigo", "inciso", "paragrafo",
    "diretoria", "conselho",
]
DENOMINATIONAL_SCOPE_TERMS = ["alianca"]
CONGREGATIONAL_SCOPE_TERMS = ["alianca", "congregacional", "congregacionais"]
DOCTRINAL_BRIDGE_TERMS = ["doutrina", "doutrinaria", "doutrinario", "professada", "professado", "confissao", "escrituras", "escritura", "fe"]
INSTITUTIONAL_TERMS = [
    "governo", "norma", "normas", "normativo", "normativa", "normativos", "normativas", "institucional", "institucionais", "constituicao", "regimento", "codigo", "etica", "decisoes", "conciliares",
    "resolucoes", "resolucao", "igreja", "igrejas", "filiada", "filiadas", "ministro", "ministros", "pastor", "pastores",
]
SPECIFIC_DOCUMENT_TERMS = ["westminster", "londres", "batista", "dort", "heidelberg", "catecismo", "canones", "constituicao", "regimento", "codigo", "etica", "resolucao"]

TOPIC_STOPWORDS = [
    "para", "pela", "pelo", "como", "qual", "quais", "trata", "tratar", "significa", "significado", "responda", "explique", "sobre", "tradicao", "reformada", "reformado", "ensina", "ensino", "alianca",
    "evangelicas", "evangelica", "brasil", "constituicao", "regimento", "codigo", "acordo", "conforme", "segundo", "documentos", "documento", "corpus", "pergunta", "capitulo", "chapter", "section",
    "secao", "confissao", "catecismo", "canones",
]
EVIDENCE_STOPWORDS = [
    "a", "as", "o", "os", "um", "uma", "de", "da", "do", "das", "dos", "em", "no", "na", "nos", "nas", "para", "por", "com", "sobre", "segundo", "documentos", "documento", "reformados", "reformado",
    "disponiveis", "disponivel", "doutrina", "esta", "qual", "quais", "que", "e", "trata", "tratar", "significa", "significado", "explique", "explica", "defina", "definicao", "papel", "funcao",
    "funciona", "funcionamento", "estabelece", "estabelecem", "ensina", "tradicao", "reformada", "corpus", "ativo", "posicao",
]
REGENERATION_TERMS = [
    "regeneracao", "regenerado", "regenerada", "regenerados", "regeneradas", "regenerar", "regenera", "regenerador", "regeneradora", "vivificacao", "vivificar", "vivifica", "nascimento", "renovacao",
]
QUERY_TERM_EXPANSIONS = {"expiacao": ["satisfacao", "sacrificio", "sangue", "morte", "cristo", "redencao"]} | {t: [u for u in REGENERATION_TERMS if u != t] for t in REGENERATION_TERMS}
OUTSIDE_MARKERS = (
    "nao esta no corpus", "fora do corpus", "documento nao disponivel", "documento nao esta disponivel", "nao incluido no corpus", "nao incluida no corpus", "nao incluidos no corpus", "nao incluidas no corpus",
)
FOLLOWUP_MARKERS = (
    "resposta anterior", "pergunta anterior", "nao entendi", "nao compreendi", "explique melhor", "explica melhor", "mais simples", "mais claro", "isso", "isto", "esse ponto", "essa parte",
    "o que voce quis dizer", "o que quis dizer",
)
CLARIFICATION_MARKERS = tuple(m for m in FOLLOWUP_MARKERS if m not in ("pergunta anterior", "isso", "isto", "esse ponto", "essa parte"))
FOLLOWUP_PRONOUNS = ["ele", "ela", "eles", "elas", "isso", "isto", "essa", "esse", "aquilo"]

#: document id -> label and folded aliases.
DOCUMENT_ALIASES = (
    ("regimento-interno-alianca-2022", "Regimento Interno da Aliança", ("regimento interno", "regimento interno da alianca", "regimento da alianca", "regimento")),
    ("constituicao-alianca-2022", "Constituição da Aliança", ("constituicao da alianca", "constituicao")),
    ("codigo-etica-ministro-alianca", "Código de Ética do Ministro Congregacional", ("codigo de etica", "codigo de etica do ministro", "codigo de etica ministerial")),
    ("resolucao-alianca-01-2020", "Resolução Aliança nº 01/2020", ("resolucao alianca", "resolucao 01 2020", "resolucao")),
    ("confissao-fe-congregacional-alianca", "Confissão de Fé Congregacional", ("confissao de fe congregacional", "confissao congregacional", "confissao da alianca")),
    ("confissao-batista-londres-1689", "Confissão Batista de Londres de 1689", ("confissao batista de londres", "confissao batista", "londres 1689")),
    ("confissao-fe-westminster", "Confissão de Fé de Westminster", ("confissao de fe de westminster", "confissao de westminster", "westminster")),
    ("catecismo-heidelberg", "Catecismo de Heidelberg", ("catecismo de heidelberg", "heidelberg")),
    ("canones-de-dort", "Cânones de Dort", ("canones de dort", "canones", "dort")),
)
COMPARATIVE_PATTERNS = (
    r"\bcompar(?:e|ar|acao|ativo|ativa)\b", r"\brelacion(?:e|ar|a|am|ado|ada|amento)\b", r"\bconect(?:e|ar|a|am|ado|ada)\b", r"\ba\s+luz\s+de\b", r"\bem\s+conjunto\s+com\b", r"\bjunto\s+com\b",
    r"\bentre\s+(?:os|as|o|a)?\b",
)
OVERVIEW_PATTERNS = (
    r"\bquais\s+(?:responsabilidades|deveres|regras|orientacoes|requisitos|documentos)\b", r"\bo\s+que\s+.+\b(?:diz|ensina|trata|orienta|estabelece)\b",
    r"\bcomo\s+.+\b(?:trata|orienta|explica|regula|estabelece)\b", r"\b(?:resuma|liste|sintetize|explique)\b",
)
INVENTORY_PATTERNS = (r"\bquais\s+(?:sao\s+)?(?:documentos|fontes|normas)\b", r"\b(?:documentos|fontes|normas)\s+.+\b(?:orientam|regem|disciplinam|tratam)\b")
TRUNCATION_MARK = "\n\n[TRUNCADO POR LIMITE DE CONTEXTO]"
ROMANS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV"]
