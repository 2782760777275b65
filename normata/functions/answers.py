"""Answers and model output: parsing decisions, plans and claims, and guarding what is said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normata.functions.text import fold

# An admission of missing information, and adverbs of mere habit, folded and in lower case.
ADMISSION = (
    r"\bno (hay|tengo|contiene|contienen|existe|existen|se encontro|se encontraron|encontre|cuento con|incluye|incluyen|"
    r"especifica|especifican|aparece|aparecen|menciona|mencionan)\b[^.]{0,60}\b(informacion|datos|articulos?|disposiciones|detalles|fragmentos|especific\w*)"
)
HABIT = r"\b(generalmente|normalmente|usualmente|habitualmente|por lo general|tipicamente|suele|suelen|comunmente|por lo regular)\b"
# Abbreviations whose stop ends no sentence, and the label of the part on what an answer does not cover.
ABBREVIATIONS = ("art", "arts", "fr", "fracc", "num", "núm", "no", "p", "pp", "inc", "cap", "sec", "lic", "dr", "sr", "sra")
NOT_COVERED = "Que no cubre"
# The actions of a decision, and what stands for no value.
ACTIONS = ("busqueda_general", "busqueda_por_ley", "articulo_especifico", "historial_ley", "ninguna")
NULLISH = ("", "NULL", "NONE", "NINGUNA", "NINGUNO", "N/A", "-")
DECISION = "struct<accion:string,ley:string,articulo:string>"

# Everyday wordings (patterns over folded lower-case text) and the legal terms they stand for.
SYNONYMS = (
    (r"sin testamento|sin dejar testamento|muer\w* intestad\w*|fallec\w* intestad\w*|\bintestad\w*\b", "sucesion legitima quienes tienen derecho a heredar orden de herederos"),
    (r"\b(tumb|cort|tal|derrib)\w* (un |el |los |las |mi |su )?(arbol|arboles)\b|\btala\b|\bdesmont\w+", "tala de arboles aprovechamiento forestal sustentable autorizacion sanciones"),
    (r"pas\w+ (un |el )?(alto|semaforo)|multa\w* de transito|infraccion\w* de transito|me infraccionaron", "infracciones de transito sanciones vialidad movilidad y transporte"),
    (r"discapacidad|discapacitad\w*|silla de ruedas", "derechos de las personas con discapacidad inclusion apoyos"),
    (r"\b(pozo|manantial|arroyo)\b.*\bagua\b|\bagua\b.*\b(pozo|manantial)\b", "aprovechamiento de aguas concesion permiso extraccion de agua"),
    (r"(atend\w+|trat\w+) mal.*(hospital|clinica|medico|doctor)|(hospital|clinica|medico|doctor).*(trato|atendio|atendieron) mal", "derechos de los usuarios de servicios de salud queja atencion medica"),
    (
        r"contamin\w+ .{0,25}\b(agua|rio|arroyo|laguna|manantial)\w*|\b(agua|rio|arroyo)s? .{0,15}contamin|\b(tir|ech|descarg|verti|arroj)\w+ .{0,40}\b(rio|arroyo|laguna|barranca|agua)\b|aguas (negras|residuales)",
        "descargas de aguas residuales en cuerpos o corrientes de agua prevencion y control de la contaminacion del agua sanciones",
    ),
    (
        r"\b(terreno|zona|tierra|predio|rancho|finca)s? (de |para |con uso )?(agricola|cultivo|siembra|sembrad)\w*|\buso agricola\b|\btierras? de (cultivo|siembra)\b|\bparcela\b",
        "areas no urbanizables vocacion agropecuaria uso de suelo programas de desarrollo urbano construccion",
    ),
    (
        r"\b(licencia|permiso|autorizacion)\w* .{0,20}\b(constru\w+|edific\w+|obra)\b|\b(constru\w+|edific\w+|levantar) .{0,25}\b(permiso|licencia|autorizacion)\w*",
        "licencia de uso de suelo y construccion autorizacion desarrollo urbano municipio",
    ),
    (r"\b(orilla|ribera|margen|cerca|junto)\w* (de|del|a) (un |el |la )?(rio|arroyo|laguna)\b", "cauces zonas de riesgo proteccion de cuerpos de agua ordenamiento territorial asentamientos humanos"),
)


def expand_synonyms(question: Column, rules=SYNONYMS) -> Column:
    """The question with the legal terms of all rules that it meets, in their order."""
    plain = F.lower(fold(question))
    return F.concat_ws(" ", question, *[F.when(plain.rlike(pattern), F.lit(terms)) for pattern, terms in rules])


def has_filler(answer: Column, scope: Column | None = None) -> Column:
    """Whether an answer admits that information is missing (within ``scope``) and yet tells what is usual."""
    plain = lambda c: F.lower(fold(c))
    return plain(answer if scope is None else scope).rlike(ADMISSION) & plain(answer).rlike(HABIT)


def strip_filler(answer: Column, scope: Column | None = None) -> Column:
    """The answer without sentences on what is usual, if it admits a gap; unchanged if nothing would be left.

    What stands between paragraphs stays as it is; with a paragraph that goes, what stands before it goes.
    """
    paragraphs, between = F.split(answer, r"\n\s*\n", -1), F.regexp_extract_all(answer, F.lit(r"(\n\s*\n)"), 1)

    def kept(paragraph: Column, i: Column) -> Column:
        sentences = F.filter(F.split(paragraph, r"(?<=[.!?])\s+"), lambda s: ~F.lower(fold(s)).rlike(HABIT))
        text = F.array_join(sentences, " ")
        return F.when(F.trim(text) != "", F.concat(F.coalesce(F.get(between, i - 1), F.lit("")), text)).otherwise("")

    clean = F.regexp_replace(F.array_join(F.transform(paragraphs, kept), ""), r"^\s+|\s+$", "")
    return F.when(has_filler(answer, scope) & (clean != ""), clean).otherwise(answer)


def first_paragraph(answer: Column) -> Column:
    return F.split(answer, r"\n\s*\n")[0]


def decision(raw: Column) -> Column:
    """struct(accion, ley, articulo) from JSON, or from lines ACCION:, LEY:, ARTICULO:; null if neither names an action.

    Actions that lack what they need fall back to a general search; article suffixes are kept.
    """
    parsed = F.from_json(raw, DECISION)
    line = lambda label: F.regexp_extract(raw, rf"(?im)^\s*{label}\s*:\s*(.+?)\s*$", 1)
    pick = lambda field, label: F.coalesce(parsed[field], F.when(line(label) != "", line(label)))
    clean = lambda c: F.when(~F.upper(F.trim(c)).isin(*NULLISH), F.trim(c))
    action = F.lower(F.regexp_replace(F.trim(pick("accion", "ACCION")), "[.,;]+$", ""))
    law = clean(pick("ley", "LEY"))
    number = F.regexp_extract(F.coalesce(clean(F.regexp_replace(F.trim(pick("articulo", "ARTICULO")), "[.,;]+$", "")), F.lit("")), r"\d+[\s-]?[A-Za-z]*", 0)
    article = F.when(number != "", F.trim(number))
    lacking = (
        (action == "busqueda_por_ley") & law.isNull()
        | (action == "articulo_especifico") & (law.isNull() | article.isNull())
        | (action == "historial_ley") & law.isNull()
    )
    safe = F.when(lacking, "busqueda_general").otherwise(action)
    return F.when(action.isin(*ACTIONS), F.struct(safe.alias("accion"), law.alias("ley"), article.alias("articulo")))


def research_guard(answer: Column) -> Column:
    """:func:`strip_filler` for an answer in parts: the gap is admitted in the first, and the part on what is not covered stays."""
    parts = F.split(answer, "\n\n", -1)
    last = F.array_position(F.transform(parts, lambda p: F.left(p, F.lit(40)).contains(NOT_COVERED)), F.lit(True))
    n = F.when(last > 0, last - 1).otherwise(F.size(parts)).cast("int")
    core, rest = F.slice(parts, 1, n), F.slice(parts, n + 1, F.size(parts))
    text = F.array_join(core, "\n\n")
    return F.when(n == 0, answer).otherwise(F.array_join(F.concat(F.array(strip_filler(text, F.get(core, 0))), rest), "\n\n"))


def plan(raw: Column, question: Column, limit: int = 3) -> Column:
    """struct(subpreguntas, areas) of a plan in JSON (fences off); both empty if it cannot be read.

    Subquestions: blanks collapsed, 300 characters, distinct whatever their case, not the question itself,
    ``limit`` of them. Areas: the first six, in lower case.
    """
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(bare, "struct<subpreguntas:array<string>,areas:array<string>>")
    none = F.array().cast("array<string>")
    subs = F.transform(parsed.subpreguntas, lambda s: F.left(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(300)))
    low = F.transform(subs, lambda s: F.lower(s))
    first = F.filter(subs, lambda s, i: (s != "") & (F.lower(s) != F.lower(F.trim(question))) & (F.array_position(low, F.lower(s)) == i + 1))
    areas = F.filter(F.transform(parsed.areas, lambda a: F.lower(F.trim(a))), lambda a: a != "")
    return F.struct(F.slice(F.coalesce(first, none), 1, limit).alias("subpreguntas"), F.slice(F.coalesce(areas, none), 1, 6).alias("areas"))


def claims(raw: Column) -> Column:
    """Checked claims (texto, respaldado, fragmento) from JSON; null if it cannot be read, an empty array if there are none."""
    parsed = F.from_json(raw, "struct<claims:array<struct<texto:string,respaldado:boolean,fragmento:int>>,bad:string>", {"columnNameOfCorruptRecord": "bad"})
    filled = lambda c: F.struct(F.coalesce(c.texto, F.lit("")).alias("texto"), F.coalesce(c.respaldado, F.lit(False)).alias("respaldado"), c.fragmento.alias("fragmento"))
    empty = F.array().cast("array<struct<texto:string,respaldado:boolean,fragmento:int>>")
    return F.when(parsed.isNotNull() & parsed.bad.isNull(), F.coalesce(F.transform(parsed.claims, filled), empty))


def trim_to_sentence(text: Column) -> Column:
    """Text up to its last full stop that ends no legal abbreviation; unchanged but for blanks at its end if there is none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")
    letter = "A-Za-zÁÉÍÓÚáéíóúñÑ"
    whole = F.regexp_extract(bare, rf"(?s)^(.*(?<!(?<![{letter}])(?i:{'|'.join(ABBREVIATIONS)}))[.!?])(?=\s|$)", 1)
    return F.when(whole != "", whole).otherwise(bare)


def strip_disclaimer(text: Column, disclaimer: str) -> Column:
    """Text without a closing disclaimer."""
    return F.when(text.endswith(disclaimer), F.left(text, F.length(text) - len(disclaimer))).otherwise(text)


def error_kind(status: Column, body: Column) -> Column:
    """gone, auth, quota or transient, from a failed call's status and body."""
    return (
        F.when(status.isin(404, 410), "gone").when(status.isin(401, 403), "auth")
        .when((status == 402) | (status == 429) & F.lower(body).rlike("quota|credit|insufficient|billing"), "quota").otherwise("transient")
    )


def snippet(answer: Column, error: Column) -> Column:
    """What a golden run keeps of an answer, or of the error in its place: 200 characters."""
    return F.left(F.when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).otherwise(F.coalesce(answer, F.lit(""))), F.lit(200))


def rerank_query(question: Column, subquestions: Column) -> Column:
    """A question and its subquestions as one text for reranking: 600 characters."""
    return F.left(F.concat_ws(" ", question, subquestions), F.lit(600))


def prompt_context(position: Column, law: Column, article: Column, content: Column, repealed: Column) -> Column:
    """One numbered source of a prompt, marked if its article is repealed."""
    mark = F.when(repealed, " [DEROGADO]").otherwise("")
    return F.concat(F.lit("["), position.cast("string"), F.lit("] "), law, F.coalesce(F.concat(F.lit(", Articulo "), article), F.lit("")), mark, F.lit(":\n"), content)


def storable_url(url: Column, aliases: dict[str, str] | None = None) -> Column:
    """URL with host aliases applied and its path, whatever its form, encoded once; query and fragment stay."""
    out = url
    for old, new in (aliases or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    part = lambda i: F.regexp_extract(out, r"^([a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)(.*)$", i)
    path = F.coalesce(F.try_url_decode(F.replace(part(2), F.lit("+"), F.lit("%2B"))), part(2))
    encoded = F.url_encode(path)
    for code, sign in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    return F.concat(part(1), encoded, part(3))
