"""Native text functions: folding, normal forms, patterns and detectors. All take and give columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters of Spanish, French and German, and what they fold to.
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncyyAAAAAEEEEIIIIOOOOOUUUUNCY"

# Stems that mark a legal question, folded.
LEGAL_STEMS = (
    "ley", "leyes", "articulo", "reglamento", "decreto", "codigo", "constitucion", "derecho", "derechos", "tramite", "multa", "multas", "sancion", "sanciones",
    "delito", "delitos", "pena", "penas", "amparo", "denuncia", "licencia", "permiso", "adopcion", "tortura", "amnistia", "juridic", "legislacion", "normativ",
    "tribunal", "juez", "abogado", "demanda", "contrato",
)
# Phrases that try to turn the assistant away from its instructions.
INJECTION = (
    "ignora.{0,20}(instruccion|regla|prompt)",
    "olvida.{0,20}(instruccion|regla|que eres|prompt)",
    "actua como (si fueras|un|otro)",
    "eres ahora (un|otro)",
    "(nuevo|otro) (rol|personaje|character)",
    "disregard (previous|prior|your) instructions",
    "pretend (you are|to be)",
)
# Whole utterances that are small talk, folded, without punctuation.
GREETING = "(hola+|ol+a|hey|hi|hello|saludos|buen[oa]s?( ?(dias?|tardes?|noches?))?|que ?tal|como ?(estas?|va|andas?))"
THANKS = "((muchas|mil) ?gracias|gracias|thank ?you|thanks)"
FAREWELL = "(adios|hasta ?(luego|pronto)|nos ?vemos|bye|chau)"
# Words that stay in lower case inside a law's name.
SMALL_WORDS = ("de", "del", "la", "las", "los", "el", "y", "e", "o", "u", "en", "para", "a", "al", "por", "con", "sobre", "que", "su", "sus", "se", "un", "una")


def fold(text: Column) -> Column:
    """Accents off, one character for one; letters outside the table stay."""
    return F.translate(text, ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def nfkd_fold(texts: pd.Series) -> pd.Series:
    """Accents off by Unicode decomposition, for letters beyond :data:`ACCENTED`."""

    def one(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return texts.map(one)


def collapse(text: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " "))


def law_key(name: Column) -> Column:
    """Folded, lower case, trimmed: for lookups by law name."""
    return F.lower(F.trim(fold(name)))


def entity_key(name: Column) -> Column:
    """Folded, upper case, letters and digits with single blanks: for matching mentioned laws."""
    return F.trim(F.regexp_replace(F.upper(fold(name)), "[^A-Z0-9]+", " "))


def name_key(name: Column) -> Column:
    """Folded, upper case, single blanks, punctuation kept: for catalogue names."""
    return collapse(F.upper(fold(name)))


def content_key(text: Column) -> Column:
    """Key of an article's body: header off, folded, letters and digits with single blanks, 250 characters."""
    bare = F.regexp_replace(fold(text), r"(?i)^\s*(articulo|art\.)\s*\.?\s*[\w\- ]{1,12}?[.\-]+\s*", "")
    return F.left(F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " ")), F.lit(250))


def like_pattern(name: str) -> str:
    """ILIKE pattern that takes any text between a name's folded words; wildcards in it are escaped."""
    folded = name.translate(str.maketrans(ACCENTED, PLAIN)).lower().split()
    escaped = ["".join("\\" + c if c in "\\%_" else c for c in word) for word in folded]
    return "%" + "%".join(escaped) + "%" if escaped else "%%"


def like_pattern_of(name: Column) -> Column:
    """:func:`like_pattern` of a column of names."""
    folded = F.lower(fold(name))
    escaped = F.regexp_replace(folded, r"([\\%_])", r"\\$1")
    return F.concat(F.lit("%"), F.array_join(F.filter(F.split(escaped, r"\s+"), lambda w: w != ""), "%"), F.lit("%"))


def matches_name(column: Column, name: str) -> Column:
    """Whether a law name holds the words of ``name`` in order, whatever their case and accents."""
    return fold(column).ilike(like_pattern(name))


def contains_words(column: Column, needle: str) -> Column:
    """Words of ``needle`` in order, case-insensitive, accents significant; a blank needle fits all."""
    words = needle.split()
    if not words:
        return F.lit(True)
    return column.rlike("(?isu)" + ".*".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words))


def is_legal(text: Column) -> Column:
    """Whether a word begins with one of :data:`LEGAL_STEMS`."""
    return F.lower(fold(text)).rlike(r"(^|[^a-z0-9_])(" + "|".join(LEGAL_STEMS) + ")")


def is_injection(text: Column) -> Column:
    """Whether a text tries to override the assistant's instructions."""
    return F.lower(text).rlike("|".join(f"({p})" for p in INJECTION))


def small_talk(text: Column) -> Column:
    """``greeting``, ``thanks`` or ``farewell`` if that is all a text says, else null."""
    said = F.trim(F.regexp_replace(F.lower(fold(text)), r"[\s!-/:-@\[-`{-~¡¿]+", " "))
    return (
        F.when(said.rlike(f"^{GREETING}$"), "greeting").when(said.rlike(f"^{THANKS}$"), "thanks").when(said.rlike(f"^{FAREWELL}$"), "farewell")
    )


def is_repealed(content: Column) -> Column:
    """Whether nothing but a repeal note is left of an article once header and brackets are off."""
    body = F.regexp_replace(fold(content), r"(?i)^\s*articulo\s+\S+\s*[.\-]*\s*", "")
    return F.regexp_replace(body, r"\([^)]*\)", "").rlike(r"(?i)^[\s.]*se\s+deroga[\s.]*$")


def not_current_law(name: Column) -> Column:
    """Catalogue entries that are not laws in force."""
    upper = F.upper(fold(name))
    return upper.contains("ABROGAD") | upper.startswith("DECLARATORIA")


def canonical_name(name: Column) -> Column:
    """Law name with capitals except for :data:`SMALL_WORDS`, accents and a final stop off."""
    words = F.split(collapse(F.regexp_replace(F.lower(fold(name)), r"[.\s]+$", "")), " ")
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.initcap(w)))
    return F.array_join(cased, " ")


def url_key(url: Column, aliases: dict[str, str] | None = None) -> Column:
    """URL for comparison: percent codes decoded (a plus stays), hosts by alias, trimmed, lower case; empty for none."""
    out = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    for old, new in (aliases or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(F.lower(F.trim(out)), F.lit(""))


def source_of(url: Column, hosts: dict[str, str]) -> Column:
    """Source name by the host that a URL holds, else null."""
    out = F.lit(None).cast("string")
    for host, source in reversed(hosts.items()):
        out = F.when(F.lower(url).contains(host), source).otherwise(out)
    return out


def table_cells(line: Column) -> Column:
    """Cells of a table row, trimmed."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))


def flat_tables(text: Column) -> Column:
    """Markdown tables as lines ``first cell: heading: value; heading: value``; a table needs its line of rules."""
    lines = F.split(text, "\n", -1)
    row = lambda x: (F.length(F.trim(x)) >= 1) & F.trim(x).startswith("|") & F.trim(x).endswith("|")
    rules = lambda x: F.trim(x).rlike(r"^\|?[\s:|-]+\|?$")
    each = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.coalesce(row(x) & (F.length(F.trim(x)) >= 2) & rules(F.get(lines, i + 1)), F.lit(False)).alias("heads")))
    none = F.lit(None).cast("array<string>")

    def told(heads: Column, line: Column) -> Column:
        cells = table_cells(line)
        n = F.least(F.size(heads), F.size(cells))
        rest = F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.concat(F.get(heads, k - 1), F.lit(": "), F.get(cells, k - 1))), "; ")
        return F.when(n > 1, F.concat(F.get(cells, 0), F.lit(": "), rest)).otherwise(F.get(cells, 0))

    def step(s: Column, x: Column) -> Column:
        inside = s.heads.isNotNull() & row(x.line)
        state = lambda heads, skip, out: F.struct(heads.alias("heads"), skip.alias("skip"), out.alias("out"))
        return (
            F.when(s["skip"], state(s.heads, F.lit(False), s.out))
            .when(inside, state(s.heads, F.lit(False), F.concat(s.out, F.array(told(s.heads, x.line)))))
            .when(x.heads, state(table_cells(x.line), F.lit(True), s.out))
            .otherwise(state(none, F.lit(False), F.concat(s.out, F.array(x.line))))
        )

    begin = F.struct(none.alias("heads"), F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(each, begin, step)["out"], "\n")


def plain_markdown(text: Column) -> Column:
    """Markdown to plain text: tables flattened, then fences, emphasis, headings, inline code and stray stars off."""
    out = F.when(text.contains("|"), flat_tables(text)).otherwise(text)
    # The marks, in the order in which they go.
    for pattern, kept in (
        (r"(?s)```[a-zA-Z]*\n?(.*?)```", "$1"), (r"(?s)\*\*(.*?)\*\*", "$1"), (r"(?s)__(.*?)__", "$1"), (r"(?sU)(?<!\w)\*(.+?)\*(?!\w)", "$1"),
        (r"(?sU)(?<!\w)_(.+?)_(?!\w)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"`([^`]+)`", "$1"),
    ):
        out = F.regexp_replace(out, pattern, kept)
    return F.replace(out, F.lit("*"), F.lit(""))


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\r\n\f\x0b]+"), lambda w: w != "")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds."""
    asked = F.array_distinct(words(query))
    return F.size(F.array_intersect(asked, words(text))) / F.greatest(F.size(asked), F.lit(1))


def split_pieces(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters: by line, and by sentence where a line is longer; a longer sentence stays whole.

    Lines end at every kind of line end and are joined by a line feed; blank lines at the beginning of a piece go. A text
    within the limit is one piece, unchanged.
    """
    if len(text) <= limit:
        return [text]
    done, piece = [], ""
    for line in text.splitlines():
        fits = len(line) <= limit
        for i, part in enumerate([line] if fits else re.split(r"(?<=[.;:])\s+", line)):
            longer = piece + (" " if i else "\n") + part if piece else part
            if (fits or i) and len(longer) <= limit:
                piece = longer
                continue
            if piece:
                done.append(piece)
            piece = part
    return done + [piece] if piece else done


#: Texts that are Python objects at a time while they are cut.
AT_ONCE = 256


def pieces(content: Column, limit: int = 900) -> Column:
    """:func:`split_pieces` of a column; the open piece depends on all before it, so a text is read in order, once.

    Of a batch only :data:`AT_ONCE` texts and their pieces are Python objects at a time.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        kind, done = pa.list_(pa.string()), []
        for at in range(0, len(texts), AT_ONCE):
            some = texts.slice(at, AT_ONCE).to_pylist()
            done.append(pa.array([None if t is None else split_pieces(t, limit) for t in some], kind))
        out = pa.concat_arrays(done) if done else pa.array([], kind)
        pa.default_memory_pool().release_unused()
        return out

    return split(content)
