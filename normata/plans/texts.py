"""Text function queries over documents, pages and literal fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from normata.functions import answers as N
from normata.functions import html as H
from normata.functions import text as X
from normata.operators import chunking as C

A, P = X.ACCENTED, X.PLAIN


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def over_documents(*columns):
    return lambda spark, d: docs(spark, d).select("doc_id", *[c() for c in columns])


FIXES = [("src1", 1, "the", "[the]", False), ("src1", 2, "[the] and", "[the and]", False), ("src2", 1, "zz zz zz", "never", False)]


def piece_rows(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(X.pieces(F.col("text"), 900)).alias("at", "piece"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.max(F.length("piece")).alias("longest"), F.sum(F.length("piece")).cast("long").alias("chars"))


def fixed_texts(spark, d):
    laws = docs(spark, d).select("doc_id", F.col("source").alias("nombre"), F.col("text").alias("raw_text"))
    fixes = spark.createDataFrame(FIXES, "law string, position int, old string, new string, once boolean")
    return C.apply_text_fixes(laws, fixes).select("doc_id", F.col("raw_text").alias("fixed"))


def marked_pages(spark, d):
    """A page for each document: its text escaped, with comments, quoted marks, raw text and furniture around it."""
    escaped = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    page = F.concat(
        F.lit("<!doctype html><title>"), "source", F.lit(" &amp;amp; &#xE9;</title><script>if (a < b) document.write('<p>no</p>')</script><NAV><p>no<nav>no</nav></p></NAV><p title=\"a > b\" data-x='</p>'>"),
        escaped, F.lit("<!-- hidden > "), "source", F.lit(" --></p><div><header>no</div>"), F.col("lang"), F.lit("<br/>&lt;"), F.col("doc_id").cast("string"), F.lit("&gt;<!-- open"), "source",
    )
    return docs(spark, d).select("doc_id", page.alias("html"))


QUERIES = {
    "html_marks": lambda s, d: marked_pages(s, d).select("doc_id", H.html_text(F.col("html")).alias("text")),
    "fold_accents": over_documents(lambda: X.fold(F.col("text")).alias("folded")),
    "law_key": over_documents(lambda: X.law_key(F.concat(F.lit("  Ley ÁÉ "), "source", F.lit(" "))).alias("law_key")),
    "content_key": over_documents(lambda: X.content_key(F.concat(F.lit("Artículo 3.- "), "text")).alias("content_key")),
    "collapse_spaces": over_documents(lambda: X.collapse(F.col("text")).alias("collapsed")),
    "name_filter": lambda s, d: docs(s, d).where(X.matches_name(F.col("text"), "Thé of")).select("doc_id"),
    "in_order_filter": lambda s, d: docs(s, d).where(X.contains_words(F.col("text"), "the And")).select("doc_id"),
    "word_overlap": over_documents(lambda: F.round(X.overlap(F.lit("the and the of zebra"), F.col("text")), 6).alias("overlap")),
    "html_to_text": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", H.html_text(F.col("html")).alias("text")),
    "embedding_pieces": piece_rows,
    "embedding_header": over_documents(lambda: C.embedding_text(F.col("source"), F.lit(None).cast("string"), F.col("lang"), F.col("doc_id").cast("string"), F.col("text")).alias("embedding_text")),
    "prompt_context": over_documents(lambda: N.prompt_context(F.col("doc_id"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text"), F.col("doc_id") % 5 == 0).alias("context")),
    "text_cuts": over_documents(lambda: N.snippet(F.col("text"), F.when(F.col("doc_id") % 5 == 0, F.col("source"))).alias("snippet"), lambda: N.rerank_query(F.col("text"), F.array("lang", "source")).alias("query")),
    "line_range": over_documents(lambda: C.line_range(F.col("text"), 2, 3).alias("lines")),
    "page_sources": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.source_of(F.col("url"), {"example.com": "uno", "example.net": "dos"}).alias("source")),
    "text_fixes": fixed_texts,
    "nfkd_fold": over_documents(lambda: X.nfkd_fold(F.col("text")).alias("folded")),
}

WS = r"'[ \t\r\n\f\x0b]+'"
# Elements that the page's end cuts off go with it; comments and tags part the text; references are decoded last.
HTML = "html"
for _tag in ("script", "style", "nav", "header", "footer"):
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}[^>]*>.*?(</{_tag}>|\\z)', chr(10), 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, '(?s)<!--.*?(-->|\\z)', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
HTML = f"regexp_replace(replace({HTML}, '&quot;', chr(34)), '&amp;?', '&', 'g')"
LINES = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f\\x0b\\x{{A0}}]+|[ \\t\\r\\f\\x0b\\x{{A0}}]+$', '', 'g')), lambda x: x <> ''), chr(10))"
ORACLE_SQL = {
    "fold_accents": f"SELECT doc_id, translate(text, '{A}', '{P}') AS folded FROM documents",
    "law_key": "SELECT doc_id, 'ley ae ' || lower(source) AS law_key FROM documents",
    "content_key": f"SELECT doc_id, left(trim(regexp_replace(lower(translate(text, '{A}', '{P}')), '[^a-z0-9]+', ' ', 'g')), 250) AS content_key FROM documents",
    "collapse_spaces": f"SELECT doc_id, trim(regexp_replace(text, {WS}, ' ', 'g')) AS collapsed FROM documents",
    "name_filter": f"SELECT doc_id FROM documents WHERE translate(text, '{A}', '{P}') ILIKE '%the%of%'",
    "in_order_filter": "SELECT doc_id FROM documents WHERE text ILIKE '%the%and%'",
    "word_overlap": f"""SELECT doc_id, round((CAST(list_contains(w, 'the') AS INT) + CAST(list_contains(w, 'and') AS INT) + CAST(list_contains(w, 'of') AS INT) + CAST(list_contains(w, 'zebra') AS INT)) / 4.0::DOUBLE, 6) AS overlap
      FROM (SELECT doc_id, string_split_regex(lower(text), {WS}) AS w FROM documents)""",
    "html_to_text": f"SELECT page_id, {LINES.format(HTML)} AS text FROM pages",
    "html_marks": f"SELECT doc_id, {LINES.format("source || ' &amp; é' || chr(10) || text || chr(10) || lang || chr(10) || '<' || doc_id || '>'")} AS text FROM documents",
    "embedding_header": "SELECT doc_id, source || ', Capitulo ' || lang || ', Articulo ' || doc_id || ': ' || text AS embedding_text FROM documents",
    "prompt_context": """SELECT doc_id, '[' || doc_id || '] ' || source || CASE WHEN doc_id % 2 = 0 THEN ', Articulo ' || lang ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' [DEROGADO]' ELSE '' END || ':' || chr(10) || text AS context FROM documents""",
    "text_cuts": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ERROR: ' || source ELSE left(text, 200) END AS snippet, left(text || ' ' || lang || ' ' || source, 600) AS query FROM documents",
    "line_range": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines FROM documents",
    "page_sources": "SELECT page_id, CASE WHEN lower(url) LIKE '%example.com%' THEN 'uno' WHEN lower(url) LIKE '%example.net%' THEN 'dos' END AS source FROM pages",
    "text_fixes": "SELECT doc_id, CASE WHEN source = 'src1' THEN replace(replace(text, 'the', '[the]'), '[the] and', '[the and]') WHEN source = 'src2' THEN replace(text, 'zz zz zz', 'never') ELSE text END AS fixed FROM documents",
    "nfkd_fold": "SELECT doc_id, strip_accents(text) AS folded FROM documents",
    "embedding_pieces": """WITH RECURSIVE l AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}])$', ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]') AS lines FROM documents WHERE length(text) > 900),
      x AS (SELECT doc_id, i, unnest(CASE WHEN length(lines[i]) <= 900 THEN [lines[i]] ELSE string_split(regexp_replace(lines[i], '([.;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) END) AS part,
        generate_subscripts(CASE WHEN length(lines[i]) <= 900 THEN [lines[i]] ELSE string_split(regexp_replace(lines[i], '([.;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) END, 1) AS j, length(lines[i]) > 900 AS long
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
      u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM x),
      f AS (SELECT doc_id, k, 1 AS piece, length(part) AS n FROM u WHERE k = 1
        UNION ALL SELECT u.doc_id, u.k, CASE WHEN f.n = 0 OR (j > 1 OR NOT long) AND f.n + 1 + length(part) <= 900 THEN f.piece ELSE f.piece + 1 END,
          CASE WHEN f.n > 0 AND (j > 1 OR NOT long) AND f.n + 1 + length(part) <= 900 THEN f.n + 1 + length(part) ELSE length(part) END FROM f JOIN u ON u.doc_id = f.doc_id AND u.k = f.k + 1),
      p AS (SELECT doc_id, piece, max(n) AS n FROM f GROUP BY 1, 2)
      SELECT doc_id, count(*) AS n_pieces, max(n) AS longest, CAST(sum(n) AS BIGINT) AS chars FROM p WHERE n > 0 GROUP BY 1
      UNION ALL SELECT doc_id, 1, length(text), CAST(length(text) AS BIGINT) FROM documents WHERE length(text) <= 900""",
}
