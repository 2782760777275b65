"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from normata.functions import answers as N
from normata.functions import text as X
from normata.sources import tables as S


def test_constraints(spark):
    ok = spark.createDataFrame([("user",), (None,)], "role string")
    assert S.checked(ok).count() == 2
    with pytest.raises(Exception, match="role may not be"):
        S.checked(spark.createDataFrame([("robot",)], "role string")).collect()


def test_texts_and_binaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\ndos")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    assert [r.raw_text for r in S.read_law_texts(spark, f"{tmp_path}/a.txt").collect()] == ["uno\ndos"]
    assert [r.length for r in S.read_binaries(spark, str(tmp_path)).collect()] == [4]


def test_catalog_rows(spark):
    html = """<table><tr><td>1</td><td>Ley <b>Uno</b></td><td><a href="https://h.example/u.pdf?x=1">pdf</a></td></tr>
      <tr onclick="window.open('https://h.example/d.pdf')"><td>2</td><td>Ley Dos</td></tr><tr><td>3</td><td>No</td><td><a href="https://h.example/x.doc">doc</a></td></tr></table>"""
    out = S.catalog_by_link(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r.nombre, r.source_url) for r in out] == [("Ley Uno", "https://h.example/u.pdf?x=1"), ("Ley Dos", "https://h.example/d.pdf")]


def test_turn_rows(spark):
    turns = spark.createDataFrame([(1, 0, "q", "a", True, None), (1, 1, "q2", None, None, "e" * 5000)], "conversation_id int, turn int, question string, answer string, grounded boolean, error string")
    out = S.turn_rows(turns).orderBy("position").collect()
    assert [(r.role, r.found_answer, len(r.error_message or "")) for r in out] == [("user", None, 0), ("assistant", True, 0), ("user", None, 0), ("assistant", None, 4000)]


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    told = one(N.plan(lit('```json\n{"subpreguntas": ["Uno  es?", "uno es?", "Q", "Dos", "Tres", "Cuatro"], "areas": [" A ", ""]}\n```'), lit("q")))
    assert told.subpreguntas == ["Uno es?", "Dos", "Tres"] and told.areas == ["a"]
    assert one(N.plan(lit("nada"), lit("q"))).subpreguntas == []
    assert one(N.claims(lit("nada"))) is None and one(N.claims(lit('{"claims": []}'))) == []
    assert one(N.trim_to_sentence(lit("Uno. Ver Art. 5 y"))) == "Uno."
    assert one(N.strip_disclaimer(lit("Texto.\n\nAviso."), "Aviso.")) == "Texto.\n\n"
    assert one(N.storable_url(lit("http://old.x/a b.pdf"), {"old.x": "new.x"})) == "http://new.x/a%20b.pdf"
    assert one(N.has_filler(lit("Claro.\n\nNo hay datos. Suele pasar."), N.first_paragraph(lit("Claro.\n\nNo hay datos. Suele pasar.")))) is False
    assert one(X.plain_markdown(lit("# T\n**b** `c` * x\n| a | b |\n|---|---|\n| 1 | 2 |"))) == "T\nb c  x\n1: b: 2"
    assert one(X.nfkd_fold(lit("Ångström ñ"))) == "Angstrom n"
    assert one(X.source_of(lit("http://A.example/x"), {"a.example": "a"})) == "a"


def test_rebuilding_relations_is_idempotent(spark, tmp_path):
    edges = spark.createDataFrame([(1, "reforma"), (2, "deroga")], "id int, relation_type string")
    for _ in range(2):
        S.rebuild_relations(edges, f"{tmp_path}/edges")
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 2


def test_dense_search_with_odd_vectors(spark):
    from normata.operators import retrieval as R

    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [None, 1.0]), (7, [2.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = R.dense_search(chunks, asked, 2, 0.1).orderBy("position").collect()
    assert [(r.query_id, r.chunk_id, round(r.similarity, 6)) for r in got] == [(1, 1, 1.0), (1, 7, 1.0)]
    assert R.dense_search(chunks, asked.limit(0), 2).count() == 0 and R.dense_search(chunks.limit(0), asked, 2).count() == 0


def test_a_load_reads_laws_in_parts_without_a_row_for_each_line(spark, tmp_path):
    parts = [(i % 3, "Ley Uno", i, f"Articulo {i // 3 + 1}.- Uno segun el\narticulo 90. de esta ley.\n(REFORMADO)\n12") for i in range(60)]
    laws = spark.createDataFrame(parts, "id int, nombre string, part long, raw_text string")
    whole = spark.createDataFrame([(k, "Ley Uno", "\n".join(t for i, _, _, t in parts if i == k)) for k in range(3)], "id int, nombre string, raw_text string")
    told = lambda df: sorted(map(tuple, df.select("document_id", "position", "articulo_numero", "content").collect()))
    assert told(S.chunk_rows(laws, "m1")) == told(S.chunk_rows(whole, "m1")) and S.chunk_rows(whole, "m1").count() == 60
    plan = S.chunk_rows(laws, "m1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") <= 2 and "RLIKE" not in plan  # pieces are rows, lines are not
    log = S.ingest(spark, laws, f"{tmp_path}/chunks", f"{tmp_path}/log", "m1")
    assert {r.document_id: r.chunks_created for r in log.collect()} == {0: 20, 1: 20, 2: 20}
