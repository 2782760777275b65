"""The table functions in SQL, on edge cases."""

from normata.functions import tables as T
from normata.operators import chunking as C
from normata.operators import relations as L


def test_laws_in_sql_are_those_of_the_frame(spark):
    T.register(spark)
    texts = [
        "PREAMBULO\nTITULO PRIMERO\nCAPITULO I\nArticulo 1.- Uno.\nCAPITULO II\nArticulo 2.- Dos.\nTÍTULO DECIMO SEXTO\nArticulo 3.- Tres.",
        "Articulo 3.- Segun el\nARTICULO 9o. de la ley.\nArticulo 4.- x.\n12\nsigue\n\n", "Articulo 1.- Uno.\nT R A N S I T O R I O S\nArticulo 1.- Fuera.", "nada", "", None,
        "CAPITULO II DE LO CIVIL\nArticulo 5.- sin punto\nARTICULO 6.\nARTICULO 6.- x.",
    ]
    laws = spark.createDataFrame([(i, "Ley Uno", t) for i, t in enumerate(texts)], "id long, nombre string, raw_text string")
    T.lines_view(laws, "lines_of_laws")
    got = spark.sql("SELECT * FROM chunk_law(TABLE(lines_of_laws) PARTITION BY id ORDER BY at)")
    want = C.chunk_laws(laws)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert want.count() == 8


def test_pieces_and_markers(spark):
    T.register(spark)
    rows = [(1, "corto"), (2, "línea\n" * 400), (3, None), (4, "")]
    spark.createDataFrame(rows, "id long, content string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT * FROM split_pieces(TABLE(some_texts))").collect()
    assert [(r.at, r.total) for r in got if r.id == 2] == [(1, 3), (2, 3), (3, 3)] and {r.id for r in got} == {1, 2, 4}
    assert all(len(r.content) <= 900 for r in got)
    said = "(REFORMADO, P.O. 1 DE MAYO DE 2001) (SE ADICONA, x) DEROGACIÓN PUBLICADA EN EL P.O.)\nREFORMA PUBLICADA EN EL P.O. 2)\n(ADICIONADO Y\nREFORMADO)"
    chunks = spark.createDataFrame([(1, 10, "5", said), (1, 11, None, None), (2, 12, "6", "sin nada")], "document_id int, chunk_id long, articulo_numero string, content string")
    chunks.createOrReplaceTempView("some_chunks")
    told = lambda df: sorted(map(tuple, df.select("document_id", "chunk_id", "articulo_numero", "extraction_method", "source_text").collect()))
    assert told(spark.sql("SELECT * FROM extract_markers(TABLE(some_chunks))")) == told(L.extract_markers(chunks))
    assert spark.sql("SELECT * FROM extract_markers(TABLE(SELECT * FROM some_chunks WHERE false))").count() == 0


def test_a_row_of_the_view_holds_a_whole_text(spark):
    T.register(spark)
    rows = [(1, "Ley Uno", 1, "ARTICULO 2.- Dos."), (1, "Ley Uno", 0, "Articulo 1.- Uno.\nCAPITULO II DE LO CIVIL\n12"), (2, "Ley Dos", 0, "Articulo 5.- x.\nT R A N S I T O R I O S\nArticulo 1.- Fuera.")]
    laws = spark.createDataFrame(rows, "id long, nombre string, part int, raw_text string")
    for strict in (False, True):
        T.lines_view(laws, "whole_laws", strict)
        assert spark.table("whole_laws").count() == len(rows)
        got = spark.sql("SELECT * FROM chunk_law(TABLE(whole_laws) PARTITION BY id ORDER BY at)")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, C.chunk_laws(laws, strict).collect()), key=repr)
