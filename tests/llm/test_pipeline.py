import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from normata.llm import packing


def write_tables(spark, folder):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgklmnpr" for b in "aeiou" for c in ("n", "st", "lt", "rm")]
    sentence = lambda: " ".join(rng.choices(words, k=9)).capitalize() + ". "
    clean = {i: "".join(sentence() for _ in range(20)) for i in range(80)}
    items = {i: " ".join(rng.choices(words, k=25)) + "." for i in range(5)}
    docs = dict(clean)
    for i in range(80, 100):  # rejected
        docs[i] = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in rng.choices(words, k=120))
    docs[200] = clean[3]  # an exact copy
    docs[201] = clean[4].replace(clean[4].split()[50], "changed", 1)  # a near copy
    passage = "".join(sentence() for _ in range(7))
    docs[210] = "".join(sentence() for _ in range(12)) + passage
    docs[211] = "".join(sentence() for _ in range(12)) + passage + sentence()
    for i, item in items.items():
        docs[220 + i] = "".join(sentence() for _ in range(6)) + item + " " + sentence()
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in docs.items()] + [(300, None, "en", None, None), (301, "", None, "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 80 <= i < 100), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items.items()], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, passage


def test_stages_and_result(spark, tmp_path):
    docs, passage = write_tables(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        table = P.materialise(stage(spark, table, str(tmp_path)), name)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r for r in table.collect()})
    every = {*docs, 300, 301}
    assert every - set(kept[0]) == set(range(80, 100))
    assert set(kept[0]) - set(kept[1]) == {200, 201}
    assert set(kept[1]) == set(kept[2])
    changed = {i for i in kept[2] if kept[2][i].text != kept[1][i].text}
    assert changed == {211} and passage.strip() not in kept[2][211].text and kept[2][211].n_chars == len(kept[2][211].text)
    assert set(kept[2]) - set(kept[3]) == set(range(220, 225))
    encoder = Tokenizer.from_file(packing.vocabulary_path())
    rows = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept[3])
    for doc_id in list(kept[3])[::9]:
        ids = encoder.encode(kept[3][doc_id].text or "", add_special_tokens=False).ids + [2]
        for r in rows:
            if r.doc_id == doc_id:
                assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs, _ = write_tables(spark, tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, key int, shard string"
    long = " ".join(f"w{i}" for i in range(200_000))
    odd = [(2**53 + 1, docs[0]), (None, docs[0]), (1, None), (1, None), (None, ""), (None, None), (5, long), (5, long), (6, docs[1]), (6, docs[1])]
    rows = [(i, t, None, None, None, "mine", 7, "s") for i, t in odd]
    table, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        kept = out.collect()
        assert {r.score for r in kept} == {"mine"} and {r.key for r in kept} == {7}
        assert {r.doc_id for r in kept} >= {2**53 + 1, 1, 5, 6, None}, name
        assert sum(r.text is None for r in kept) >= 2
        if name == "jaccard_join":
            assert sum(r.doc_id == 5 for r in kept) == sum(r.doc_id == 6 for r in kept) == 1 and sum(r.text == docs[0] for r in kept) == 1
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, table, str(tmp_path)).select("doc_id").distinct().count() == 5
    assert P.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
