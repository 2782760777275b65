import zlib

from normata.llm import quality as Q


def table(spark, n=120):
    good = "the hearing was held on monday and the court agreed with the reading of section {}"
    junk = "buy*** now### cheap$$$ click%%% win&&& item{}"
    rows = [(i, good.format(i) if i % 2 else junk.format(i)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1L AS label")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_sample_bound(spark):
    docs, labels = table(spark)
    model = Q.fit(spark, docs, labels, max_train=60)
    rows = Q.with_scores(docs.select("doc_id", "text"), model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 10 and all((r.score >= Q.CUT) == bool(r.doc_id % 2) for r in held)


def test_labels_outside_the_sample_do_not_matter(spark):
    docs, labels = table(spark)
    flipped = labels.selectExpr(
        "doc_id", "IF(pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) = 2, 1 - quality, quality) AS quality"
    )
    a, b = Q.fit(spark, docs, labels), Q.fit(spark, docs, flipped)
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_sample_keeps_to_its_entries(spark):
    docs, labels = table(spark, 40)
    whole, part = Q.fit(spark, docs, labels), Q.fit(spark, docs, labels, max_features=200)
    assert (whole.weight != part.weight).any()
    assert (Q.fit(spark, docs, labels, max_features=0).weight == 0).all()


def test_edges(spark):
    docs, labels = table(spark, 40)
    strange = spark.createDataFrame([(1, 7), (3, -1), (None, 1), (5, None)], "doc_id long, quality int")
    model = Q.fit(spark, docs, labels.select("doc_id", "quality").unionByName(strange))
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "a" * 100000), (2, "a" * 100000)], "doc_id long, text string")
    rows = Q.with_scores(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and rows[2].score == rows[3].score
    assert Q.with_scores(odd.limit(0), model).count() == 0
    clash = odd.selectExpr("*", "'mine' AS score")
    assert Q.with_scores(clash, model, "q").columns == ["doc_id", "text", "score", "q"]
    assert dict(Q.with_scores(clash, model).dtypes)["score"] == "double"
    none = Q.fit(spark, docs, labels.limit(0))
    assert {r.score for r in Q.with_scores(odd, none).collect()} == {0.5}


def test_worker_scores_equal_the_trained_mean():
    model = Q.train([Q.bag(t, {}) for t in ["aa bb", "cc dd"] * 5], [1, 0] * 5)
    text = "aa bb bb cc"
    index, share = Q.bag(text, {})
    assert abs(float((share * model.weight[index]).sum()) - Q.WordScores(model.weight).mean(text)) < 1e-6


def test_hot_labelled_id_is_one_row(spark):
    from normata.llm.common import sample_texts

    docs, labels = table(spark, 40)
    hot = spark.range(500).selectExpr("3L AS doc_id", "concat('hot text ', id % 7) AS text", "'x' AS score", "1L AS label")
    picked = labels.selectExpr("doc_id", "quality AS label")
    rows = sample_texts(docs.unionByName(hot), picked).collect()
    assert sorted(r.doc_id for r in rows) == list(range(40))
    assert all(r.label == r.doc_id % 2 for r in rows)
