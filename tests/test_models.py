"""Calls of models that fail."""

import pytest
from pyspark.sql import functions as F

from normata.operators import models as M


def lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


def picky(texts):
    if any("bad" in t for t in texts):
        raise ConnectionError("no line")
    return lengths(texts)


def test_batches_fallback_and_checks():
    sizes = []

    def counted(texts):
        sizes.append(len(texts))
        return lengths(texts)

    two = [M.Model("first", picky), M.Model("second", counted)]
    caller = M.Caller(two, M.vector_of(2))
    assert caller(["a"]) == [([1.0, 1.0], "first", None)] and not sizes
    assert [r[1] for r in caller(["a", "bad"])] == ["second", "second"] and sizes == [2]
    for wrong, told in (
        (lambda t: lengths(t)[:-1], "0 results for 1 texts"), (lambda t: [[1.0]], "1 dimensions, 2 wanted"), (lambda t: [None], "a result is missing"),
        (lambda t: [[float("nan"), 1.0]], "not finite"), (lambda t: 1 / 0, "ZeroDivisionError"),
    ):
        assert told in M.Caller([M.Model("only", wrong)], M.vector_of(2))(["x"])[0][2]
    assert M.Caller([])(["x"]) == [(None, None, "no model")]


def test_a_model_that_keeps_failing_is_left_out():
    tried = []

    def dead(texts):
        tried.append(1)
        raise TimeoutError

    caller = M.Caller([M.Model("dead", dead), M.Model("alive", lengths)])
    assert [caller(["a"])[0][1] for _ in range(10)] == ["alive"] * 10 and len(tried) == M.PATIENCE
    unsteady = M.Caller([M.Model("m", picky)])
    assert [unsteady([t])[0][1] for t in ("bad", "bad", "ok", "bad", "bad", "ok")] == [None, None, "m", None, None, "m"]


@pytest.fixture
def chunks(spark):
    rows = [(i, i % 2, f"text {i}" if i % 10 else None, [9.0, 9.0], "old" if i % 3 else "second") for i in range(200)] + [(200, 0, "bad", [9.0, 9.0], "old")]
    return spark.createDataFrame(rows, "id int, document_id int, content string, embedding array<float>, embedding_model string").repartition(3)


def test_reembedding(spark, chunks):
    documents = spark.createDataFrame([(0, True), (1, False)], "id int, is_active boolean")

    def local(texts):  # sent to the tasks by value
        if any("bad" in t for t in texts):
            raise ConnectionError("no line")
        return [[float(len(t)), 1.0] for t in texts]

    out = {r.id: r for r in M.reembedded(chunks, documents, [M.Model("second", local)], 2, size=1).collect()}
    assert set(out) == {r.id for r in chunks.collect() if r.document_id == 0 and r.embedding_model == "old"}
    for i, r in out.items():
        if i == 200:
            assert (r.embedding, r.embedding_model) == ([9.0, 9.0], "old") and "ConnectionError" in r.embedding_error
        elif r.content is None:
            assert (r.embedding, r.embedding_model, r.embedding_error) == ([9.0, 9.0], "old", None)
        else:
            assert (r.embedding, r.embedding_model) == ([float(len(r.content)), 1.0], "second")


def test_answers_and_empty_tables(spark, chunks):
    said = [M.Model("blank", lambda t: [" "] * len(t)), M.Model("echo", lambda t: [x.upper() for x in t])]
    rows = chunks.select("id", "content").withColumn("model", F.lit("own"))
    out = M.with_answers(rows, "content", said)
    assert {(r.answer, r.llm_model) for r in out.collect() if r.id == 1} == {("TEXT 1", "echo")}
    assert out.where("content IS NULL AND (answer IS NOT NULL OR llm_error IS NOT NULL)").count() == 0
    assert M.with_answers(rows.limit(0), "content", said).count() == 0
