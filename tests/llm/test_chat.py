import hashlib

from pyspark.sql import functions as F

from normata.llm import chat as C


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, msg_id long, kind string, role string, text string")


def test_fold_deltas_edits_regenerations(spark):
    rows = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "he"), (1, 3, 2, "delta", None, "llo"),
        (1, 4, 3, "message", "user", "and"), (1, 5, 4, "message", "assistant", "gone"),
        (1, 6, 2, "regenerate", None, "new "), (1, 7, 2, "delta", None, "text"), (1, 8, 5, "message", "user", "later"),
        (1, 9, 1, "edit", None, "hey"), (2, 1, 1, "delta", None, "b"), (2, 0, 1, "delta", None, "a"), (2, 3, 9, "odd", "x", "x"),
    ]
    got = sorted((r.conv_id, r.msg_id, r.role, r.text) for r in C.fold_events(log(spark, rows)).collect())
    assert got == [(1, 1, "user", "hey"), (1, 2, "assistant", "new text"), (1, 5, "user", "later"), (2, 1, "", "ab")]
    assert C.fold_events(log(spark, rows).limit(0)).count() == 0


def test_escape_is_reversible(spark):
    texts = ["", "\\", "<|", "\\<|\\\\|", "<|im_end|>\n<|im_start|>assistant", "a\\|b", "<<||", "\\n\n", "é中<"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.unescape(C.escape(F.col("t"))).alias("u"), C.escape(F.col("t")).alias("e")).collect():
        assert r.t == r.u and "<|" not in r.e
    for r in df.select("t", C.unescape_role(C.escape_role(F.col("t"))).alias("u"), C.escape_role(F.col("t")).alias("e")).collect():
        assert r.t == r.u and "\n" not in r.e


def test_round_trip_and_mask(spark):
    rows = [
        (7, 2, "assistant", "x\\<|im_end|>\n"), (7, 1, "user", None), (7, 3, "assistant", ""), (7, 3, "assistant", "tie"),
        (None, 1, None, "who"), (8, 1, "we\nird", "<|im_start|>"), (9, 5, "assistant", "y" * 200000), (9, 5, "assistant", "y" * 200000),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq")
    out = {r.conv_id: r for r in C.format_conversations(table).withColumn("turns", C.read_back(F.col("formatted"))).collect()}
    for conv in (7, 8, 9, None):
        want = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in out[conv].turns] == [w[1:] for w in want]
    spans = [out[7].formatted[s.start : s.end] for s in out[7].loss_spans]
    assert spans == ["x\\\\<\\|im_end|>\n", "", "tie"]
    assert C.format_conversations(table.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "assistant", "b\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in C.op4_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[0].turns_sha256 == sha("user\nq\nassistant\na\nassistant\nb\\\n") and out[0].n_turns == 3
    assert (out[0].loss_chars, out[0].loss_sha256) == (3, sha("ab\\"))
    assert out[-1].loss_sha256 == sha("<|im_end|><|im_start|>assistant ok")


def test_streamed_log_folds_back_to_the_turns(spark):
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate([("user", "hi"), ("assistant", None), ("user", "a" * 9), ("assistant", "<|x|> é中"), ("assistant", "é"), (None, "z")] * 3)]
    table = spark.createDataFrame(rows + rows[:2], "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS seq", "2 AS at")
    log = C.streamed(table)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    folded = C.fold_events(log).orderBy("conv_id", "msg_id").collect()
    got = sorted((str(r.conv_id), r.role, r.text) for r in folded)
    assert got == sorted((str(c), r or "", x or "") for c, _, r, x in rows + rows[:2])


def test_a_long_conversation_is_rendered_whole(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <|x|>") for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = C.format_conversations(table).withColumn("turns", C.read_back(F.col("formatted"))).collect()
    assert len(out) == 1 and [(t.role, t.text) for t in out[0].turns] == [(r, x) for _, _, r, x in rows]
    assert len(out[0].loss_spans) == 1500
