import random

from normata.llm import spans as S


def runs(norm):
    """Shortest runs from each sentence with words, and back from each, by trying all."""
    at = [i for i, x in enumerate(norm) if x]
    found = set()
    ok = lambda a, b: b - a >= S.LEAST and sum(len(norm[i].split()) for i in at[a:b]) >= S.WORDS
    for a in range(len(at)):
        found.update([(a, b) for b in range(a + 1, len(at) + 1) if ok(a, b)][:1])
    for b in range(1, len(at) + 1):
        found.update([(a, b) for a in range(b - 1, -1, -1) if ok(a, b)][:1])
    return [(at[a], at[b - 1] + 1, tuple(norm[i] for i in at[a:b])) for a, b in sorted(found)]


def brute(docs):
    """Sentences left, by a plain scan in the order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        pieces = S.sentences(text)
        gone = set()
        for a, b, key in runs([" ".join(p.lower().split()) for p in pieces]):
            if key in seen:
                gone.update(range(a, b))
            seen.add(key)
        kept = "".join(p for i, p in enumerate(pieces) if i not in gone)
        out[doc_id] = (kept.strip(S.SPACE) if gone else text, len(pieces), len(gone))
    return out


def test_pieces_are_the_text():
    long = " ".join(f"w{i}" + ("," if i % 31 == 0 else "") for i in range(200))
    for text in ("a. b! c?\nd", "\n\n x", "...", "no end", "é.\r\n 中文。x.", "", long, f"{long}. {long}\n , ; {long}!", "," * 300 + "a " * 30):
        pieces = S.sentences(text)
        assert "".join(pieces) == text and all(len(p.split()) <= S.LONG for p in pieces)


def test_equals_a_plain_scan(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 9))) + rng.choice([". ", "!\n"]) for _ in range(30)]
    pool += [", ".join(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(3, 50))) for _ in range(3)) + ". " for _ in range(5)]
    docs = [(i, "".join(rng.choices(pool, k=rng.randrange(0, 25)))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300, "y " * 3000 + "."), (301, "y " * 3000 + ".")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h1", "'q' AS n_removed")
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in S.drop_repeated_spans(table.repartition(5)).collect()}
    assert got == brute(docs)
    assert got[301][0] == "" and got[301][1] == got[301][2]


def test_edges(spark):
    passage = "the first clause of all holds here for good. the second clause holds too, as it does in the other. and the third one closes it all."
    docs = [(1, None), (2, ""), (None, passage), (5, passage), (5, "intro. " + passage), (None, passage + " more.")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = S.drop_repeated_spans(table)
    rows = {(r.doc_id, r.n_sentences): r for r in out.collect()}
    assert rows[1, 0].text is None and rows[2, 0].text == ""
    assert rows[5, 3].n_removed == 0 and rows[5, 4].n_removed == 0
    assert rows[None, 3].text == "" and rows[None, 4].text == "more."
    assert S.drop_repeated_spans(table.limit(0)).count() == 0


def test_passages_of_short_and_of_long_sentences(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = "".join(" ".join(word() for _ in range(1 + i % 2)) + ("!! " if i % 3 else "\n") for i in range(40))
    assert len(passage.split()) == 60
    blanks = "".join(f"{word()} {word()}.\n \n" for _ in range(20))
    clauses = "".join(" ".join(word() for _ in range(9)) + ", " for _ in range(6))
    docs = [(1, passage), (2, "My own. " + passage + "Other end."), (5, blanks), (6, blanks), (7, "yes. no. " * 3)]
    docs += [(8, "Before it, " + clauses + "after."), (9, "We begin with other words, " + clauses + "and end so.")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in S.drop_repeated_spans(table).collect()}
    assert [rows[i].n_removed for i in (1, 5, 7, 8)] == [0, 0, 0, 0]
    assert rows[2].text == "My own. Other end." and rows[2].n_removed == 40
    assert rows[6].text.strip() == ""
    assert rows[9].text == "We begin with other words, and end so."


def test_runs_of_short_sentences_are_bounded():
    pieces = S.sentences("a. " * 50 + " \n" * 3000 + "b c. d. " * 50)
    begin, end, hashes = S.run_hashes(pieces)
    assert len(begin) == len(end) == len(hashes) <= 300


def test_clean_documents_stay_whole(spark):
    """Documents that share common lines, but no passage, keep every sentence."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    line = "All rights reserved by the owner of this page. "
    docs = [(i, line + "".join(" ".join(word() for _ in range(rng.randrange(4, 30))) + ". " for _ in range(12)) + line) for i in range(200)]
    rows = S.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.n_removed == 0 for r in rows) >= 0.98 * len(rows)


def test_pipeline_cuts_short_sentences(spark):
    import corpus_pipeline

    text = "".join(f"w{i}!! " for i in range(60))
    docs = spark.createDataFrame([(1, text, len(text)), (2, text + "More.", len(text) + 5)], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.spans_stage(spark, docs, "").collect()}
    assert kept == {1: text, 2: "More."}
