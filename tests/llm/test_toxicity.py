import zlib

from normata.llm import toxicity as T


def test_fold_undoes_disguises():
    assert T.fold("ІDІОТ 1d10t ｉｄｉｏｔ id​iot ìdïôt") == "idiot idiot idiot idiot idiot"
    assert T.fold("in 2024, 100 of 7") == "in 2024, 100 of 7"
    assert T.fold(None) == ""


def test_every_letter_of_a_word_may_be_disguised():
    words = ["idiot", "loser", "scab", "hate", "kill"]
    lexicon = T.Lexicon({w: 1.0 for w in words}, exceptions=())
    signs = {"o": "0", "i": "1", "l": "1", "e": "3", "a": "4", "s": "5", "t": "7", "b": "8"}
    for word in words:
        for i, c in enumerate(word):
            if c in signs:
                said = f"you {word[:i]}{signs[c]}{word[i + 1:]}, indeed"
                assert lexicon.inputs(said)[0] == 1.0, said
    assert lexicon.inputs("ki11 and 1oser")[0] == 1.0 and lexicon.hits(*T.readings("ki11 and 1oser")) == (2.0, 2)
    assert T.fold("wow!!! $$$ a$$") == "wow!!! $$$ a$$"
    assert lexicon.inputs("in 1989, 100 of 7, a 4th and 2nd")[0] == 0.0


def test_phrases_of_clean_documents_are_excused(spark):
    rows = [(i, f"good day {i} reader a word") for i in range(60)]
    rows += [(100 + i, f"you clod number {i} go away") for i in range(40)] + [(200 + i, f"a clod crusher {i} for the field") for i in range(3)]
    sample = spark.createDataFrame([(i, int(100 <= i < 200), t) for i, t in rows], "doc_id long, label int, text string")
    weights = T.learn_terms(sample)
    assert "clod" in weights
    phrases = T.learn_exceptions(sample, weights)
    assert "clod crusher" in phrases and "you clod" not in phrases
    lexicon = T.Lexicon(weights, tuple(phrases))
    assert lexicon.inputs("a clod crusher stands there")[0] == 0.0 and lexicon.inputs("such a clod")[0] == 1.0


def test_matches_whole_words_and_beginnings():
    lexicon = T.Lexicon({"scum": 3.0, "idio*": 2.0, "idiot": 2.5}, exceptions=("scum line",))
    assert lexicon.hits(T.fold("Scum!")) == (3.0, 1)
    assert lexicon.hits("scummy mid idiotic") == (2.0, 1)
    assert lexicon.hits("idiot") == (2.5, 1)
    assert lexicon.hits("the scum line") == (0.0, 0)
    assert T.Lexicon({}, exceptions=()).hits("scum") == (0.0, 0)


def brute_hits(weights, text):
    total = n = 0
    for w in T.re.findall(r"[^\W_]+", text):
        word = T.re.match(r"[^\W\d_]*", w)[0]
        found = [v for t, v in weights.items() if (t.endswith("*") and w.startswith(t[:-1])) or t == word]
        if found:
            total, n = total + max(found), n + 1
    return total, n


def test_automaton_equals_brute_force():
    weights = {"ab": 1.5, "abc*": 2.0, "b": 1.0, "bca": 4.0, "c*": 0.5}
    lexicon = T.Lexicon(weights, exceptions=())
    import random

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abc ,") for _ in range(40))
        assert lexicon.hits(text) == brute_hits(weights, text)


def test_learns_from_training_rows_only(spark):
    words = ["wharf", "ledger", "statute", "hearing", "court"]
    rows = [(i, f"{words[i % 5]} {words[i % 3]} {'numbskull here' if i % 4 == 0 else 'reader here'} number") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0D AS score")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    strange = spark.createDataFrame([(1, 7), (2, -1), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = T.fit(spark, docs, labels.unionByName(strange))
    out = T.with_scores(docs.select("doc_id", "text"), lexicon).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and all((r.score >= T.CUT) == (r.doc_id % 4 == 0) for r in held)
    assert lexicon.score("you NUMB5KULL") >= T.CUT
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "numbskull " * 50000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in T.with_scores(odd, lexicon).collect())
    assert T.with_scores(odd.limit(0), lexicon).count() == 0
    assert T.fit(spark, docs, labels.limit(0)).score("numbskull") == 0.5
