import random

import numpy as np

from normata.llm import decontam as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_equals_dynamic_programme():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert D.common_subsequence(D.Matcher.positions(np.array(a)), len(a), b) == lcs(a, b)


def test_sketch_gives_the_leading_singular_vectors():
    rng = np.random.default_rng(1)
    counts = rng.poisson(9 * rng.random((400, 6)) ** 4 @ rng.random((6, 50)) ** 4).astype(float)
    sketch = D.Sketch(50, 30)
    for at in range(0, 400, 100):
        cell, term = np.nonzero(counts[at : at + 100])
        times = counts[at : at + 100][cell, term].astype(int)
        sketch.add(np.repeat(term, times), np.repeat(cell, times), 100)
    assert (sketch.df == (counts > 0).sum(axis=0)).all() and sketch.n == 400
    assert np.allclose(sketch.y, counts.T @ counts @ D.test_matrix(50, 30), rtol=1e-3, atol=1e-2)
    items = D.Items([], [], {}, 50)
    latent = D.latent_terms(sketch, items, 4)
    idf = np.log(401 / (1 + sketch.df)) + 0.1
    want = np.linalg.svd(counts * idf)[2][:4]
    got = latent / idf[:, None]
    assert np.linalg.svd(want @ got)[1].min() > 0.97


def tables(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(3000)] + ["the", "of"] * 300
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rng.randrange(15, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "Zebra of quartz!"), (3, items3 := " ".join(draw(40)))]
    docs, truth = [], set()
    for i in range(120):
        text = draw(rng.choice([5, 60, 400]))
        if i % 3 == 0:
            item, passage = items[i // 3 % 30]
            part = passage.upper().split()
            if i % 2:  # a paraphrase: some words go, some come
                part = [w for j, w in enumerate(part) if j % 8 != 1]
                part.insert(4, "however")
            cut = rng.randrange(len(text))
            text[cut:cut] = part
            truth.add((i, item))
        docs.append((i, ", ".join(text)))
    docs += [(500, None), (501, ""), (None, items3), (502, items3 + " x" * 30000), (502, items3)]
    docs += [(503, "zebra of the quartz"), (504, "a zebra, of quartz")]
    truth |= {(None, 3), (502, 3), (504, 92)}
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS lcs")
    return docs, spark.createDataFrame(items, "item_id long, text string"), truth


def test_finds_copies_and_paraphrases_only(spark, monkeypatch):
    docs, items, truth = tables(spark)
    found = D.find_matches(docs.repartition(3), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth
    assert sum(r.doc_id == 502 for r in found) == 2
    assert all(0.5 < r.cosine <= 1.000001 for r in found)
    monkeypatch.setattr(D, "ITEMS", 12)
    monkeypatch.setattr(D, "TOGETHER", 2)
    monkeypatch.setattr(D, "WINDOWS", 5)
    assert {(r.doc_id, r.item_id) for r in D.find_matches(docs, items).collect()} == truth


def test_empty_tables(spark):
    docs, items, _ = tables(spark)
    assert D.find_matches(docs.limit(0), items).count() == 0
    assert D.find_matches(docs, items.limit(0)).count() == 0


def test_items_that_the_space_does_not_hold_are_found():
    rng = random.Random(12)
    texts = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 60))] for _ in range(1000)]
    items = D.Items.of([(i, " ".join(t)) for i, t in enumerate(texts)])
    docs = [" ".join(["my", "own"] * 25 + t + ["words"] * 50) for t in texts]
    matcher = D.Matcher(items, np.zeros((items.terms, 4), np.float32))
    assert {(i, item) for i, doc in enumerate(docs) for item, *_ in matcher.match(D.words_of(doc))} == {(i, i) for i in range(1000)}


def test_candidates_miss_hardly_a_paraphrase():
    """Against the longest common subsequence of every document with every item, edits of all strengths."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 400
    texts = [rng.choices(vocabulary, k=rng.randrange(20, 60)) for _ in range(60)]
    items = D.Items.of([(i, " ".join(t)) for i, t in enumerate(texts)])
    matcher = D.Matcher(items, np.zeros((items.terms, 4), np.float32))
    real = met = 0
    for i, t in enumerate(texts * 4):
        rate = rng.uniform(0, 0.4)
        edited = [rng.choice(vocabulary) if rng.random() < rate / 2 else w for w in t if rng.random() > rate / 2]
        doc = rng.choices(vocabulary, k=rng.randrange(200)) + edited + rng.choices(vocabulary, k=rng.randrange(200))
        numbers = items.numbers([w.encode() for w in doc])
        near = {matcher.owner[q] for _, q, _ in matcher.candidates(numbers)}
        if lcs(edited, texts[i % 60]) >= D.COPIED * len(texts[i % 60]):
            real += 1
            met += i % 60 in near
    assert real > 150 and met >= 0.98 * real


def test_large_ids_survive_null_ids_and_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(2**53 + 1, "x " + item), (None, "nothing here"), (2**53 + 3, "pad " * 200_000 + item + " pad" * 200_000)]
    found = D.find_matches(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(2**53 + 5, item)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(2**53 + 1, 2**53 + 5), (2**53 + 3, 2**53 + 5)}


def test_repeated_benchmark_rows_are_one_item(spark):
    text = " ".join(f"w{i}" for i in range(30))
    benchmark = spark.createDataFrame([(1, text)] * 4 + [(2, text)], "item_id long, text string")
    found = D.find_matches(spark.createDataFrame([(7, "x y " + text)], "doc_id long, text string"), benchmark).collect()
    assert sorted(r.item_id for r in found) == [1, 2]


def test_the_latent_space_finds_what_shared_terms_do_not():
    """Paraphrases that keep nine of 24 telling words, the answer's among them: with the space set to zero they are lost."""
    common = ["the", "of", "and", "to"]
    texts = [[w for j in range(24) for w in (common[j % 4], f"w{i}x{j}")] for i in range(60)]
    items = D.Items.of([(i, " ".join(t)) for i, t in enumerate(texts)])
    sketch = D.Sketch(items.terms, D.RANK + D.OVERSAMPLE)
    found = {}
    for name, latent in (("space", D.latent_terms(sketch, items, D.RANK)), ("zero", np.zeros((items.terms, 4), np.float32))):
        matcher = D.Matcher(items, latent)
        hits = set()
        for i, t in enumerate(texts):
            kept = [w if w in common or j >= 36 or j % 12 == 1 else f"other{i}x{j}" for j, w in enumerate(t)]
            doc = ["the"] * 80 + kept + ["of"] * 80
            hits |= {(i, item) for item, *_ in matcher.match(D.words_of(" ".join(doc)))}
        assert all(i == item for i, item in hits)
        found[name] = len(hits)
    assert found == {"space": 60, "zero": 0}


def test_recall_over_a_thousand_items_through_spark(spark):
    """Against the longest common subsequence of each document with each item: copies with words left out and exchanged."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of", "and"] * 500
    texts = [rng.choices(vocabulary, k=rng.randrange(20, 60)) for _ in range(1000)]
    docs, truth = [], set()
    for i in rng.sample(range(1000), 300):
        t, rate = texts[i], rng.uniform(0, 0.5)
        kept = [rng.choice(vocabulary) if rng.random() < rate / 2 else w for w in t if rng.random() > rate / 2]
        docs.append((i, " ".join([*rng.choices(vocabulary, k=rng.randrange(150)), *kept, *rng.choices(vocabulary, k=rng.randrange(150))])))
        tail = t[-max(3, len(t) // 4) :]
        if lcs(kept, t) >= D.COPIED * len(t) and lcs(kept, tail) >= D.ANSWERED * len(tail):
            truth.add((i, i))
    docs += [(5000 + i, " ".join(rng.choices(vocabulary, k=200))) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in D.find_matches(table, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")).collect()}
    assert len(truth) > 180 and len(got & truth) >= 0.97 * len(truth)
    assert not any(d >= 5000 for d, _ in got)
