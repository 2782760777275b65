import random

import numpy as np
import pytest

from normata.llm import jaccard as J
from normata.llm.components import connected_components


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if len(w) >= k else frozenset([tuple(w)])


def brute(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc_id)
    return [(d, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)]


def corpus(seed, families=6, copies=7, words=60):
    rng = random.Random(seed)
    docs = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (None, "lone row of no id at all"), (1005, "x " * 5000)]
    docs += [(1006, "a b c d e"), (1006, "a b c d e")]
    for f in range(families):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([words, words * 3]))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(10**6)}"
            docs.append((f * 100 + c, " ".join(text)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("cell", [J.CELL, 4])
def test_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(J, "CELL", cell)  # 4: groups laid out as grids of blocks
    docs = corpus(cell)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS root", "2 AS set", "3 AS n")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(table.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_large_ids_survive_null_ids(spark):
    big = 2**53 + 1
    docs = [(big, "a b c d e f g"), (None, "other words that stand alone here"), (big + 2, "a b c d e f g"), (None, None)]
    got = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [
        (str(big), str(big)), (str(big + 2), str(big)), ("None", "None"), ("None", "None")
    ]


def test_families_that_the_hub_does_not_join(spark, monkeypatch):
    # A chain: neighbours link, the ends do not, and the hub reaches only some.
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(40)]
    docs += [(100 + i, " ".join(words[:95] + [f"x{i}"] * (i % 9))) for i in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs), key=str)
    for cell, hot in ((J.CELL, J.HOT), (3, 0.9), (J.CELL, 0.0)):  # hot 0: tokens of three rows are dealt out
        monkeypatch.setattr(J, "CELL", cell)
        monkeypatch.setattr(J, "HOT", hot)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(table).collect()]
        assert sorted(got, key=str) == want


def test_dropping_keeps_one_of_each(spark):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (4, "other words in this one"), (4, "other words in this one")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' AS key", "0 AS first")
    out = J.drop_near_duplicates(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, "a b c d e f"), (4, "other words in this one")]
    assert out.where("text IS NULL").count() == 2
    assert J.near_duplicates(table.limit(0)).count() == 0


def test_tree_loses_no_link():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        for _ in range(10):
            keep = base[rng.random(len(base)) < rng.choice([0.8, 0.9, 1.0])]
            more = rng.integers(0, 2**63, rng.integers(0, 1 + len(base) // 8)).astype(np.uint64)
            sets.append(np.unique(np.append(keep, more)) if len(keep) + len(more) else base)
    labels = J.link_groups(sets, np.arange(len(sets)), np.arange(len(sets)), 80)
    want = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((want[i], want[j]))
                want[want == b] = a
    assert (labels == want).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(300, x) for x in range(301, 340)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(21)} == {0} and {found[i] for i in (100, 150, 200)} == {100}
    assert {found[i] for i in range(300, 340)} == {300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    stars = connected_components(spark.createDataFrame([(5, 5), (5, 3), (3, 3), (9, 9)], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in stars) == [(3, 3), (5, 3), (9, 9)]
