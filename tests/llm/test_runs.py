import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from normata.llm import runs as R


def brute(words, least=24, ratio=3):
    """Every run, from its definition: for each period, the longest stretches in which words a period apart are equal."""
    found = {}
    for q in range(1, len(words) // ratio + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            size = end - at + q
            if size >= max(least, ratio * q):
                found.setdefault((at, size), q)
            at = max(end, at + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def words_of(rng, kind):
    n = rng.randint(0, 90)
    out = [rng.choice("ab" if kind == 0 else "abcdefgh") for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        piece = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        at = rng.randint(0, len(out))
        out[at:at] = (piece * 30)[: rng.randint(1, 60)]
    if rng.random() < 0.3:
        out += out[: rng.randint(0, len(out))] * rng.randint(1, 3)
    return out


@pytest.mark.parametrize(("least", "ratio"), [(24, 3), (2, 2), (5, 2), (9, 4)])
def test_runs_are_those_of_the_definition(least, ratio):
    rng = random.Random(least)
    texts = [words_of(rng, i % 2) for i in range(250)]
    found, of, sizes = R.runs_in_texts(pa.array([" ".join(t) for t in texts]), least, ratio)
    assert sizes.tolist() == [len(t) for t in texts]
    for i, words in enumerate(texts):
        assert [tuple(r) for r in found[of == i].tolist()] == brute(words, least, ratio), words


def test_blocks_are_the_longest_previous_pieces():
    rng = random.Random(8)
    for _ in range(60):
        keys = np.array([rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 50))])
        order, ranks, _ = R.sort_suffixes(keys)
        assert order.tolist() == sorted(range(len(keys)), key=lambda i: keys[i:].tolist())
        length, source = R.previous_factors(order, ranks)
        for i in range(len(keys)):
            same = [next((k for k in range(len(keys) - i) if keys[i + k] != keys[j + k]), len(keys) - i) for j in range(i)]
            assert length[i] == max(same, default=0)
            assert source[i] == -1 or (source[i] < i and same[source[i]] == length[i])


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], lines, sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    spaces = [" ", "\n", "\t ", "\x0b", "\x0c\r"]
    texts = ["".join(w + rng.choice(spaces) for w in words_of(rng, i % 2)) for i in range(300)]
    texts += [None, "", " \n ", "a", "x " * 4000, "ß b   c", "a\x1cb " * 30, *texts[:20]]
    rows = [(i if i % 40 else None, t, 1, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, words string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(d, t)) for d, t, *_ in rows)
    assert R.find_runs(docs.limit(0)).count() == 0


def test_collapsed_texts_and_long_texts(spark):
    long = " ".join(str(i % 7000) for i in range(30_000))
    docs = spark.createDataFrame([(1, "start " + "a b c " * 20 + "end"), (2, long), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in R.find_runs(docs).collect()}
    assert out[1].collapsed == "start a b c end" and [tuple(r) for r in out[1].runs] == [(1, 60, 3)]
    assert [tuple(r) for r in out[2].runs] == [(0, 30_000, 7000)] and out[2].collapsed == " ".join(map(str, range(7000)))
    assert out[3].runs == [] and out[3].collapsed == "" and out[3].n_words == 0
