import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from normata.llm import packing as P


def ids_of(rows):
    return {(r.doc_id, r.start): r for r in rows}


def test_ids_equal_the_tokenizer():
    path = P.vocabulary_path()
    whole, cached = Tokenizer.from_file(path), P.WordEncoder(path)
    texts = ["Hello  World's <|endoftext|>x", "", "a b\x1cc d", "ÉTÉ é ΣΑΣ ΟΔΟΣ", "x" * 5000, "İ ß 1234 *** don't"]
    texts += ["The. THE, the!! 5% é. e\u0301. €. x's. <|ENDOFTEXT|> <|endoftext|>.", "a\u0301b \u0301c d\u200d.", "…. ½? 漢字。 ,. .", "uno İstanbul dos ÉTÉ ǅ ﬁn"]
    for text in texts:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cached.text(text), "<u4").tolist() == want, text
    assert cached.text(None) == b""
    together = list(P.WordEncoder(path).texts(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in together] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_id_lies_in_exactly_one_piece():
    rng = random.Random(5)
    for size, most in ((16, 3), (64, 100)):
        docs = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(rng.choices(range(1, 3 * size), k=300))]
        windows = list(P.pack(iter(docs), size, most))
        seen = {}
        for window in windows:
            total = sum(len(p[2]) for p in window) // 4
            assert total <= size
            assert total == size or total & (total - 1) == 0  # no padding at all
            for (doc, _), start, ids in window:
                seen.setdefault(doc, []).append((start, ids))
        for doc, ids in docs:
            assert b"".join(x for _, x in sorted(seen[doc])) == ids


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(1)
    packer = P.SumOfSquares(32)
    for _ in range(300):
        n = rng.randint(1, 31)
        count = packer.count.copy()

        def squares(level):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + n < 32:
                c[level + n] += 1
            return int((c**2).sum())

        levels = [0, *(h for h in range(1, 32 - n + 1) if h < 32 and count[h])]
        assert squares(packer.level_for(n)) == min(map(squares, levels))
        list(packer.add((0, 0, b"\0" * 4 * n)))


def test_spark_rows(spark):
    docs = spark.createDataFrame(
        [(1, "one two"), (2, None), (3, ""), (3, ""), (None, "x " * 9000)], "doc_id long, text string"
    ).selectExpr("*", "1 AS length", "2 AS start")
    rows = P.pack_documents(docs.coalesce(1), P.vocabulary_path()).collect()
    assert sum(r.length for r in rows) == 3 + 1 + 1 + 1 + 9001
    empty = next(r for r in rows if r.doc_id == 2)
    assert empty.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) and empty.doc_tokens == 1
    assert P.pack_documents(docs.limit(0), P.vocabulary_path()).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= 4096


def test_a_full_array_leaves_the_other_windows_alone():
    packer = P.SumOfSquares(100, 10)
    for i in range(10):
        list(packer.add((i, 0, b"\0" * 4 * (60 + i))))
    out = list(packer.add((10, 0, b"\0" * 4 * 59)))
    assert len(out) == 1 and [p[0] for p in out[0]] == [9, 10] and packer.open == 10
    assert sorted(np.flatnonzero(packer.count)) == [28, *range(60, 69)]
