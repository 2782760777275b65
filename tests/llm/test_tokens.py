import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from normata.llm import mixing as M
from normata.llm import tokens as T
from normata.llm.encoding import WordEncoder
from normata.llm.packing import vocabulary_path


@pytest.mark.parametrize("n", [0, 1, 2, 33, 4095, 4096, 4097, 30_000])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    phrases = rng.integers(0, 49_408, 300)
    for ids in (rng.integers(0, 3, n), rng.integers(0, 49_408, n), np.full(n, 7), np.resize(phrases, n), rng.geometric(0.001, n)):
        assert (M.decoded(M.coded(ids.astype("<u4"))) == ids).all()


def test_many_lanes_and_ids_beyond_16_bits(monkeypatch):
    monkeypatch.setattr(M, "LANES", 3)
    ids = np.random.default_rng(1).integers(0, 200_000, 8 * M.BLOCK + 17).astype("<u4")
    assert (M.decoded(M.coded(ids)) == ids).all()


def test_predictions_shorten_what_repeats():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 49_408, rng.integers(1, 4)) for _ in range(400)]
    text = np.concatenate([words[i] for i in rng.zipf(1.3, 20_000) % 400])[: 4 * M.BLOCK]
    shuffled = rng.permutation(text)
    assert len(M.coded(text)) < 0.85 * len(M.coded(shuffled)) < 0.85 * 2 * len(text)
    assert len(M.coded(np.resize(np.arange(50), 4 * M.BLOCK))) < 0.15 * len(text)


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(3).integers(0, 500, 3 * M.BLOCK).astype("<u4")
    data = bytearray(M.coded(ids))
    alone = [M.coded(ids[a : a + M.BLOCK]) for a in range(0, len(ids), M.BLOCK)]
    assert sum(len(x) - 4 for x in alone) == len(data) - 4
    data[-40] ^= 1
    with pytest.raises(ValueError, match="block 2 does not match"):
        M.decoded(bytes(data))
    made = T.segment(np.array([1]), np.array([False]), np.array([3 * M.BLOCK]), ids)
    broken = bytearray(made)
    broken[20] ^= 1
    with pytest.raises(ValueError, match="list of documents"):
        T.parsed(bytes(broken))
    with pytest.raises(ValueError, match="not a segment"):
        T.parsed(b"x" + made)


@pytest.mark.parametrize("n", [1, 4095, 4096])
def test_tables_hold_alphabets_only(n):
    ids = np.random.default_rng(n).integers(0, 9, n)
    model = M.Model(np.array([9, 1]), np.append(np.bincount(ids, minlength=9), n), np.array([n, n]))
    assert len(model.first) == len(model.spread) == 10
    slots = (model.spread & 0xFFFF).reshape(-1)
    assert slots[:9].sum() <= M.BLOCK and slots[9] <= M.BLOCK and (model.spread[[0, 9]] >> 16 == 0).all()


def test_damage_anywhere_is_an_error():
    ids = np.random.default_rng(4).integers(0, 60, M.BLOCK + 700).astype("<u4")
    data = M.coded(ids)
    for at in range(4, len(data), 97):
        broken = bytearray(data)
        broken[at] ^= 0x55
        try:
            assert (M.decoded(bytes(broken)) == ids).all()  # bits after a lane's last word tell nothing
        except ValueError:
            pass


def test_a_part_asks_for_its_words_once(monkeypatch):
    encoder, whole = WordEncoder(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    words = ["one", "Two,", "two;;", "x1.", "...", ".a", "don't!", "straße", "İstanbul", "ǆ", "ﬁn", "n\u0303o", "日本語", "a" * 70 + ".", "b" * 64, "<|endoftext|>", "Ünit?", "é.", "٣", "٣.", "x\x1cy", "ⅷ", "ªb"]
    texts = pa.array([" ".join(words), None, "", " two  one. ", *words])
    asked = []
    slots_of = encoder.slots_of
    monkeypatch.setattr(encoder, "slots_of", lambda own: asked.append(len(own)) or slots_of(own))
    for _ in range(2):
        (ids, bounds), = encoder.arrays(texts)
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert len(asked) == 2
    known = encoder.known.to_pylist()
    assert len(set(known)) == len(known) and {"two", "one"} <= set(known) and not {"two,", "two;;", "one."} & set(known)


def brute(rows):
    encoder, start, out = Tokenizer.from_file(vocabulary_path()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_tokenizer(spark, tmp_path):
    rows = [(i * 7 % 500, f"Document {i}, WORDS {i % 9}! " * (i % 40)) for i in range(500)]
    rows += [(None, "no id"), (1000, None), (1001, ""), (1002, "x " * 30_000), (1003, "<|endoftext|> # \x1c !")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, part int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = T.op12_token_ids(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows)


def test_small_segments_repeated_ids_and_no_rows(spark, tmp_path):
    rows = [(5, f"same id {i}") for i in range(50)] + [(5, "twice")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    T.write_tokens(docs, f"{tmp_path}/a", vocabulary_path(), size=64)
    files = spark.read.parquet(f"{tmp_path}/a")
    assert files.count() > 1
    got = sorted(map(tuple, T.read_tokens(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    assert sorted((d, n, c) for d, _, n, c in got) == sorted((d, n, c) for d, _, n, c in brute(rows))
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    T.write_tokens(docs.limit(0), f"{tmp_path}/b", vocabulary_path())
    assert T.read_tokens(spark, f"{tmp_path}/b").count() == 0
