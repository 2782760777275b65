import hashlib
import random
import zlib

import pytest

from normata.llm import merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([sha(*row[i : i + 8]) for i in range(0, len(row), 8)])
    return out


def path(rows, at):
    out = []
    for row in rows[:-1]:
        run = at // 8 * 8
        out.append((row[run:at], row[at + 1 : run + 8]))
        at //= 8
    return out


def brute(docs):
    """(doc_id, leaf, subroot, root, proof, folded) of each (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for d in docs:
        trees.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, sha(*map(field, d)), d))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: levels([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in trees}
    above = levels([built[t][-1][0] for t in order])
    out = []
    for t in order:
        for at, (_, _, leaf, d) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            way = path(built[t], at) + path(above, order.index(t))
            node = leaf
            if zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 3 == 0 and d[4] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])
                node = sha(*map(field, (*d[:4], lower)))
            for left, right in way:
                node = sha(*left, node, *right)
            out.append((d[0], leaf, built[t][-1][0], above[-1][0], sha(*(n for a, b in way for n in (*a, *b))), node))
    return out


KIND = "doc_id long, source string, lang string, n_chars long, text string, size long, tree string, at int"


def table(spark, docs, parts=5):
    return spark.createDataFrame([(*d, 7, "x", 3) for d in docs], KIND).repartition(parts)


@pytest.mark.parametrize("depth", range(5))
def test_traversal_gives_every_path_with_little_in_memory(depth):
    for size in {1, 8**depth // 8 + 1 if depth else 1, 8**depth // 3 + 1, 8**depth}:
        leaves = [sha(str(i)) for i in range(size)]
        rows = [leaves]
        for _ in range(depth):
            rows.append([sha(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
        walk = M.Traversal(leaves.__getitem__, size, depth)
        for at, found in enumerate(walk.paths()):
            assert found == path(rows, at)
            held = sum(len(r.nodes) + sum(map(len, r.stack.pending)) for r in (*walk.existing, *walk.desired))
            assert held <= 2 * 8 * depth + 8 * depth * depth


def test_equals_brute_force_over_blocks_and_languages(spark):
    rng = random.Random(3)
    langs = [None, "", "de", "é", "zz", "en"] + ["hot"] * 4
    docs = [(rng.choice([None, *range(400)]), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 5]), rng.choice(["AbÇ", "", None, "x y"])) for _ in range(700)]
    docs += docs[:40]
    got = [tuple(r)[:6] for r in M.manifest(M.with_leaves(table(spark, docs)), 1).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs)))


def test_production_blocks_and_query(spark, tmp_path):
    docs = [(i, f"s{i % 3}", "en" if i % 7 else f"l{i % 5}", i, f"Text {i}" if i % 11 else None) for i in range(9000)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got.collect()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(brute(docs))
    for r in rows:  # only a text with capitals changes
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or r.doc_id % 11 == 0)


def test_one_row_no_row_and_a_long_text(spark):
    docs = [(5, None, None, None, "A" * 3_000_000)]
    got = M.manifest(M.with_leaves(table(spark, docs, 1))).collect()
    assert [tuple(r)[:6] for r in got] == brute(docs)
    assert got[0].proof_sha256 == sha("")
    assert M.manifest(M.with_leaves(table(spark, docs).limit(0))).count() == 0
