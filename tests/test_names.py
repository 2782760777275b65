"""Name joins against every pair compared."""

import random
from difflib import SequenceMatcher

import pytest

from normata.operators import names as N
from normata.operators import relations as L


def column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def made(rng, n):
    words = ["LEY", "DE", "DEL", "AGUAS", "SALUD", "CODIGO", "CIVIL", "PENAL", "ESTADO", "REGLAMENTO", "TRANSITO", "A", "Ñ%_"]
    out = []
    for _ in range(n):
        name = " ".join(rng.choices(words, k=rng.randint(1, 6)))
        letters = list(rng.choice(out) if out and rng.random() < 0.4 else name)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["X", "E", " ", ""])
        out.append("".join(letters))
    return out


def test_held_names(spark, monkeypatch):
    rng = random.Random(2)
    keys, texts = [*made(rng, 150), "", "A", None], [*made(rng, 150), "", None]
    want = {(k, t) for k in keys for t in texts if k is not None and t is not None and k in t}
    for block in (N.BLOCK, 300):
        monkeypatch.setattr(N, "BLOCK", block)
        got = [tuple(r) for r in N.held_names(column(spark, keys, "key"), column(spark, texts, "text")).collect()]
        assert set(got) == want and len(got) == len(want)
    assert N.held_names(column(spark, [], "key"), column(spark, texts, "text")).count() == 0
    assert N.held_names(column(spark, keys, "key"), column(spark, [], "text")).count() == 0


def test_either_holds(spark):
    rng = random.Random(4)
    left, right = made(rng, 80), made(rng, 80)
    got = {tuple(r) for r in N.either_holds(column(spark, left, "left"), column(spark, right, "right")).collect()}
    assert got == {(a, b) for a in left for b in right if a in b or b in a}


def test_words_in_order(spark):
    names = ["ley aguas", "LÉY de", "a%", "de ley", "  ", "unheard", "ñ%_", None]
    texts = ["Ley de Aguas", "LEY DE SALUD", "Código a% penal", "Ñ%_ uno", None, ""]
    got = {tuple(r) for r in N.hold_words(column(spark, names, "name"), column(spark, texts, "text")).collect()}
    assert got == {
        ("ley aguas", "Ley de Aguas"), ("LÉY de", "Ley de Aguas"), ("LÉY de", "LEY DE SALUD"), ("a%", "Código a% penal"), ("ñ%_", "Ñ%_ uno"),
        *(("  ", t) for t in texts if t is not None),
    }


@pytest.mark.parametrize("accept", [0.81, 0.82, 0.95])
def test_alike_loses_no_pair(spark, accept):
    rng = random.Random(7)
    pool = made(rng, 500)
    left, right = [*pool[::2], "", "A", "AB", "ABC", None], [*pool[1::2], "", "A", "BA", "ABCD"]
    want = {(a, b) for a in left for b in right if a is not None and SequenceMatcher(None, a, b).ratio() >= accept}
    got = {(r.a, r.b): r.score for r in N.alike(column(spark, left, "a"), column(spark, right, "b"), accept).collect()}
    assert set(got) == want and len(want) > 50
    with pytest.raises(ValueError):
        N.alike(column(spark, left, "a"), column(spark, right, "b"), 0.8)
    assert all(abs(s - SequenceMatcher(None, a, b).ratio()) < 1e-12 for (a, b), s in got.items())


def test_resolved_names_are_those_of_the_plain_rule(spark):
    rng = random.Random(9)
    laws, asked = made(rng, 60), made(rng, 120)
    documents = spark.createDataFrame([(i, n) for i, n in enumerate(laws)], "id int, nombre string")
    names = column(spark, asked, "name")
    key = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.upper().replace("Ñ", "N")).split())
    want = {}
    for name in set(asked):
        best, found = 0.0, None
        for i, law in enumerate(laws):
            a, b = key(name), key(law)
            score = 1.0 if a == b else 0.95 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
            if score > best:
                best, found = score, i
        if best >= L.ACCEPT:
            want[name] = found
    assert {r.name: r.document_id for r in L.resolve_names(names, documents).collect()} == want


def test_plans_have_no_nested_loops(spark):
    names, laws = column(spark, ["LEY UNO", "LEY DOS"], "name"), spark.createDataFrame([(1, "Ley Uno")], "id int, nombre string")
    for out in (L.resolve_names(names, laws), N.hold_words(names, column(spark, ["Ley Uno"], "text"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
