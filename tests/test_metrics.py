"""Exact quantiles by range counts."""

import random

import numpy as np
import pytest

from normata.operators import metrics as M


@pytest.mark.parametrize("kind", ["double", "ties", "far", "one"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(kind)
    n = 1 if kind == "one" else 500
    values = {
        "double": [rng.gauss(0, 1) for _ in range(n)],
        "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(n)],
        "far": [rng.random() * 10.0 ** rng.randrange(-12, 13) for _ in range(n)],
        "one": [7.25],
    }[kind]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").coalesce(2)
    for p in (0.0, 0.95):
        assert M.quantile(rows, "x", p) == pytest.approx(float(np.quantile(values, p)), rel=1e-12)
    order = sorted(values)
    for rank in {n // 3, n - 1}:
        assert M.value_at(rows, "x", rank, order[0], order[-1], 5) == (order[rank], sum(v <= order[rank] for v in values))


def test_no_values(spark):
    assert M.quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.95) is None
    empty = spark.createDataFrame([], "role string, x int")
    assert tuple(M.latency(empty, "x").first()) == (None, None)
