"""Spans joined by position bins against all pairs, and quantiles cut in rounds."""

import random

import numpy as np
import pytest

from claimloom.operators import intervals as iv
from claimloom.operators.quantiles import exact_quantiles

SPANS = "message_id string, claim_id int, start int, end int"


def spans(rng, n, places):
    made = []
    for i in range(n):
        start = rng.randrange(places)
        made.append((rng.choice(["a", "a", "a", "b", None]), i, start, start + rng.choice([0, 1, 2, 7, 30, 64, 400, -3])))
    return made


def meet(x, y):
    return x[0] == y[0] and x[2] < y[3] and y[2] < x[3]


@pytest.mark.parametrize("places", [40, 3000])
def test_pairs_equal_all_pairs(spark, places):
    rows = spans(random.Random(places), 250, places)
    got = [tuple(r) for r in iv.span_pairs(spark.createDataFrame(rows, SPANS)).collect()]
    expected = [(x[0], x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and meet(x, y)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_two_sides_equal_all_pairs(spark):
    rng = random.Random(1)
    left, right = spans(rng, 120, 200), spans(rng, 140, 200)
    got = iv.overlaps(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS)).collect()
    expected = [(x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in left for y in right if meet(x, y)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    empty = spark.createDataFrame([], SPANS)
    assert iv.span_pairs(empty).collect() == [] and iv.overlaps(empty, empty).collect() == []


def test_a_crowded_message_is_many_keys(spark):
    rows = spark.range(200_000).selectExpr("'m' AS message_id", "id AS claim_id", "id * 10 AS start", "id * 10 + 12 AS end")
    assert iv.span_pairs(rows).count() == 199_999


@pytest.mark.parametrize("cell_rows", [50, 2000])
def test_one_key_with_many_values_is_cut_in_rounds(spark, cell_rows):
    rng = np.random.default_rng(7)
    rows = [("a", float(x)) for x in rng.lognormal(sigma=4, size=30_000)] + [("a", 3.0)] * 5000 + [("b", float(x)) for x in range(40)]
    df = spark.createDataFrame([*rows, ("c", None)], "k string, v double")
    probs = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, cell_rows).collect()}
    assert set(got) == {"a", "b"}
    for k in "ab":
        x = [v for kk, v in rows if kk == k]
        assert np.allclose([got[k][p] for p in probs], np.percentile(x, [1, 50, 99, 100]))
    alone = exact_quantiles(df, [], "v", {"p50": 0.5}, cell_rows).collect()
    assert len(alone) == 1 and np.isclose(alone[0].p50, np.percentile([v for _, v in rows], 50))
