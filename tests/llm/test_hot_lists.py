"""Long index lists of the Jaccard join are dealt into blocks and lose no pair."""

import random

import numpy as np
import pytest

from claimloom.llm import jaccard

from . import brute
from .test_operators import frame, jaccard_rows, keyed

ROWS = "token long, sig long, n int, at int, group long, low long, high long"


def hot_list(size):
    rng = random.Random(4)
    made = []
    for sig in range(size):
        n = rng.choice([8, 20, 21, 60, 61, 62, 300])
        made.append((7, sig, n, rng.randrange(int(jaccard.prefix(n))), rng.choice([0, 1, 10 + sig]), 0, 10**6))
    return made


@pytest.mark.parametrize("scouting", [False, True])
def test_blocks_are_bounded_and_lose_no_pair(spark, monkeypatch, scouting):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 64)
    monkeypatch.setattr(jaccard, "SCOUTS", 500)
    rows = hot_list(600)
    dealt = jaccard._block_pairs(spark.createDataFrame(rows, ROWS).repartition(4), scouting)
    held = dealt.groupBy("token", "i", "j").count()
    assert held.agg({"count": "max"}).first()[0] <= 2 * jaccard.LIST_ROWS
    step = jaccard._scouting if scouting else jaccard._cross
    order = dealt.repartition(3, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "sig")
    got = {tuple(r) for r in order.mapInArrow(step, jaccard.PAIR).collect()}
    whole = [np.array(c) for c in zip(*sorted(rows, key=lambda r: (r[2], r[1])), strict=True)]
    _, sig, n, at, group, low, high = whole
    sent = jaccard.scouts(group, sig) if scouting else None
    expected = set()
    for i, j in jaccard.cross_pairs(group, n, at, low, high, sig, sent):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = (a, b) if sig[a] < sig[b] else (b, a)
            expected.add((int(sig[a]), int(sig[b]), int(n[a]), int(n[b])))
    assert expected and got == expected


def test_join_with_long_lists_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 4)
    monkeypatch.setattr(jaccard, "SPREAD", 8)
    rows = jaccard_rows(1)
    got = jaccard.join(frame(spark, rows)).collect()
    expected = [(d, len(brute.shingles(t)), c) for (d, t), c in zip(rows, brute.jaccard_components(rows), strict=True)]
    assert keyed((r.doc_id, r.n_shingles, r.component_id) for r in got) == keyed(expected)


def test_short_sketches_lose_no_linked_pair():
    rng = np.random.default_rng(8)
    for size in (3, 40, 400, 3000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            y = np.unique(np.concatenate((x[: len(x) - rng.integers(0, size // 3 + 1)], rng.integers(0, 1 << 63, rng.integers(0, size // 4 + 1), dtype=np.uint64))))
            a, b = (np.frombuffer(jaccard.short_sketch(v), dtype=np.uint64) for v in (x, y))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_one_row_of_each_component_stays(spark):
    text = "one two three four five six seven"
    other = "quite another text of nine words is this one"
    rows = [(1, text), (1, text), (2, text), (2, other), (None, text), (None, text), (None, "a lone text without id here"), (None, "a lone text without id here"), (3, ""), (3, "")]
    kept = [(r.doc_id, r.text) for r in jaccard.representatives(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, text), (2, other), (None, "a lone text without id here"), (3, ""), (3, "")], key=str)
