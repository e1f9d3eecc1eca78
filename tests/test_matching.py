"""Folds against plain-Python restatements on random inputs, and edge cases."""

import random

import pytest
from conftest import PRED, SPAN
from pyspark.sql import functions as F

from claimloom.functions import matching as mt
from claimloom.operators import evaluate as ev
from claimloom.operators.spans import resolve_rows

TYPES = ["A", "B", "C"]


def random_rows(n, seed, most=9):
    rng = random.Random(seed)

    def spans(conf):
        out = []
        for _ in range(rng.randint(0, most)):
            start = rng.randint(0, 30)
            end = start + rng.randint(1, 9)
            item = (start, end, rng.choice(TYPES), "x" * rng.randint(1, 9))
            out.append(item + (rng.randint(0, 10) / 10,) if conf else item)
        return out

    return [(str(i), "some text " * 5, None, spans(False), spans(True)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(
        rows, f"message_id string, text string, label string, gt {SPAN}, pred {PRED}"
    )


def overlap(a, b):
    return min(a[1], b[1]) - max(a[0], b[0])


def greedy(gt, pred, score, consume=lambda p, g, s: True):
    """Reference result: list of (pred, gt, score) and missed golds."""
    used, out = set(), []
    for i, p in enumerate(pred):
        best = None
        for j, g in enumerate(gt):
            if j in used:
                continue
            s = score(p, g)
            if s is not None and (best is None or s > best[1]):
                best = (j, s)
        out.append((i, best[0] if best else None))
        if best and consume(p, gt[best[0]], best[1]):
            used.add(best[0])
    return sorted(out), sorted(j for j in range(len(gt)) if j not in used)


def iou(p, g):
    i = max(0, overlap(p, g))
    u = (p[1] - p[0]) + (g[1] - g[0]) - i
    return i / u


CASES = {
    "typed": (mt.first_same_type, lambda p, g: 1 if overlap(p, g) > 0 and p[2] == g[2] else None),
    "any": (mt.first_any_type, lambda p, g: 1 if overlap(p, g) > 0 else None),
    "iou": (mt.best_iou, lambda p, g: iou(p, g) if iou(p, g) > 0 else None),
    "cover": (
        mt.best_coverage,
        lambda p, g: c
        if (c := max(0, overlap(p, g)) / (g[1] - g[0])) > 0.5 and p[2] == g[2]
        else None,
    ),
}


@pytest.mark.parametrize("name", list(CASES))
def test_greedy_equals_loop(spark, name):
    choose, score = CASES[name]
    rows = random_rows(250, seed=len(name))
    got = frame(spark, rows).select(
        "message_id", mt.match_spans(F.col("gt"), F.col("pred"), choose).alias("m")
    )
    result = {r.message_id: r.m for r in got.collect()}
    for mid, _, _, gt, pred in rows:
        pairs = sorted((m.pred, m.gt) for m in result[mid] if m.pred is not None)
        missed = sorted(m.gt for m in result[mid] if m.pred is None)
        assert (pairs, missed) == greedy(gt, pred, score)


def test_flexible_score_equals_loop(spark):
    rows = random_rows(250, seed=5)
    got = {r.message_id: r for r in ev.flexible_score(frame(spark, rows)).collect()}
    for mid, _, _, gt, pred in rows:
        pos, neg, used = 0.0, 0, set()
        for p in pred:
            scored = [(iou(p, g), -j) for j, g in enumerate(gt) if j not in used]
            best = max([s for s in scored if s[0] > 0], default=None)
            if best is None:
                if p[4] > 0.8:
                    pos += 0.2
                else:
                    neg += 1
                continue
            s, j = best[0], -best[1]
            same = gt[j][2] == p[2]
            if s >= 0.7 and same:
                pos, _ = pos + 1, used.add(j)
            elif s >= 0.3:
                if same:
                    pos, _ = pos + 0.5, used.add(j)
                else:
                    neg += 1
            elif same:
                pos += 0.3
        neg += len(gt) - len(used)
        score = max(0, (pos - 0.5 * neg) / max(len(gt), len(pred), 1))
        assert abs(got[mid].total_score - score) < 0.00051
        near = [0.8, 0.6, 0.4]
        if min(abs(score - x) for x in near) > 1e-9:
            want = next((c for c, x in zip(("excellent", "good", "fair"), near) if score >= x), "poor")
            assert got[mid].category == want


def test_resolve_equals_loop(spark):
    rows = random_rows(300, seed=11)
    df = frame(spark, rows).select("message_id", F.col("gt").alias("spans"))
    got = {r.message_id: r for r in resolve_rows(df).collect()}
    for mid, _, _, spans, _ in rows:
        kept = []
        for s in sorted(spans, key=lambda x: (x[0], -len(x[3]))):
            for k in kept:
                if not (s[1] <= k[0] or s[0] >= k[1]):
                    if len(s[3]) > len(k[3]):
                        kept.remove(k)
                        kept.append(s)
                    break
            else:
                kept.append(s)
        assert [x.start for x in got[mid].spans] == sorted(x[0] for x in kept)
        assert sorted(tuple(x) for x in got[mid].spans) == sorted(kept)
        assert got[mid].n_removed == len(spans) - len(kept)


def test_long_chain_crosses_blocks(spark):
    """Chains and gaps longer than one block of the running helpers."""
    spans = [(i * 3, i * 3 + (4 if i % 5 else 2), "A", "x") for i in range(400)]
    df = spark.createDataFrame([(spans,)], f"gt {SPAN}")
    pairs = df.select(mt.overlapping_pairs(F.col("gt")).alias("p")).head().p
    want = {(i, j) for i in range(400) for j in range(i + 1, min(i + 3, 400)) if overlap(spans[i], spans[j]) > 0}
    assert {(p.a, p.b) for p in pairs} == want


def test_type_scores_and_identities(spark):
    rows = random_rows(200, seed=3)
    for r in ev.span_prf_by_type(frame(spark, rows)).collect():
        p = r.tp / (r.tp + r.fp) if r.tp + r.fp else 0
        q = r.tp / (r.tp + r.fn) if r.tp + r.fn else 0
        assert abs(r.precision - p) <= 0.0005001 and abs(r.recall - q) <= 0.0005001
        assert r.support == r.tp + r.fn


def test_published_scores_follow_from_counts(spark):
    """tp/fp/fn of a published report and the scores it prints."""
    from claimloom.functions.ratios import prf

    # two predictions of three right, two gold of four found
    df = spark.createDataFrame([(2, 1, 2), (0, 0, 0)], "tp int, fp int, fn int")
    p, r, f = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    got = df.select(F.round(p, 3), F.round(r, 3), F.round(f, 3)).collect()
    assert tuple(got[0]) == (0.667, 0.5, 0.571) and tuple(got[1]) == (0.0, 0.0, 0.0)


def test_matched_counts_differ(spark):
    """One gold span under two predictions: reusable overall, not by type."""
    row = [("1", "t", None, [(0, 10, "A", "x")], [(0, 4, "A", "x", 0.9), (5, 9, "A", "x", 0.9)])]
    df = frame(spark, row)
    assert ev.message_evaluation(df).head().matched_claims == 2
    assert ev.span_prf_by_type(df).head().tp == 1


def test_empty_sides(spark):
    rows = [("1", "t", "ham", [], []), ("2", "t", "ham", [], [(0, 4, "A", "x", 0.9)])]
    got = {r.message_id: r for r in ev.message_evaluation(frame(spark, rows)).collect()}
    assert (got["1"].precision, got["1"].recall) == (0.0, 1.0)
    assert (got["2"].precision, got["2"].recall) == (0.0, 0.0)
    ham = ev.ham_hallucination(frame(spark, rows)).head()
    assert (ham.total_ham, ham.with_predictions, ham.correct_empty) == (2, 1, 1)
    agree = {r.message_id: r for r in ev.annotator_agreement(frame(spark, rows)).collect()}
    assert (agree["1"].precision, agree["1"].recall) == (1.0, 1.0)
