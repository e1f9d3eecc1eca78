"""Span, slot and class evaluation.

``results`` rows hold one message each: ``message_id, text, label`` and the
arrays ``gt`` and ``pred`` of spans.  Matching runs inside the row; the only
shuffle is the final aggregate by type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.matching import (
    always,
    best_coverage,
    best_iou,
    coverage,
    cross_overlaps,
    first_any_type,
    first_same_type,
    iou,
    match_spans,
)
from ..functions.ratios import harmonic, prf, safe_ratio
from ..functions.text import strip
from ..sources.layout import write_bucketed


def _pairs(choose, consume=always) -> Column:
    """Matching entries with both spans in full."""
    return let(
        F.col("gt"),
        lambda gt: let(
            F.col("pred"),
            lambda pred: F.transform(
                match_spans(gt, pred, choose, consume),
                lambda m: F.struct(
                    F.get(gt, m["gt"]).alias("g"),
                    F.get(pred, m["pred"]).alias("p"),
                    m["pred"].alias("pred_ord"),
                    m["gt"].alias("gt_ord"),
                    m["score"].alias("score"),
                    m["used"].alias("used"),
                ),
            ),
        ),
    )


def matched_pairs(results: DataFrame, choose, consume=always) -> DataFrame:
    """One row per prediction and per gold span nobody took."""
    return results.select("message_id", F.explode(_pairs(choose, consume)).alias("m")).select(
        "message_id", "m.*"
    )


def greedy_match_typed(results: DataFrame) -> DataFrame:
    return matched_pairs(results, first_same_type)


def greedy_match_any(results: DataFrame) -> DataFrame:
    return matched_pairs(results, first_any_type)


def greedy_match_best(results: DataFrame) -> DataFrame:
    return matched_pairs(results, best_iou)


def pred_gt_overlap(results: DataFrame) -> DataFrame:
    """Every overlapping (prediction, gold) pair with IoU and gold coverage."""
    pairs = let(
        F.col("pred"),
        lambda pred: let(
            F.col("gt"),
            lambda gt: F.transform(
                cross_overlaps(pred, gt),
                lambda x: let(
                    F.struct(F.get(pred, x["l"]).alias("p"), F.get(gt, x["r"]).alias("g")),
                    lambda s: F.struct(
                        x["l"].alias("pred_ord"),
                        x["r"].alias("gt_ord"),
                        iou(s["p"], s["g"]).alias("iou"),
                        coverage(s["p"], s["g"]).alias("coverage"),
                        (s["p"]["claim_type"] == s["g"]["claim_type"]).alias("same_type"),
                    ),
                ),
            ),
        ),
    )
    return results.select("message_id", F.explode(pairs).alias("x")).select("message_id", "x.*")


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def span_prf_by_type(results: DataFrame) -> DataFrame:
    """tp/fp/fn, precision, recall and F1 per type (one-to-one matching)."""
    m = matched_pairs(results, first_same_type)
    hit = F.col("g").isNotNull() & F.col("p").isNotNull()
    agg = m.groupBy(F.coalesce("p.claim_type", "g.claim_type").alias("claim_type")).agg(
        _count(hit).alias("tp"),
        _count(F.col("g").isNull()).alias("fp"),
        _count(F.col("p").isNull()).alias("fn"),
    )
    p, r, f1 = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return agg.select(
        "claim_type",
        "tp",
        "fp",
        "fn",
        F.round(p, 3).alias("precision"),
        F.round(r, 3).alias("recall"),
        F.round(f1, 3).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def message_evaluation(results: DataFrame) -> DataFrame:
    """Per message: counts, matched predictions (gold reusable), P and R."""
    hits = let(
        F.col("pred"),
        lambda pred: let(
            F.col("gt"),
            lambda gt: F.size(
                F.array_distinct(
                    F.transform(
                        F.filter(
                            cross_overlaps(pred, gt),
                            lambda x: F.get(pred, x["l"])["claim_type"]
                            == F.get(gt, x["r"])["claim_type"],
                        ),
                        lambda x: x["l"],
                    )
                )
            ),
        ),
    )
    counted = results.select(
        "message_id",
        F.size("gt").alias("n_gt"),
        F.size("pred").alias("n_pred"),
        hits.alias("matched_claims"),
    )
    n_gt, n_pred, n = F.col("n_gt"), F.col("n_pred"), F.col("matched_claims")
    recall = F.when(n_gt > 0, safe_ratio(n, n_gt)).when(n_pred == 0, 1.0).otherwise(0.0)
    return counted.select(
        "message_id",
        "n_gt",
        "n_pred",
        "matched_claims",
        (n_gt == n_pred).alias("claim_count_match"),
        (n_pred - n_gt).alias("claim_count_diff"),
        safe_ratio(n, n_pred).alias("precision"),
        recall.alias("recall"),
    )


def span_prf_overall(results: DataFrame) -> DataFrame:
    totals = message_evaluation(results).agg(
        F.count("*").alias("total_messages"),
        F.sum("n_gt").alias("total_gt_claims"),
        F.sum("n_pred").alias("total_pred_claims"),
        F.sum("matched_claims").alias("matched"),
        _count(F.col("n_gt") > 0).alias("messages_with_claims_gt"),
        _count(F.col("n_pred") > 0).alias("messages_with_claims_pred"),
        _count(F.col("claim_count_match")).alias("perfect_matches"),
    )
    p, r, f1 = prf(F.col("matched"), F.col("total_pred_claims"), F.col("total_gt_claims"))
    return totals.select(
        "*",
        F.round(p, 3).alias("overall_precision"),
        F.round(r, 3).alias("overall_recall"),
        F.round(f1, 3).alias("overall_f1"),
        F.round(safe_ratio(F.col("total_gt_claims"), F.col("total_messages")), 2).alias(
            "avg_claims_per_message_gt"
        ),
        F.round(safe_ratio(F.col("total_pred_claims"), F.col("total_messages")), 2).alias(
            "avg_claims_per_message_pred"
        ),
    )


def span_errors(results: DataFrame, context: int = 50) -> DataFrame:
    """Errors of the match that ignores types, one row per error.

    ``context`` characters of the message on both sides of the gold span, or
    of the predicted one where there is no gold span, show where it lies.
    """

    def around(m: Column) -> Column:
        start = F.coalesce(m["g"]["start"], m["p"]["start"])
        end = F.coalesce(m["g"]["end"], m["p"]["end"])
        first = F.greatest(start - context, F.lit(0))
        return F.struct(
            m["g"].alias("g"),
            m["p"].alias("p"),
            m["gt_ord"].alias("gt_ord"),
            m["pred_ord"].alias("pred_ord"),
            F.substring(F.col("text"), first + 1, end + context - first).alias("context"),
        )

    rows = results.select(
        "message_id", F.explode(F.transform(_pairs(first_any_type), around)).alias("m")
    ).select("*", F.col("m.context").alias("context"))
    g, p = F.col("m.g"), F.col("m.p")
    moved = (g["start"] != p["start"]) | (g["end"] != p["end"])
    kind = (
        F.when(F.col("m.pred_ord").isNull(), "false_negative")
        .when(F.col("m.gt_ord").isNull(), "false_positive")
        .when(g["claim_type"] != p["claim_type"], "type_confusion")
        .when(moved, "boundary_error")
    )
    return (
        rows.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "message_id",
            "kind",
            g["claim_type"].alias("gt_type"),
            p["claim_type"].alias("pred_type"),
            g["text"].alias("gt_text"),
            p["text"].alias("pred_text"),
            p["confidence"].alias("confidence"),
            "context",
        )
    )


def type_confusion(results: DataFrame) -> DataFrame:
    m = matched_pairs(results, first_any_type)
    wrong = m.where(F.col("g.claim_type") != F.col("p.claim_type"))
    return wrong.groupBy(
        F.col("g.claim_type").alias("gt_type"), F.col("p.claim_type").alias("pred_type")
    ).agg(F.count("*").alias("n"))


# Thresholds and weights of the partial-credit score.
EXACT_IOU, PARTIAL_IOU, SURE_CONFIDENCE = 0.7, 0.3, 0.8
PARTIAL_WEIGHT, TYPE_WEIGHT, VALID_WEIGHT, PENALTY = 0.5, 0.3, 0.2, 0.5
EXCELLENT, GOOD, FAIR = 0.8, 0.6, 0.4


def flexible_score(results: DataFrame) -> DataFrame:
    """Partial credit per message, with a category for the unrounded score."""

    def consume(pred: Column, gt: Column, pick: Column) -> Column:
        return (pick["score"] >= PARTIAL_IOU) & (pred["claim_type"] == gt["claim_type"])

    def n_of(cond) -> Column:
        return F.size(F.filter("pairs", cond))

    def both(m: Column) -> Column:
        return m["g"].isNotNull() & m["p"].isNotNull()

    def same(m: Column) -> Column:
        return both(m) & (m["g"]["claim_type"] == m["p"]["claim_type"])

    scored = results.select(
        "message_id",
        F.size("gt").alias("n_gt"),
        F.size("pred").alias("n_pred"),
        F.transform(
            _pairs(best_iou, consume),
            lambda m: F.struct(
                same(m).alias("same"),
                both(m).alias("both"),
                m["p"].isNull().alias("missed"),
                m["p"]["confidence"].alias("confidence"),
                m["score"].alias("iou"),
            ),
        ).alias("pairs"),
    ).select(
        "message_id",
        "n_gt",
        "n_pred",
        n_of(lambda m: m["same"] & (m["iou"] >= EXACT_IOU)).alias("exact_match"),
        n_of(lambda m: m["same"] & (m["iou"] >= PARTIAL_IOU) & (m["iou"] < EXACT_IOU)).alias(
            "partial_overlap"
        ),
        n_of(lambda m: m["same"] & (m["iou"] < PARTIAL_IOU)).alias("type_match"),
        n_of(lambda m: ~m["both"] & ~m["missed"] & (m["confidence"] > SURE_CONFIDENCE)).alias(
            "valid_detection"
        ),
        n_of(lambda m: m["both"] & ~m["same"] & (m["iou"] >= PARTIAL_IOU)).alias("wrong_type"),
        n_of(lambda m: ~m["both"] & ~m["missed"] & (m["confidence"] <= SURE_CONFIDENCE)).alias(
            "false_positive"
        ),
        n_of(lambda m: m["missed"]).alias("missed_claim"),
    )
    positive = (
        F.col("exact_match")
        + F.col("partial_overlap") * PARTIAL_WEIGHT
        + F.col("type_match") * TYPE_WEIGHT
        + F.col("valid_detection") * VALID_WEIGHT
    )
    negative = F.col("wrong_type") + F.col("false_positive") + F.col("missed_claim")
    size = F.greatest("n_gt", "n_pred", F.lit(1))
    score = F.greatest((positive - negative * PENALTY) / size, F.lit(0.0))
    with_score = scored.withColumn("score", score)
    s = F.col("score")
    return with_score.select(
        *[c for c in with_score.columns if c != "score"],
        F.round(s, 3).alias("total_score"),
        F.when(s >= EXCELLENT, "excellent")
        .when(s >= GOOD, "good")
        .when(s >= FAIR, "fair")
        .otherwise("poor")
        .alias("category"),
    )


def category_exemplar(scores: DataFrame, order: Column | None = None) -> DataFrame:
    """The first message of each category."""
    key = F.col("message_id") if order is None else order
    return scores.groupBy("category").agg(
        F.min_by("message_id", key).alias("message_id"),
        F.min_by("total_score", key).alias("total_score"),
    )


def entity_relaxed_match(results: DataFrame) -> DataFrame:
    """Totals of the match that asks for over half of the gold span, same type."""
    per_message = results.select(
        F.size("gt").alias("n_gt"),
        F.size("pred").alias("n_pred"),
        F.size(F.filter(_pairs(best_coverage), lambda m: m["used"])).alias("matched"),
    )
    totals = per_message.agg(
        F.count("*").alias("total_messages"),
        F.sum("n_gt").alias("total_gt"),
        F.sum("n_pred").alias("total_pred"),
        F.sum("matched").alias("total_matched"),
        _count(F.col("n_gt") == F.col("n_pred")).alias("count_matches"),
    )
    p, r, f1 = prf(F.col("total_matched"), F.col("total_pred"), F.col("total_gt"))
    return totals.select(
        "*",
        F.round(p, 3).alias("precision"),
        F.round(r, 3).alias("recall"),
        F.round(f1, 3).alias("f1"),
        F.round(safe_ratio(F.col("count_matches"), F.col("total_messages")), 3).alias(
            "count_accuracy"
        ),
    )


# ---------------------------------------------------------------- parsed claims

KEY = ["message_id", "claim_id", "claim_type"]


def last_per_key(claims: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Keep the last row per key.  ``order`` names the input-order column;
    None states that keys are unique already, which saves the aggregate."""
    if order is None:
        return claims
    rest = [c for c in claims.columns if c not in keys]
    return (
        claims.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
        .select(*keys, "row.*")
    )


def bucketed_claims(claims: DataFrame, buckets: int, order: str | None = None) -> DataFrame:
    """Parsed claims as a table bucketed by message, claim and type, the last row per key.

    Two such tables with equal ``buckets`` go through ``align_gold_pred``, ``slot_prf`` and
    ``canonical_match`` without a shuffle of either side, as often as they are read.
    """
    last = last_per_key(claims, KEY, order)
    return write_bucketed(last.select(*KEY, "canonical_form", "slots"), KEY, buckets)


def align_gold_pred(gold: DataFrame, pred: DataFrame, order: str | None = None) -> DataFrame:
    """Full outer alignment on message, claim and type."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        kept = last_per_key(df, KEY, order)
        return kept.select(*KEY, F.struct("canonical_form", "slots").alias(tag))

    return side(gold, "gold").join(side(pred, "pred"), KEY, "full_outer")


def _as_text(value: Column) -> Column:
    return F.lower(strip(value))


def _correct_slots(gold: Column, pred: Column) -> Column:
    """Slots in both whose values agree; two NULLs agree."""
    shared = F.filter(F.map_keys(gold), lambda k: F.map_contains_key(pred, k))
    return F.size(
        F.filter(
            shared,
            lambda k: _as_text(F.try_element_at(gold, k)).eqNullSafe(
                _as_text(F.try_element_at(pred, k))
            ),
        )
    )


def slot_prf(gold: DataFrame, pred: DataFrame, order: str | None = None) -> DataFrame:
    """Slot precision, recall and F1 per type and overall ('_overall')."""
    a = align_gold_pred(gold, pred, order)
    g, p = F.col("gold"), F.col("pred")
    counted = a.select(
        "claim_type",
        F.coalesce(F.size(g["slots"]), F.lit(0)).alias("n_gold"),
        F.coalesce(F.size(p["slots"]), F.lit(0)).alias("n_pred"),
        F.when(g.isNotNull() & p.isNotNull(), _correct_slots(g["slots"], p["slots"]))
        .otherwise(0)
        .alias("n_correct"),
    )
    sums = counted.groupingSets(
        [[F.col("claim_type")], []], F.col("claim_type")
    ).agg(
        F.grouping("claim_type").alias("all_types"),
        F.sum("n_gold").alias("gold_slots"),
        F.sum("n_pred").alias("pred_slots"),
        F.sum("n_correct").alias("correct_slots"),
    )
    pr, rc, f1 = prf(F.col("correct_slots"), F.col("pred_slots"), F.col("gold_slots"))
    name = F.when(F.col("all_types") == 1, "_overall").otherwise(F.col("claim_type"))
    return sums.select(
        name.alias("claim_type"),
        F.coalesce("gold_slots", F.lit(0)).alias("gold_slots"),
        F.coalesce("pred_slots", F.lit(0)).alias("pred_slots"),
        F.coalesce("correct_slots", F.lit(0)).alias("correct_slots"),
        pr.alias("slot_precision"),
        rc.alias("slot_recall"),
        f1.alias("slot_f1"),
    )


def canonical_match(gold: DataFrame, pred: DataFrame, order: str | None = None) -> DataFrame:
    """Exact rate of canonical sentences.  A missing prediction counts in the
    denominator; an aligned pair only if both sentences are non-empty."""
    a = align_gold_pred(gold, pred, order)
    g, p = F.col("gold"), F.col("pred")
    both = (
        g.isNotNull()
        & p.isNotNull()
        & (F.coalesce(F.length(g["canonical_form"]), F.lit(0)) > 0)
        & (F.coalesce(F.length(p["canonical_form"]), F.lit(0)) > 0)
    )
    lost = g.isNotNull() & p.isNull()
    equal = both & (_as_text(g["canonical_form"]) == _as_text(p["canonical_form"]))
    sums = a.agg(_count(equal).alias("exact"), _count(both | lost).alias("total"))
    return sums.select(
        "exact", "total", safe_ratio(F.col("exact"), F.col("total")).alias("canonical_exact_match")
    )


def f1_ranking(slot_scores: DataFrame) -> DataFrame:
    """Types by F1, best first, without the overall row."""
    return slot_scores.where(F.col("claim_type") != "_overall").orderBy(
        F.col("slot_f1").desc(), "claim_type"
    )


def ham_hallucination(results: DataFrame) -> DataFrame:
    ham = results.where(F.col("label") == "ham")
    sums = ham.agg(
        F.count("*").alias("total_ham"), _count(F.size("pred") > 0).alias("with_predictions")
    )
    return sums.select(
        "total_ham",
        "with_predictions",
        (F.col("total_ham") - F.col("with_predictions")).alias("correct_empty"),
        safe_ratio(F.col("with_predictions"), F.col("total_ham")).alias("hallucination_rate"),
    )


# ---------------------------------------------------------------- annotators

def _claim_set(spans: Column) -> Column:
    return F.array_distinct(
        F.transform(
            spans,
            lambda s: F.struct(strip(F.lower(s["text"])).alias("text"), s["claim_type"].alias("label")),
        )
    )


def annotator_agreement(results: DataFrame) -> DataFrame:
    """Set agreement of two annotators (``gt`` = A, ``pred`` = B) per message."""
    sets = results.select(
        "message_id",
        "label",
        "text",
        _claim_set(F.col("gt")).alias("a"),
        _claim_set(F.col("pred")).alias("b"),
    ).select(
        "message_id",
        "label",
        "text",
        F.array_intersect("a", "b").alias("agreement"),
        F.array_except("a", "b").alias("only_a"),
        F.array_except("b", "a").alias("only_b"),
        F.size("a").alias("n_a"),
        F.size("b").alias("n_b"),
    )
    n = F.size("agreement")
    p = F.when(F.col("n_a") > 0, safe_ratio(n, F.col("n_a"))).otherwise(1.0)
    r = F.when(F.col("n_b") > 0, safe_ratio(n, F.col("n_b"))).otherwise(1.0)
    return sets.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", harmonic(F.col("precision"), F.col("recall"))
    )


def agreement_report(agreement: DataFrame) -> DataFrame:
    """Means over non-ham messages plus A-only claims per label, long form.

    One pass: a message gives one entry with its scores and one per claim
    only A saw; sums per label follow.
    """
    scores = ["precision", "recall", "f1"]
    used = agreement.where(~F.col("label").eqNullSafe(F.lit("ham")))
    message = F.struct(
        F.lit(None).cast("string").alias("label"), *[F.col(c).alias(c) for c in scores]
    )
    claims = F.transform(
        "only_a", lambda c: F.struct(c["label"].alias("label"), *[F.lit(0.0).alias(s) for s in scores])
    )
    sums = (
        used.select(F.explode(F.concat(F.array(message), claims)).alias("e"))
        .groupBy("e.label")
        .agg(F.count("*").cast("double").alias("n"), *[F.sum(F.col("e")[c]).alias(c) for c in scores])
    )
    n = F.col("n")
    items = F.when(
        F.col("label").isNull(),
        F.array(
            F.struct(F.lit("total_samples").alias("item"), n.alias("value")),
            *[
                F.struct(F.lit(f"avg_{c}").alias("item"), F.round(F.col(c) / n, 3).alias("value"))
                for c in scores
            ],
        ),
    ).otherwise(
        F.array(F.struct(F.concat(F.lit("errors:"), "label").alias("item"), n.alias("value")))
    )
    return sums.select(F.explode(items).alias("x")).select("x.*")


def set_intersections(results: DataFrame) -> DataFrame:
    """Distinct (text, type) claims of both annotators, of A only, of B only."""

    def side(column: str, a: int) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                strip(F.lower(s["text"])).alias("text"),
                s["claim_type"].alias("label"),
                F.lit(a).alias("a"),
                F.lit(1 - a).alias("b"),
            ),
        )

    seen = (
        results.select(F.explode(F.concat(side("gt", 1), side("pred", 0))).alias("c"))
        .groupBy("c.text", "c.label")
        .agg(F.max("c.a").alias("a"), F.max("c.b").alias("b"))
    )
    part = F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "only_a").otherwise("only_b")
    return seen.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def identity_issues(agreement: DataFrame, n: int = 20) -> DataFrame:
    """The first n identity claims only annotator A saw."""
    used = agreement.where(~F.col("label").eqNullSafe(F.lit("ham")))
    rows = used.select(
        "message_id", F.col("text").alias("message"), F.explode("only_a").alias("c")
    ).where(F.col("c.label") == "IDENTITY_CLAIM")
    return (
        rows.select("message_id", "message", F.col("c.text").alias("text"))
        .orderBy("message_id", "text")
        .limit(n)
    )


# ---------------------------------------------------------------- classes

def binary_report(rows: DataFrame, truth: str, guess: str, positive: str = "SMISH") -> DataFrame:
    """One row: 2x2 confusion, accuracy, per-class and weighted scores, FPR, FNR."""
    t, g = F.col(truth) == positive, F.col(guess) == positive
    c = rows.agg(
        _count(t & g).alias("tp"),
        _count(~t & g).alias("fp"),
        _count(~t & ~g).alias("tn"),
        _count(t & ~g).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    sp, sr, sf = prf(tp, tp + fp, tp + fn)
    hp, hr, hf = prf(tn, tn + fn, tn + fp)
    return c.select(
        "tp",
        "fp",
        "tn",
        "fn",
        safe_ratio(tp + tn, total).alias("accuracy"),
        sp.alias("smish_precision"),
        sr.alias("smish_recall"),
        sf.alias("smish_f1"),
        hp.alias("ham_precision"),
        hr.alias("ham_recall"),
        hf.alias("ham_f1"),
        safe_ratio(sf * (tp + fn) + hf * (tn + fp), total).alias("weighted_f1"),
        safe_ratio(fp, fp + tn).alias("fpr"),
        safe_ratio(fn, fn + tp).alias("fnr"),
    )
