"""Queries of the evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses as rs
from ..operators import evaluate as ev
from ..operators import intervals as iv
from ..session import stage
from . import views as v
from .registry import ORACLES, query
from .views import _WS

@query(
    "span_prf_by_type",
    """
    WITH c AS (
      SELECT coalesce(p.claim_type, g.claim_type) AS claim_type,
             count(*) FILTER (m.pred IS NOT NULL AND m.gt IS NOT NULL) AS tp,
             count(*) FILTER (m.gt IS NULL) AS fp, count(*) FILTER (m.pred IS NULL) AS fn
      FROM m_typed m LEFT JOIN f_gt g ON g.doc_id = m.doc_id AND g.ord = m.gt
      LEFT JOIN f_pred p ON p.doc_id = m.doc_id AND p.ord = m.pred GROUP BY 1),
    r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS r FROM c)
    SELECT claim_type, tp, fp, fn, round(p, 3) AS precision, round(r, 3) AS recall,
           round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 3) AS f1, tp + fn AS support FROM r
    """,
)
def span_prf_by_type(spark, sf_dir):
    return ev.span_prf_by_type(v.results(spark, sf_dir))


_OVERALL = """
    WITH n AS (
      SELECT m.doc_id, (SELECT count(*) FROM f_gt g WHERE g.doc_id = m.doc_id) AS n_gt,
             (SELECT count(*) FROM f_pred p WHERE p.doc_id = m.doc_id) AS n_pred FROM f_messages m),
    hit AS (
      SELECT p.doc_id, count(DISTINCT p.ord) AS k FROM f_pred p JOIN f_gt g
      ON g.doc_id = p.doc_id AND g.claim_type = p.claim_type AND least(g.e, p.e) > greatest(g.s, p.s) GROUP BY 1),
    e AS (SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN hit USING (doc_id))
"""


@query(
    "span_prf_overall",
    _OVERALL
    + """,
    t AS (
      SELECT count(*) AS total_messages, CAST(sum(n_gt) AS BIGINT) AS total_gt_claims, CAST(sum(n_pred) AS BIGINT) AS total_pred_claims,
             CAST(sum(k) AS BIGINT) AS matched, count(*) FILTER (n_gt > 0) AS messages_with_claims_gt,
             count(*) FILTER (n_pred > 0) AS messages_with_claims_pred, count(*) FILTER (n_gt = n_pred) AS perfect_matches FROM e),
    r AS (SELECT *, matched::DOUBLE / total_pred_claims AS p, matched::DOUBLE / total_gt_claims AS r FROM t)
    SELECT * EXCLUDE (p, r), round(p, 3) AS overall_precision, round(r, 3) AS overall_recall,
           round(2 * p * r / (p + r), 3) AS overall_f1,
           round(total_gt_claims::DOUBLE / total_messages, 2) AS avg_claims_per_message_gt,
           round(total_pred_claims::DOUBLE / total_messages, 2) AS avg_claims_per_message_pred FROM r
    """,
)
def span_prf_overall(spark, sf_dir):
    return ev.span_prf_overall(v.results(spark, sf_dir))


@query(
    "message_evaluation",
    _OVERALL
    + """
    SELECT CAST(doc_id AS VARCHAR) AS message_id, n_gt, n_pred, k AS matched_claims, n_gt = n_pred AS claim_count_match,
           n_pred - n_gt AS claim_count_diff, round(coalesce(k::DOUBLE / nullif(n_pred, 0), 0.0), 6) AS precision,
           round(CASE WHEN n_gt > 0 THEN k::DOUBLE / n_gt WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END, 6) AS recall FROM e
    """,
)
def message_evaluation(spark, sf_dir):
    out = ev.message_evaluation(v.results(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    "span_errors",
    """
    WITH k AS (
      SELECT *, CASE WHEN pred IS NULL THEN 'false_negative' WHEN gt IS NULL THEN 'false_positive'
                     WHEN g_type <> p_type THEN 'type_confusion'
                     WHEN g_s <> p_s OR g_e <> p_e THEN 'boundary_error' END AS kind FROM m_full_any)
    SELECT CAST(k.doc_id AS VARCHAR) AS message_id, kind, g_type AS gt_type, p_type AS pred_type, g_text AS gt_text,
           p_text AS pred_text, confidence,
           substring(m.text, greatest(coalesce(g_s, p_s) - 50, 0) + 1, coalesce(g_e, p_e) + 50 - greatest(coalesce(g_s, p_s) - 50, 0)) AS context
    FROM k JOIN f_messages m ON m.doc_id = k.doc_id WHERE kind IS NOT NULL
    """,
)
def span_errors(spark, sf_dir):
    return ev.span_errors(v.results(spark, sf_dir))


@query(
    "type_confusion",
    """SELECT g_type AS gt_type, p_type AS pred_type, count(*) AS n FROM m_full_any WHERE g_type <> p_type GROUP BY 1, 2""",
)
def type_confusion(spark, sf_dir):
    return ev.type_confusion(v.results(spark, sf_dir))


def _pairs_out(df):
    return df.select("message_id", "pred_ord", "gt_ord", F.round("score", 6).alias("score"))


def _pairs_sql(view: str) -> str:
    return f"SELECT CAST(doc_id AS VARCHAR) AS message_id, pred AS pred_ord, gt AS gt_ord, round(score, 6) AS score FROM {view}"


@query("greedy_match_typed", _pairs_sql("m_typed"))
def greedy_match_typed(spark, sf_dir):
    return _pairs_out(ev.greedy_match_typed(v.results(spark, sf_dir)))


@query("greedy_match_any", _pairs_sql("m_any"))
def greedy_match_any(spark, sf_dir):
    return _pairs_out(ev.greedy_match_any(v.results(spark, sf_dir)))


@query("greedy_match_best", _pairs_sql("m_iou"))
def greedy_match_best(spark, sf_dir):
    return _pairs_out(ev.greedy_match_best(v.results(spark, sf_dir)))


@query(
    "pred_gt_overlap",
    """
    WITH x AS (
      SELECT p.doc_id, p.ord AS pred_ord, g.ord AS gt_ord, least(g.e, p.e) - greatest(g.s, p.s) AS i,
             g.e - g.s AS gl, p.e - p.s AS pl, p.claim_type = g.claim_type AS same_type
      FROM f_pred p JOIN f_gt g ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e)
    SELECT CAST(doc_id AS VARCHAR) AS message_id, pred_ord, gt_ord, round(i::DOUBLE / (gl + pl - i), 6) AS iou,
           round(i::DOUBLE / gl, 6) AS coverage, same_type FROM x WHERE i > 0
    """,
)
def pred_gt_overlap(spark, sf_dir):
    out = ev.pred_gt_overlap(v.results(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("iou", "coverage")})


@query("pred_gt_overlap_flat", ORACLES["pred_gt_overlap"])
def pred_gt_overlap_flat(spark, sf_dir):
    """The same of one row per span on either side, joined by position bins."""
    bounds = {c: F.transform(c, lambda s: F.struct(s["start"], s["end"], s["claim_type"])).alias(c) for c in ("gt", "pred")}
    # eight passes follow over the spans, which are derived once
    rows = stage(v.results(spark, sf_dir).select("message_id", *bounds.values()), "result_spans")

    def flat(side):
        return rows.select("message_id", F.posexplode(side).alias("claim_id", "s")).select("message_id", "claim_id", "s.start", "s.end", "s.claim_type")

    pred, gold = flat("pred"), flat("gt")
    found = iv.overlaps(pred, gold)
    p = pred.select(F.col("message_id").alias("m"), F.col("claim_id").alias("left_id"), (F.col("end") - F.col("start")).alias("pl"), F.col("claim_type").alias("pt"))
    g = gold.select(F.col("message_id").alias("n"), F.col("claim_id").alias("right_id"), (F.col("end") - F.col("start")).alias("gl"), F.col("claim_type").alias("gt"))
    named = found.join(p.withColumnRenamed("m", "message_id"), ["message_id", "left_id"]).join(g.withColumnRenamed("n", "message_id"), ["message_id", "right_id"])
    return named.where("shared > 0").select(
        "message_id",
        F.col("left_id").alias("pred_ord"),
        F.col("right_id").alias("gt_ord"),
        F.round(F.col("shared") / (F.col("gl") + F.col("pl") - F.col("shared")), 6).alias("iou"),
        F.round(F.col("shared") / F.col("gl"), 6).alias("coverage"),
        (F.col("pt") == F.col("gt")).alias("same_type"),
    )


_FLEX = """
    WITH x AS (
      SELECT m.doc_id, m.pred, m.gt, m.score AS iou, p.confidence, p.claim_type = g.claim_type AS same
      FROM m_flex m LEFT JOIN f_gt g ON g.doc_id = m.doc_id AND g.ord = m.gt
      LEFT JOIN f_pred p ON p.doc_id = m.doc_id AND p.ord = m.pred),
    b AS (
      SELECT m.message_id, m.doc_id,
             (SELECT count(*) FROM f_gt g WHERE g.doc_id = m.doc_id) AS n_gt, (SELECT count(*) FROM f_pred p WHERE p.doc_id = m.doc_id) AS n_pred,
             count(*) FILTER (pred IS NOT NULL AND gt IS NOT NULL AND same AND iou >= 0.7) AS exact_match,
             count(*) FILTER (pred IS NOT NULL AND gt IS NOT NULL AND same AND iou >= 0.3 AND iou < 0.7) AS partial_overlap,
             count(*) FILTER (pred IS NOT NULL AND gt IS NOT NULL AND same AND iou < 0.3) AS type_match,
             count(*) FILTER (pred IS NOT NULL AND gt IS NULL AND confidence > 0.8) AS valid_detection,
             count(*) FILTER (pred IS NOT NULL AND gt IS NOT NULL AND NOT same AND iou >= 0.3) AS wrong_type,
             count(*) FILTER (pred IS NOT NULL AND gt IS NULL AND confidence <= 0.8) AS false_positive,
             count(*) FILTER (pred IS NULL AND gt IS NOT NULL) AS missed_claim
      FROM f_messages m LEFT JOIN x USING (doc_id) GROUP BY 1, 2),
    s AS (
      SELECT *, greatest((exact_match + partial_overlap * 0.5::DOUBLE + type_match * 0.3::DOUBLE + valid_detection * 0.2::DOUBLE
                - (wrong_type + false_positive + missed_claim) * 0.5::DOUBLE) / greatest(n_gt, n_pred, 1), 0.0) AS score FROM b),
    flex AS (
      SELECT * EXCLUDE (doc_id, score), round(score, 3) AS total_score, doc_id,
             CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS category FROM s)
"""


@query("flexible_score", _FLEX + " SELECT * EXCLUDE (doc_id) FROM flex")
def flexible_score(spark, sf_dir):
    return ev.flexible_score(v.results(spark, sf_dir))


@query(
    "category_exemplar",
    _FLEX
    + " SELECT category, arg_min(message_id, doc_id) AS message_id, arg_min(total_score, doc_id) AS total_score FROM flex GROUP BY 1",
)
def category_exemplar(spark, sf_dir):
    return ev.category_exemplar(
        ev.flexible_score(v.results(spark, sf_dir)), F.col("message_id").cast("bigint")
    )


@query(
    "entity_relaxed_match",
    """
    WITH n AS (
      SELECT m.doc_id, (SELECT count(*) FROM f_gt g WHERE g.doc_id = m.doc_id) AS n_gt,
             (SELECT count(*) FROM f_pred p WHERE p.doc_id = m.doc_id) AS n_pred,
             (SELECT count(*) FROM m_cover c WHERE c.doc_id = m.doc_id AND c.used) AS k FROM f_messages m),
    t AS (SELECT count(*) AS total_messages, CAST(sum(n_gt) AS BIGINT) AS total_gt, CAST(sum(n_pred) AS BIGINT) AS total_pred,
                 CAST(sum(k) AS BIGINT) AS total_matched, count(*) FILTER (n_gt = n_pred) AS count_matches FROM n),
    r AS (SELECT *, total_matched::DOUBLE / total_pred AS p, total_matched::DOUBLE / total_gt AS r FROM t)
    SELECT * EXCLUDE (p, r), round(p, 3) AS precision, round(r, 3) AS recall, round(2 * p * r / (p + r), 3) AS f1,
           round(count_matches::DOUBLE / total_messages, 3) AS count_accuracy FROM r
    """,
)
def entity_relaxed_match(spark, sf_dir):
    return ev.entity_relaxed_match(v.results(spark, sf_dir))


# ---------------------------------------------------------------- parsed claims


@query(
    "align_gold_pred",
    """
    SELECT message_id, claim_id, claim_type, g.canonical_form AS gold_form, p.canonical_form AS pred_form
    FROM f_pclaims_g g FULL JOIN f_pclaims_p p USING (message_id, claim_id, claim_type)
    """,
)
def align_gold_pred(spark, sf_dir):
    a = ev.align_gold_pred(v.parsed_gold(spark, sf_dir), v.parsed_pred(spark, sf_dir))
    return a.select(
        *ev.KEY,
        F.col("gold.canonical_form").alias("gold_form"),
        F.col("pred.canonical_form").alias("pred_form"),
    )


def _runs(gold, pred):
    """Predictions of two runs in input order: a draft of every gold claim, then ``pred``."""
    drafts = gold.select(*ev.KEY, F.concat(F.lit("draft: "), "canonical_form").alias("canonical_form"), "slots")
    kept = pred.select(*ev.KEY, "canonical_form", "slots")
    return drafts.withColumn("run", F.lit(1)).unionByName(kept.withColumn("run", F.lit(2)))


@query(
    "align_gold_pred_last_wins",
    """
    SELECT message_id, claim_id, claim_type, g.canonical_form AS gold_form,
           CASE WHEN p.claim_id IS NULL THEN 'draft: ' || g.canonical_form ELSE p.canonical_form END AS pred_form
    FROM f_pclaims_g g FULL JOIN f_pclaims_p p USING (message_id, claim_id, claim_type)
    """,
)
def align_gold_pred_last_wins(spark, sf_dir):
    """Both sides as bucketed tables, repeated keys reduced to the later run; joined without an exchange."""
    gold = v.parsed_gold(spark, sf_dir)
    pred = _runs(gold, v.parsed_pred(spark, sf_dir))
    a = ev.align_gold_pred(ev.bucketed_claims(gold, 32), ev.bucketed_claims(pred, 32, "run"))
    return a.select(
        *ev.KEY,
        F.col("gold.canonical_form").alias("gold_form"),
        F.col("pred.canonical_form").alias("pred_form"),
    )


_SLOTS = rf"""
    WITH a AS (
      SELECT coalesce(g.claim_type, p.claim_type) AS claim_type, g.slot IS NOT NULL AS in_g, p.slot IS NOT NULL AS in_p,
             g.slot IS NOT NULL AND p.slot IS NOT NULL AND
             lower(regexp_replace(g.value, '^{_WS}+|{_WS}+$', '', 'g')) IS NOT DISTINCT FROM lower(regexp_replace(p.value, '^{_WS}+|{_WS}+$', '', 'g')) AS ok
      FROM f_slots_g g FULL JOIN f_slots_p p ON g.message_id = p.message_id AND g.claim_id = p.claim_id
        AND g.claim_type = p.claim_type AND g.slot = p.slot),
    c AS (
      SELECT CASE WHEN grouping(claim_type) = 1 THEN '_overall' ELSE claim_type END AS claim_type,
             count(*) FILTER (in_g) AS gold_slots, count(*) FILTER (in_p) AS pred_slots, count(*) FILTER (ok) AS correct_slots
      FROM a GROUP BY GROUPING SETS ((claim_type), ())),
    r AS (SELECT *, correct_slots::DOUBLE / pred_slots AS p, correct_slots::DOUBLE / gold_slots AS r FROM c),
    slot AS (SELECT claim_type, gold_slots, pred_slots, correct_slots, round(p, 6) AS slot_precision, round(r, 6) AS slot_recall,
             round(2 * p * r / (p + r), 6) AS slot_f1 FROM r)
"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("slot_precision", "slot_recall", "slot_f1")})


@query("slot_prf", _SLOTS + " SELECT * FROM slot")
def slot_prf(spark, sf_dir):
    return _rounded(ev.slot_prf(v.parsed_gold(spark, sf_dir), v.parsed_pred(spark, sf_dir)))


@query("f1_ranking", _SLOTS + " SELECT * FROM slot WHERE claim_type <> '_overall' ORDER BY slot_f1 DESC, claim_type")
def f1_ranking(spark, sf_dir):
    return _rounded(
        ev.f1_ranking(ev.slot_prf(v.parsed_gold(spark, sf_dir), v.parsed_pred(spark, sf_dir)))
    )


@query(
    "canonical_match",
    """
    WITH a AS (
      SELECT g.canonical_form AS g, p.canonical_form AS p FROM f_pclaims_g g
      FULL JOIN f_pclaims_p p USING (message_id, claim_id, claim_type)),
    c AS (SELECT count(*) FILTER (g <> '' AND p <> '' AND lower(trim(g)) = lower(trim(p))) AS exact,
                 count(*) FILTER (g IS NOT NULL AND (p IS NULL OR (g <> '' AND p <> ''))) AS total FROM a)
    SELECT exact, total, round(exact::DOUBLE / total, 6) AS canonical_exact_match FROM c
    """,
)
def canonical_match(spark, sf_dir):
    out = ev.canonical_match(v.parsed_gold(spark, sf_dir), v.parsed_pred(spark, sf_dir))
    return out.withColumn("canonical_exact_match", F.round("canonical_exact_match", 6))


@query(
    "ham_hallucination",
    """
    WITH h AS (SELECT m.doc_id, EXISTS (SELECT 1 FROM f_pred p WHERE p.doc_id = m.doc_id) AS hit FROM f_messages m WHERE label = 'ham')
    SELECT count(*) AS total_ham, count(*) FILTER (hit) AS with_predictions, count(*) FILTER (NOT hit) AS correct_empty,
           round((count(*) FILTER (hit))::DOUBLE / count(*), 6) AS hallucination_rate FROM h
    """,
)
def ham_hallucination(spark, sf_dir):
    out = ev.ham_hallucination(v.results(spark, sf_dir))
    return out.withColumn("hallucination_rate", F.round("hallucination_rate", 6))


# ---------------------------------------------------------------- annotators

_AGREE = rf"""
    WITH a AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '^{_WS}+|{_WS}+$', '', 'g') AS t, claim_type AS c FROM f_gt),
    b AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '^{_WS}+|{_WS}+$', '', 'g') AS t, claim_type AS c FROM f_pred),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.t AS at, b.t AS bt, coalesce(a.c, b.c) AS c,
                 a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b
          FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.t = b.t AND a.c = b.c),
    n AS (
      SELECT m.message_id, m.doc_id, m.label, count(*) FILTER (in_a AND in_b) AS n_agree, count(*) FILTER (in_a AND NOT in_b) AS n_only_a,
             count(*) FILTER (in_b AND NOT in_a) AS n_only_b, count(*) FILTER (in_a) AS n_a, count(*) FILTER (in_b) AS n_b
      FROM f_messages m LEFT JOIN j USING (doc_id) GROUP BY 1, 2, 3),
    pr AS (SELECT *, CASE WHEN n_a > 0 THEN n_agree::DOUBLE / n_a ELSE 1.0 END AS p, CASE WHEN n_b > 0 THEN n_agree::DOUBLE / n_b ELSE 1.0 END AS r FROM n),
    agree AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM pr)
"""


@query(
    "annotator_agreement",
    _AGREE
    + "SELECT message_id, n_agree, n_only_a, n_only_b, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM agree",
)
def annotator_agreement(spark, sf_dir):
    a = ev.annotator_agreement(v.results(spark, sf_dir))
    return a.select(
        "message_id",
        F.size("agreement").alias("n_agree"),
        F.size("only_a").alias("n_only_a"),
        F.size("only_b").alias("n_only_b"),
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
    )


@query(
    "reannotation_agreement",
    _AGREE.replace("AS c FROM f_pred)", "AS c FROM f_pred WHERE doc_id % 7 <> 3)")
    + "SELECT message_id, n_agree, n_only_a, n_only_b, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM agree",
)
def reannotation_agreement(spark, sf_dir):
    """Annotator B is a model: its claims are parsed from replies, some fenced, some broken."""
    rows = v.results(spark, sf_dir)
    claims = F.transform("pred", lambda p: F.struct(p["text"].alias("text"), p["claim_type"].alias("label")))
    body = F.to_json(F.struct(claims.alias("claims")))
    number = F.col("message_id").cast("long") % 7
    reply = (
        F.when(number == 3, F.concat(F.lit("Sorry: "), body))
        .when(number == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    second = rows.withColumn("reply", reply).drop("pred")
    a = ev.annotator_agreement(second.withColumn("pred", rs.parse_reannotation(F.col("reply"))))
    return a.select(
        "message_id",
        F.size("agreement").alias("n_agree"),
        F.size("only_a").alias("n_only_a"),
        F.size("only_b").alias("n_only_b"),
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
    )


@query(
    "agreement_report",
    _AGREE
    + """
    SELECT item, value FROM (
      SELECT 'total_samples' AS item, count(*)::DOUBLE AS value FROM agree WHERE label IS DISTINCT FROM 'ham'
      UNION ALL SELECT 'avg_precision', round(avg(p), 3) FROM agree WHERE label IS DISTINCT FROM 'ham'
      UNION ALL SELECT 'avg_recall', round(avg(r), 3) FROM agree WHERE label IS DISTINCT FROM 'ham'
      UNION ALL SELECT 'avg_f1', round(avg(f1), 3) FROM agree WHERE label IS DISTINCT FROM 'ham'
      UNION ALL SELECT 'errors:' || c, count(*)::DOUBLE FROM j JOIN f_messages m USING (doc_id)
        WHERE in_a AND NOT in_b AND m.label IS DISTINCT FROM 'ham' GROUP BY c)
    """,
)
def agreement_report(spark, sf_dir):
    return ev.agreement_report(ev.annotator_agreement(v.results(spark, sf_dir)))


@query(
    "set_intersections",
    rf"""
    WITH a AS (SELECT DISTINCT regexp_replace(lower(text), '^{_WS}+|{_WS}+$', '', 'g') AS t, claim_type AS c FROM f_gt),
    b AS (SELECT DISTINCT regexp_replace(lower(text), '^{_WS}+|{_WS}+$', '', 'g') AS t, claim_type AS c FROM f_pred)
    SELECT part, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT 'both' AS part FROM a JOIN b USING (t, c)
      UNION ALL SELECT 'only_a' FROM a ANTI JOIN b USING (t, c)
      UNION ALL SELECT 'only_b' FROM b ANTI JOIN a USING (t, c)) GROUP BY part
    """,
)
def set_intersections(spark, sf_dir):
    return ev.set_intersections(v.results(spark, sf_dir))


# ---------------------------------------------------------------- classes


@query(
    "binary_report",
    """
    WITH x AS (
      SELECT CASE WHEN label = 'ham' OR NOT EXISTS (SELECT 1 FROM f_gt g WHERE g.doc_id = m.doc_id) THEN 'HAM' ELSE 'SMISH' END AS t,
             CASE WHEN EXISTS (SELECT 1 FROM f_pred p WHERE p.doc_id = m.doc_id) THEN 'SMISH' ELSE 'HAM' END AS g FROM f_messages m),
    c AS (
      SELECT count(*) FILTER (t = 'SMISH' AND g = 'SMISH') AS tp, count(*) FILTER (t = 'HAM' AND g = 'SMISH') AS fp,
             count(*) FILTER (t = 'HAM' AND g = 'HAM') AS tn, count(*) FILTER (t = 'SMISH' AND g = 'HAM') AS fn FROM x),
    r AS (SELECT *, tp::DOUBLE / (tp + fp) AS sp, tp::DOUBLE / (tp + fn) AS sr, tn::DOUBLE / (tn + fn) AS hp, tn::DOUBLE / (tn + fp) AS hr FROM c),
    f AS (SELECT *, 2 * sp * sr / (sp + sr) AS sf, 2 * hp * hr / (hp + hr) AS hf FROM r)
    SELECT tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(sp, 6) AS smish_precision,
           round(sr, 6) AS smish_recall, round(sf, 6) AS smish_f1, round(hp, 6) AS ham_precision, round(hr, 6) AS ham_recall,
           round(hf, 6) AS ham_f1, round((sf * (tp + fn) + hf * (tn + fp)) / (tp + fp + tn + fn), 6) AS weighted_f1,
           round(fp::DOUBLE / (fp + tn), 6) AS fpr, round(fn::DOUBLE / (fn + tp), 6) AS fnr FROM f
    """,
)
def binary_report(spark, sf_dir):
    r = v.results(spark, sf_dir)
    ham = F.col("label").eqNullSafe(F.lit("ham")) | (F.size("gt") == 0)
    rows = r.select(
        F.when(ham, "HAM").otherwise("SMISH").alias("truth"),
        F.when(F.size("pred") > 0, "SMISH").otherwise("HAM").alias("guess"),
    )
    out = ev.binary_report(rows, "truth", "guess")
    return out.withColumns({c: F.round(c, 6) for c in out.columns[4:]})
