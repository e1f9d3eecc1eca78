"""Queries of the quality, integrity, augmentation and exploration reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import pin
from ..functions.text import PUNCTUATION, SPACE
from ..operators import evaluate as ev
from ..operators import quality as q
from . import views as v
from .registry import query
from .views import _WS

_TRIM = rf"'^{_WS}+|{_WS}+$', '', 'g'"
FINGERPRINT = (
    rf"md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '{PUNCTUATION}', '', 'g'), '{SPACE}+', ' ', 'g'), {_TRIM}))"
)


def _rows(spark, sf_dir):
    return q.claim_rows(v.annotations(spark, sf_dir))


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "claim_type_stats",
    """
    SELECT claim_type, count(*) AS n, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f_spans), 6) AS pct, count(*) < 50 AS rare,
           min(length(text)) < 3 OR max(length(text)) > 100 AS length_warning FROM f_spans GROUP BY 1
    """,
)
def claim_type_stats(spark, sf_dir):
    return _round(q.claim_type_stats(_rows(spark, sf_dir)), "avg_length", "pct")


@query(
    "claims_per_message_hist",
    """
    WITH n AS (SELECT m.doc_id, (SELECT count(*) FROM f_spans s WHERE s.doc_id = m.doc_id) AS n_claims FROM f_messages m WHERE doc_id % 50 > 1)
    SELECT n_claims, count(*) AS n_messages, CASE WHEN n_claims = 0 THEN 'HAM' ELSE 'SMISH' END AS kind FROM n GROUP BY 1
    """,
)
def claims_per_message_hist(spark, sf_dir):
    return q.claims_per_message_hist(_rows(spark, sf_dir))


_BAD = """(SELECT count(*) FROM f_spans s JOIN f_messages m ON m.doc_id = s.doc_id
           WHERE substring(m.text, CAST(s.s + 1 AS BIGINT), CAST(greatest(s.e - s.s, 0) AS BIGINT)) <> s.text)"""


@query(
    "boundary_mismatch",
    f"SELECT {_BAD} AS boundary_mismatches, (SELECT count(*) FROM f_spans) AS total_spans",
)
def boundary_mismatch(spark, sf_dir):
    return q.boundary_mismatch(_rows(spark, sf_dir))


@query(
    "dataset_quality_verdict",
    f"""
    WITH n AS (SELECT m.doc_id, (SELECT count(*) FROM f_spans s WHERE s.doc_id = m.doc_id) AS k FROM f_messages m),
    cut AS (
      SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
                THEN 1 ELSE 0 END AS opens FROM f_spans),
    isl AS MATERIALIZED (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, claim_id ROWS UNBOUNDED PRECEDING) AS island FROM cut),
    t AS (
      SELECT count(*) AS total_messages, count(*) FILTER (doc_id % 50 > 1 AND k = 0) AS ham_messages, count(*) FILTER (k > 0) AS smish_messages,
             (SELECT count(*) FROM isl a JOIN isl b ON a.doc_id = b.doc_id AND a.island = b.island AND a.claim_id < b.claim_id AND a.s < b.e AND b.s < a.e) AS span_overlaps,
             {_BAD} AS boundary_mismatches,
             (SELECT count(*) FROM (SELECT claim_type FROM f_spans GROUP BY 1 HAVING count(*) < 50)) AS rare_types FROM n),
    i AS (SELECT *, concat_ws(',', CASE WHEN ham_messages < total_messages * 0.3 THEN 'low_ham' END, CASE WHEN span_overlaps > 0 THEN 'overlaps' END,
                 CASE WHEN boundary_mismatches > 0 THEN 'boundary_mismatches' END, CASE WHEN rare_types > 0 THEN 'rare_types' END) AS issues FROM t)
    SELECT *, CASE WHEN issues = '' THEN 'GOOD' ELSE 'ISSUES' END AS verdict FROM i
    """,
)
def dataset_quality_verdict(spark, sf_dir):
    return q.dataset_quality_verdict(_rows(spark, sf_dir))


# ---------------------------------------------------------------- integrity


def _twice(spark, sf_dir):
    """Annotation documents in which some ids occur twice."""
    docs = v.annotations(spark, sf_dir, pinned=False)
    again = F.when(F.length("data.text") < 60, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return docs.withColumn("copy", F.explode(again)).drop("copy")


@query(
    "dup_ids_texts",
    rf"""
    WITH d AS (SELECT message_id AS id, regexp_replace(text, {_TRIM}) AS t FROM f_messages, range(1, 3) r(copy) WHERE copy = 1 OR length(text) < 60)
    SELECT 'id' AS kind, id AS value, count(*) AS n FROM d GROUP BY 2 HAVING count(*) > 1 AND value <> ''
    UNION ALL SELECT 'text', t, count(*) FROM d GROUP BY 2 HAVING count(*) > 1 AND t <> ''
    """,
)
def dup_ids_texts(spark, sf_dir):
    return q.dup_ids_texts(_twice(spark, sf_dir))


@query(
    "dup_totals",
    rf"""
    WITH d AS (SELECT message_id AS id, regexp_replace(text, {_TRIM}) AS t FROM f_messages, range(1, 3) r(copy) WHERE copy = 1 OR length(text) < 60)
    SELECT count(*) AS total_entries, count(DISTINCT id) AS unique_ids, count(DISTINCT t) AS unique_texts FROM d
    """,
)
def dup_totals(spark, sf_dir):
    return q.dup_totals(_twice(spark, sf_dir))


@query(
    "near_dup_hash",
    f"""
    WITH h AS (SELECT doc_id AS id, {FINGERPRINT} AS hash FROM documents),
    g AS (SELECT hash, min(id) AS first_id, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1)
    SELECT id, first_id, hash, copies FROM h JOIN g USING (hash) WHERE id > first_id
    """,
)
def near_dup_hash(spark, sf_dir):
    return q.near_dup_hash(v.documents(spark, sf_dir, "text"), "doc_id")


@query(
    "structure_issues",
    """
    SELECT message_id, 'missing annotations field' AS issue FROM f_messages WHERE doc_id % 50 = 0
    UNION ALL SELECT message_id, 'missing result field' FROM f_messages WHERE doc_id % 50 = 2
    UNION ALL SELECT message_id, 'result 0 missing value field' FROM f_results WHERE v_null
    UNION ALL SELECT message_id, 'result 0 missing start/end' FROM f_results WHERE s_null
    """,
)
def structure_issues(spark, sf_dir):
    return q.structure_issues(v.annotations(spark, sf_dir))


def _original(spark, sf_dir):
    """The source dataset: very short messages are absent, those with a mail
    address read differently."""
    m = v.messages(spark, sf_dir).where(F.length("text") >= 60)
    text = F.when(F.contains("text", F.lit("@")), F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return m.select(F.col("message_id").alias("id"), text.alias("text"))


_ORIGINAL = """
    o AS (SELECT message_id, CASE WHEN contains(text, '@') THEN text || '?' ELSE text END AS text FROM f_messages WHERE length(text) >= 60)
"""
_LOST = rf"""
    lost AS (
      SELECT m.message_id, CASE WHEN is_augmented THEN 'original text mismatch' ELSE 'message text altered' END AS issue,
             regexp_replace(o.text, {_TRIM}) AS expected,
             CASE WHEN is_augmented THEN regexp_replace(original_text, {_TRIM}) ELSE regexp_replace(m.text, {_TRIM}) END AS got
      FROM f_meta m JOIN o USING (message_id)
      WHERE CASE WHEN is_augmented THEN regexp_replace(original_text, {_TRIM}) ELSE regexp_replace(m.text, {_TRIM}) END <> regexp_replace(o.text, {_TRIM}))
"""


@query("integrity_vs_original", f"WITH {_ORIGINAL}, {_LOST} SELECT * FROM lost")
def integrity_vs_original(spark, sf_dir):
    return q.integrity_vs_original(v.annotations(spark, sf_dir, pinned=False), _original(spark, sf_dir))


@query(
    "cross_check",
    rf"""
    WITH {_ORIGINAL}
    SELECT count(*) FILTER (a.message_id IS NOT NULL AND o.message_id IS NOT NULL) AS common, count(*) FILTER (o.message_id IS NULL) AS left_only,
           count(*) FILTER (a.message_id IS NULL) AS right_only,
           count(*) FILTER (regexp_replace(a.text, {_TRIM}) <> regexp_replace(o.text, {_TRIM})) AS mismatches
    FROM f_messages a FULL JOIN o ON a.message_id = o.message_id
    """,
)
def cross_check(spark, sf_dir):
    m = v.messages(spark, sf_dir).select(F.col("message_id").alias("id"), "text")
    return q.cross_check(m, _original(spark, sf_dir))


@query(
    "cross_check_mismatches",
    rf"""
    WITH {_ORIGINAL}
    SELECT a.message_id AS id, regexp_replace(a.text, {_TRIM}) AS left_text, regexp_replace(o.text, {_TRIM}) AS right_text
    FROM f_messages a JOIN o ON a.message_id = o.message_id
    WHERE regexp_replace(a.text, {_TRIM}) <> regexp_replace(o.text, {_TRIM})
    """,
)
def cross_check_mismatches(spark, sf_dir):
    m = v.messages(spark, sf_dir).select(F.col("message_id").alias("id"), "text")
    return q.cross_mismatches(m, _original(spark, sf_dir))


@query(
    "integrity_summary",
    rf"""
    WITH {_ORIGINAL}, {_LOST},
    dup AS (SELECT regexp_replace(text, {_TRIM}) AS t FROM f_messages GROUP BY 1 HAVING count(*) > 1 AND t <> ''),
    c AS (
      SELECT 'claim_duplicates' AS "check", EXISTS (SELECT 1 FROM dup) AS failed
      UNION ALL SELECT 'entity_duplicates', EXISTS (SELECT 1 FROM (SELECT text FROM o GROUP BY 1 HAVING count(*) > 1 AND text <> ''))
      UNION ALL SELECT 'claim_structure', EXISTS (SELECT 1 FROM f_results WHERE v_null OR s_null) OR EXISTS (SELECT 1 FROM f_messages WHERE doc_id % 50 IN (0, 2))
      UNION ALL SELECT 'entity_structure', FALSE
      UNION ALL SELECT 'integrity', EXISTS (SELECT 1 FROM lost)
      UNION ALL SELECT 'cross_check', EXISTS (SELECT 1 FROM f_messages m JOIN o USING (message_id) WHERE m.text <> o.text))
    SELECT *, (SELECT count(*) FROM c WHERE failed) AS total_issues FROM c
    """,
)
def integrity_summary(spark, sf_dir):
    from ..sources.annotations import task_document

    original = _original(spark, sf_dir)
    entity_docs = task_document(original, "id", "entities")
    return q.integrity_summary(v.annotations(spark, sf_dir), entity_docs, original)


# ---------------------------------------------------------------- augmentation


@query(
    "claim_coverage",
    """
    WITH s AS (SELECT claim_type, count(DISTINCT doc_id) AS n FROM f_gold GROUP BY 1)
    SELECT d.claim_type, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS pct,
           n IS NULL AS missing, coalesce(n < 30, FALSE) AS low FROM d_types d LEFT JOIN s USING (claim_type)
    """,
)
def claim_coverage(spark, sf_dir):
    return _round(q.claim_coverage(v.annotations(spark, sf_dir)), "pct")


def _short_docs(spark, sf_dir):
    """Documents in which two of the types are never listed."""
    docs = v.annotations(spark, sf_dir)
    kinds = F.filter("meta.claim_types", lambda t: ~t.isin("LEGAL_CLAIM", "SOCIAL_CLAIM"))
    return docs.withColumn("meta", F.col("meta").withField("claim_types", kinds))


@query(
    "expected_minus_seen",
    """SELECT claim_type FROM d_types EXCEPT SELECT claim_type FROM f_gold WHERE claim_type NOT IN ('LEGAL_CLAIM', 'SOCIAL_CLAIM')""",
)
def expected_minus_seen(spark, sf_dir):
    return q.expected_minus_seen(_short_docs(spark, sf_dir))


@query(
    "augmentation_stats",
    """
    WITH c AS (SELECT is_augmented, CASE WHEN is_augmented THEN coalesce(augmentation_type, 'unknown') ELSE 'original' END AS kind, count(*) AS n FROM f_meta GROUP BY 1, 2)
    SELECT *, CASE WHEN is_augmented THEN round(n * 100.0::DOUBLE / (SELECT sum(n) FROM c WHERE is_augmented), 6) END AS pct FROM c
    """,
)
def augmentation_stats(spark, sf_dir):
    return _round(q.augmentation_stats(v.annotations(spark, sf_dir, pinned=False)), "pct")


@query(
    "augment_verdict",
    f"""
    WITH t AS (
      SELECT count(*) AS total, count(*) FILTER (length(text) < 50) AS too_short, count(*) FILTER (length(text) > 160) AS too_long,
             count(*) - count(DISTINCT {FINGERPRINT}) AS duplicates,
             (SELECT count(*) FROM (SELECT claim_type FROM d_types EXCEPT SELECT claim_type FROM f_gold)) AS missing_types FROM f_messages)
    SELECT *, concat_ws(',', CASE WHEN duplicates > 0 THEN 'duplicates' END, CASE WHEN too_short > total * 0.05 THEN 'too_short' END,
           CASE WHEN too_long > total * 0.1 THEN 'too_long' END, CASE WHEN missing_types > 0 THEN 'missing_types' END) AS issues FROM t
    """,
)
def augment_verdict(spark, sf_dir):
    return q.augment_verdict(v.annotations(spark, sf_dir))


@query(
    "balance_metadata",
    """
    SELECT *, phishing_messages || ':' || ham_messages AS balance_ratio FROM (
      SELECT count(*) AS total_messages, count(*) FILTER (label IS DISTINCT FROM 'ham') AS phishing_messages, count(*) FILTER (label = 'ham') AS ham_messages,
             count(*) FILTER (label IS DISTINCT FROM 'ham' AND NOT is_augmented) AS original_phishing,
             count(*) FILTER (label IS DISTINCT FROM 'ham' AND is_augmented) AS augmented_phishing FROM f_meta)
    """,
)
def balance_metadata(spark, sf_dir):
    return q.balance_metadata(v.annotations(spark, sf_dir, pinned=False))


# ---------------------------------------------------------------- exploration


@query(
    "eda_summary",
    """
    WITH m AS (SELECT length(text) AS c, (SELECT count(*) FROM f_words w WHERE w.doc_id = x.doc_id) AS w,
                      (SELECT count(*) FROM f_gold g WHERE g.doc_id = x.doc_id) AS k FROM f_messages x),
    g AS (SELECT length(text) AS n, claim_type FROM f_gold)
    SELECT item, round(value, 6) AS value FROM (
      SELECT 'total_messages' AS item, count(*)::DOUBLE AS value FROM m
      UNION ALL SELECT 'total_entities', sum(k)::DOUBLE FROM m
      UNION ALL SELECT 'avg_entities_per_message', avg(k) FROM m WHERE k > 0
      UNION ALL SELECT 'avg_char_length', avg(c) FROM m UNION ALL SELECT 'min_char_length', min(c) FROM m
      UNION ALL SELECT 'max_char_length', max(c) FROM m UNION ALL SELECT 'avg_word_count', avg(w) FROM m
      UNION ALL SELECT 'median_char_length', median(c) FROM m UNION ALL SELECT 'median_word_count', median(w) FROM m
      UNION ALL SELECT 'median_entity_length', median(n) FROM g UNION ALL SELECT 'avg_entity_length', avg(n) FROM g
      UNION ALL SELECT 'min_entity_length', min(n) FROM g UNION ALL SELECT 'max_entity_length', max(n) FROM g
      UNION ALL SELECT 'entity_types', count(DISTINCT claim_type) FROM g
      UNION ALL SELECT 'n:' || claim_type, count(*) FROM g GROUP BY claim_type
      UNION ALL SELECT 'pct:' || claim_type, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM g), 2) FROM g GROUP BY claim_type)
    """,
)
def eda_summary(spark, sf_dir):
    return _round(q.eda_summary(v.gold_rows(spark, sf_dir)), "value")


@query(
    "entity_length_by_type",
    """
    SELECT claim_type, round(avg(length(text)), 6) AS avg_length, quantile_cont(length(text), 0.25) AS q1, quantile_cont(length(text), 0.5) AS median,
           quantile_cont(length(text), 0.75) AS q3 FROM f_gold GROUP BY 1
    """,
)
def entity_length_by_type(spark, sf_dir):
    return _round(q.entity_length_by_type(v.gold_rows(spark, sf_dir)), "avg_length")


@query(
    "type_cooccurrence",
    """
    WITH d AS (SELECT DISTINCT doc_id, claim_type FROM f_gold)
    SELECT a.claim_type AS type_a, b.claim_type AS type_b, count(*) AS n FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.claim_type < b.claim_type
    GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15
    """,
)
def type_cooccurrence(spark, sf_dir):
    return q.type_cooccurrence(v.gold_rows(spark, sf_dir))


@query("freq_desc", "SELECT claim_type, count(*) AS n FROM f_gold GROUP BY 1 ORDER BY n DESC, claim_type")
def freq_desc(spark, sf_dir):
    return q.freq_desc(v.gold(spark, sf_dir), "claim_type")


@query(
    "top_entities_per_type",
    """
    SELECT claim_type, text, n, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY claim_type ORDER BY n DESC, text) AS rank FROM (SELECT claim_type, text, count(*) AS n FROM f_gold GROUP BY 1, 2))
    WHERE rank <= 10
    """,
)
def top_entities_per_type(spark, sf_dir):
    return q.top_entities_per_type(v.gold_rows(spark, sf_dir))


@query(
    "topk_issues",
    rf"""
    WITH a AS (SELECT DISTINCT doc_id, message_id, regexp_replace(lower(text), {_TRIM}) AS t FROM f_gold WHERE claim_type = 'IDENTITY_CLAIM' AND label IS DISTINCT FROM 'ham'),
    b AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), {_TRIM}) AS t FROM f_pred WHERE claim_type = 'IDENTITY_CLAIM')
    SELECT a.message_id, m.text AS message, a.t AS text FROM a JOIN f_messages m USING (doc_id)
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.t = a.t) ORDER BY a.message_id, a.t LIMIT 20
    """,
)
def topk_issues(spark, sf_dir):
    words = v.with_words(v.messages(spark, sf_dir))
    rows = pin(words, "message_id", "text", "label", gt=v.gold_array(), pred=v.pred_array())
    return ev.identity_issues(ev.annotator_agreement(rows), 20)
