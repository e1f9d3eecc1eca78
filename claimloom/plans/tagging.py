"""Queries of the BIO family and of the rule-based tagger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bio as fb
from ..functions.arrays import let
from ..functions.claims import collapse
from ..functions.constants import MODEL_TYPES
from ..operators import bio
from . import views as v
from .dataset import _RESOLVE
from .registry import query
from .span_arrays import with_arrays
from .views import sql_collapse

_WORD_TAGS = """
    WITH h AS (
      SELECT w.message_id, w.doc_id, w.idx, w.word, w.ws, w.we, min(g.claim_id) AS cid FROM f_words w
      LEFT JOIN f_gold g ON g.doc_id = w.doc_id AND w.ws < g.e AND g.s < w.we GROUP BY ALL),
    t AS (
      SELECT h.*, g.claim_type, g.s, lag(g.claim_type) OVER (PARTITION BY h.doc_id ORDER BY h.idx) AS prev
      FROM h LEFT JOIN f_gold g ON g.doc_id = h.doc_id AND g.claim_id = h.cid),
    tags AS (
      SELECT message_id, idx, word, CASE WHEN claim_type IS NULL THEN 'O'
             WHEN (ws <= s AND s < we) OR prev IS DISTINCT FROM claim_type THEN 'B-' || claim_type ELSE 'I-' || claim_type END AS tag FROM t)
"""


@query("bio_encode_words", _WORD_TAGS + "SELECT message_id, idx, word, tag FROM tags")
def bio_encode_words(spark, sf_dir):
    return bio.bio_encode_words(v.gold_rows(spark, sf_dir))


@query(
    "label_distribution",
    _WORD_TAGS
    + """
    SELECT tag, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tags), 6) AS pct,
           CASE WHEN tag LIKE 'B-%' THEN tag[3:] END AS claim_type FROM tags GROUP BY 1
    """,
)
def label_distribution(spark, sf_dir):
    return bio.label_distribution(v.gold_rows(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


_RES_VIEW = (
    _RESOLVE.rsplit("SELECT f.message_id", 1)[0].rstrip()
    + f""",
    res AS (SELECT f.doc_id, f.s, f.e, {sql_collapse('f.claim_type')} AS claim_type FROM done JOIN f_raw f ON f.doc_id = done.doc_id AND f.claim_id = done.k.ord)
"""
)


@query(
    "bio_encode_chars",
    _RES_VIEW
    + """
    , c AS (SELECT w.message_id, w.idx, w.word, w.ws, max(r.s) AS s, arg_max(r.claim_type, r.s) AS claim_type
          FROM f_words w LEFT JOIN res r ON r.doc_id = w.doc_id AND r.s <= w.ws AND w.ws < greatest(r.e, r.s + 1) GROUP BY ALL)
    SELECT message_id, idx, word, CASE WHEN claim_type IS NULL THEN 'O' WHEN s = ws THEN 'B-' || claim_type ELSE 'I-' || claim_type END AS tag FROM c
    """,
)
def bio_encode_chars(spark, sf_dir):
    return bio.bio_encode_chars(v.raw_rows(spark, sf_dir))


_IDS = "[" + ", ".join(f"'{t}'" for t in MODEL_TYPES) + "]"


@query(
    "bio_align_tokens",
    _RES_VIEW
    + f"""
    , p AS (
      SELECT doc_id, message_id, 1 AS part, idx, j, ws + j * 4 AS s, least(ws + j * 4 + 4, we) AS e FROM f_words, range(0, 40) r(j) WHERE j <= (wl - 1) // 4
      UNION ALL SELECT doc_id, message_id, 0, 0, 0, 0, 0 FROM f_messages
      UNION ALL SELECT doc_id, message_id, 2, 0, 0, length(text) + 5, length(text) + 6 FROM f_messages
      UNION ALL SELECT doc_id, message_id, 3, 0, 0, 0, 0 FROM f_messages),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, idx, j) - 1 AS k FROM p),
    c AS (SELECT o.message_id, o.k, o.s, o.e, o.part, max(r.s) AS rs, arg_max(r.claim_type, r.s) AS claim_type
          FROM o LEFT JOIN res r ON o.part = 1 AND r.doc_id = o.doc_id AND r.s <= o.s AND o.s < greatest(r.e, r.s + 1) GROUP BY ALL)
    SELECT message_id, k AS idx, s AS "start", e AS "end",
           CASE WHEN part IN (0, 3) THEN -100 WHEN claim_type IS NULL THEN 0
                ELSE 2 * list_position({_IDS}, claim_type) - CASE WHEN rs = s THEN 1 ELSE 0 END END AS label_id FROM c
    """,
)
def bio_align_tokens(spark, sf_dir):
    rows = with_arrays(v.messages(spark, sf_dir), "message_id", "text", spans="raw", offsets="offsets")
    return bio.bio_align_tokens(rows)


_DECODE = """
    WITH b AS (SELECT *, count(*) FILTER (tag LIKE 'B-%') OVER w AS isl FROM f_tokens WHERE NOT (s = 0 AND e = 0)
               WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT *, count(*) FILTER (tag = 'O') OVER (PARTITION BY doc_id, isl ORDER BY idx ROWS UNBOUNDED PRECEDING) AS closed,
                 first_value(tag[3:]) OVER (PARTITION BY doc_id, isl ORDER BY idx) AS kind FROM b WHERE isl > 0),
    m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isl ORDER BY idx) AS i, count(*) OVER (PARTITION BY doc_id, isl) AS n
          FROM o WHERE closed = 0 AND tag[3:] = kind)
"""


@query(
    "bio_decode_mean",
    _DECODE
    + """SELECT message_id, isl - 1 AS claim_id, min(s) AS "start", max(e) AS "end", any_value(kind) AS claim_type, round(avg(confidence), 6) AS confidence
    FROM m GROUP BY message_id, isl""",
)
def bio_decode_mean(spark, sf_dir):
    out = bio.bio_decode(v.token_rows(spark, sf_dir), "mean")
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "bio_decode_pairwise",
    _DECODE
    + """SELECT message_id, isl - 1 AS claim_id, min(s) AS "start", max(e) AS "end", any_value(kind) AS claim_type,
         round(sum(confidence * CASE WHEN i = 1 THEN power(2, -(n - 1)) ELSE power(2, -(n - i + 1)) END), 6) AS confidence FROM m GROUP BY message_id, isl""",
)
def bio_decode_pairwise(spark, sf_dir):
    out = bio.bio_decode(v.token_rows(spark, sf_dir), "pairwise")
    return out.withColumn("confidence", F.round("confidence", 6))


_STRICT = f"""
    WITH true_tags AS (
      SELECT w.doc_id, w.idx, CASE WHEN g.s IS NULL THEN 'O' WHEN g.s = w.ws THEN 'B-' || g.claim_type ELSE 'I-' || g.claim_type END AS tag
      FROM f_words w LEFT JOIN f_gt g ON g.doc_id = w.doc_id AND g.ord = (
        SELECT max(x.ord) FROM f_gt x WHERE x.doc_id = w.doc_id AND x.s <= w.ws AND w.ws < x.e)),
    pred_tags AS (
      SELECT doc_id, idx, CASE WHEN tag = 'O' THEN 'O' ELSE tag[1:2] || ({sql_collapse('tag[3:]')}) END AS tag FROM f_tokens),
    u AS (SELECT 'g' AS side, * FROM true_tags UNION ALL SELECT 'p', * FROM pred_tags),
    l AS (SELECT *, lag(tag) OVER (PARTITION BY side, doc_id ORDER BY idx) AS prev FROM u),
    f AS (SELECT *, tag <> 'O' AND (tag LIKE 'B-%' OR prev IS NULL OR prev = 'O' OR prev[3:] <> tag[3:]) AS opens FROM l),
    c AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY side, doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS k FROM f WHERE tag <> 'O'),
    e AS (SELECT side, doc_id, min(tag[3:]) AS claim_type, min(idx) AS a, max(idx) AS b FROM c GROUP BY side, doc_id, k),
    n AS (
      SELECT claim_type, count(*) FILTER (side = 'g') AS support, count(*) FILTER (side = 'p') AS predicted,
             (SELECT count(*) FROM e g JOIN e p USING (doc_id, claim_type, a, b) WHERE g.side = 'g' AND p.side = 'p' AND g.claim_type = e.claim_type) AS tp
      FROM e GROUP BY 1),
    acc AS (SELECT avg(CASE WHEN t.tag = p.tag THEN 1.0 ELSE 0.0 END) AS token_accuracy FROM true_tags t JOIN pred_tags p USING (doc_id, idx)),
    r AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS p, coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS r FROM n),
    s AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM r),
    z AS (SELECT sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp, sum(tp)::DOUBLE / sum(predicted) AS mp, sum(tp)::DOUBLE / sum(support) AS mr,
                 avg(p) AS ap, avg(r) AS ar, avg(f1) AS af, sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr,
                 sum(f1 * support) / sum(support) AS wf FROM s)
    SELECT claim_type, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
           round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(token_accuracy, 6) AS token_accuracy
    FROM (SELECT claim_type, support, predicted, tp, p, r, f1 FROM s
          UNION ALL SELECT '_micro', support, predicted, tp, mp, mr, 2 * mp * mr / (mp + mr) FROM z
          UNION ALL SELECT '_macro', support, predicted, tp, ap, ar, af FROM z
          UNION ALL SELECT '_weighted', support, predicted, tp, wp, wr, wf FROM z), acc
"""


@query("strict_entity_prf", _STRICT)
def strict_entity_prf(spark, sf_dir):
    d = F.col("doc_id")

    def pred_tag(word, i):
        kind = collapse(v.type_at((d + F.floor(i / 4)) % 12))
        n = F.length(word)
        return (
            F.when(n >= 9, F.concat(F.lit("B-"), kind))
            .when(n.isin(2, 4, 6), F.concat(F.lit("I-"), kind))
            .otherwise("O")
        )

    gold = F.transform(
        v.gold_array(),
        lambda s: F.struct(s["start"], s["end"], collapse(s["claim_type"]).alias("claim_type")),
    )
    rows = v.with_words(v.messages(spark, sf_dir)).select(
        let(gold, lambda g: fb.tags_at(F.col("ws"), g, ascending=True)).alias("true_tags"),
        F.transform("w", pred_tag).alias("pred_tags"),
    )
    out = bio.strict_entity_prf(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "token_accuracy")})
