"""Queries for sources, sinks, labels, filters, joins and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.claims import collapse
from ..functions.text import good_span, preview
from ..operators import intervals as iv
from ..operators import labels as lb
from ..operators import spans as sp
from ..session import scratch_dir, stage
from ..sources import annotations as an
from ..sources import sinks, tabular
from ..sources.layout import SplitLayout
from . import views as v
from .registry import ORACLES, query
from .views import _WS, sql_collapse

_TRIM = rf"'^{_WS}+|{_WS}+$', '', 'g'"


# ---------------------------------------------------------------- sources


@query(
    "scan_annotations",
    """
    SELECT message_id AS id, text, label, split,
           CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 50 = 1 THEN 0 ELSE 1 END AS n_annotations,
           CASE WHEN doc_id % 50 > 2 THEN (SELECT count(*) FROM f_results r WHERE r.doc_id = m.doc_id) END AS n_results
    FROM f_meta m
    """,
)
def scan_annotations(spark, sf_dir):
    path = scratch_dir(spark, "annotations")
    an.write_annotations(v.annotations(spark, sf_dir), path)
    return _annotation_facts(an.read_annotations(spark, path))


def _annotation_facts(docs):
    return docs.select(
        "id",
        F.col("data.text").alias("text"),
        F.col("meta.label").alias("label"),
        F.col("meta.split").alias("split"),
        F.size("annotations").alias("n_annotations"),
        F.size(an.first_result(docs)).alias("n_results"),
    )


@query("scan_annotation_array", ORACLES["scan_annotations"])
def scan_annotation_array(spark, sf_dir):
    """The same documents from files that hold JSON arrays, read in ranges."""
    path = scratch_dir(spark, "annotation_arrays")
    docs = v.annotations(spark, sf_dir)
    groups = max(2, v.messages(spark, sf_dir).count() // 2000)
    row = F.to_json(F.struct(*docs.columns))
    arrays = docs.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("file"), row.alias("o")).groupBy("file")
    arrays.agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("o")), F.lit("]")).alias("value")).select("value").write.text(path)
    return _annotation_facts(an.read_annotations(spark, path, one_array=True))


@query("flatten_messages", "SELECT message_id, text, label, split FROM f_meta")
def flatten_messages(spark, sf_dir):
    return an.flatten_messages(v.annotations(spark, sf_dir, pinned=False))


_SPANS = """
    SELECT message_id, message_label, claim_id, claim_type, text, s AS "start", e AS "end", NULL::DOUBLE AS confidence FROM f_spans
"""


@query("explode_spans", _SPANS)
def explode_spans(spark, sf_dir):
    return an.explode_spans(v.annotations(spark, sf_dir))


@query(
    "scan_raw_csv",
    rf"""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, regexp_replace(text, {_TRIM}) AS text, label FROM f_messages)
    SELECT printf('msg_%06d', i) AS message_id, text, label FROM r WHERE label IS NOT NULL AND text <> ''
    """,
)
def scan_raw_csv(spark, sf_dir):
    path = scratch_dir(spark, "raw_csv")
    rows = v.messages(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.select(F.col("text").alias("Message"), F.upper("label").alias("type")).write.options(
        **tabular.CSV_OPTIONS
    ).csv(path)
    return tabular.read_raw_csv(spark, path)


@query(
    "scan_csv_text_col",
    rf"""SELECT CASE WHEN contains(text, 'é') THEN text ELSE text || chr(65533) END AS text
    FROM documents WHERE regexp_replace(text, {_TRIM}) <> ''""",
)
def scan_csv_text_col(spark, sf_dir):
    """Files of two encodings in one folder; those in UTF-8 also hold a literal U+FFFD."""
    path = scratch_dir(spark, "ood_csv")
    rows = v.documents(spark, sf_dir, "text", "lang").select("lang", F.col("text").alias("MainText"))
    western = F.contains("MainText", F.lit("é"))
    marked = F.when(~western, F.concat("MainText", F.lit("\ufffd"))).otherwise(F.col("MainText"))
    options = tabular.CSV_OPTIONS
    rows.withColumn("MainText", marked).where(~western).write.options(**options).csv(path)
    rows.where(western).write.options(**options, encoding="ISO-8859-1").mode("append").csv(path)
    return tabular.read_text_csv(spark, path)


@query(
    "scan_lines",
    rf"""
    SELECT text, count(*) AS n FROM (
      SELECT regexp_replace(unnest(string_split(text, chr(10))), {_TRIM}) AS text FROM documents)
    WHERE text <> '' GROUP BY 1
    """,
)
def scan_lines(spark, sf_dir):
    path = scratch_dir(spark, "lines")
    v.documents(spark, sf_dir, "text").select("text").write.text(path)
    return tabular.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query(
    "scan_parsed_claims",
    """
    SELECT message_id, message_label, claim_id, claim_type, canonical_form,
           (SELECT count(*) FROM f_slots_g s WHERE s.message_id = g.message_id AND s.claim_id = g.claim_id) AS n_slots
    FROM f_pclaims_g g
    """,
)
def scan_parsed_claims(spark, sf_dir):
    path = scratch_dir(spark, "parsed")
    rows = v.parsed_gold(spark, sf_dir).drop("doc_id", "wl")
    bare = F.when(F.size("slots") > 0, F.col("slots"))
    rows.withColumns({"slots": bare, "needs_review": F.lit(True)}).write.option(
        "ignoreNullFields", False
    ).json(path)
    return an.read_parsed_claims(spark, path).select(
        "message_id",
        "message_label",
        "claim_id",
        "claim_type",
        "canonical_form",
        F.size("slots").alias("n_slots"),
    )


# ---------------------------------------------------------------- sinks


@query(
    "sink_parsed_claims",
    "SELECT claim_type, TRUE AS needs_review, count(*) AS n FROM f_pclaims_g GROUP BY 1",
)
def sink_parsed_claims(spark, sf_dir):
    path = scratch_dir(spark, "sink_parsed")
    sinks.sink_parsed_claims(v.parsed_gold(spark, sf_dir).drop("doc_id", "wl"), path, "needs_review")
    back = spark.read.schema(an.PARSED_SCHEMA + ", needs_review boolean").json(path)
    return back.groupBy("claim_type", "needs_review").agg(F.count("*").alias("n"))


@query(
    "sink_flat_csv",
    """
    SELECT text, CASE WHEN label = 'ham' THEN 'ham' ELSE 'phishing' END AS label, is_augmented, source,
           CASE WHEN is_augmented THEN coalesce(augmentation_type, 'N/A') ELSE 'original' END AS augmentation_type FROM f_meta
    """,
)
def sink_flat_csv(spark, sf_dir):
    path = scratch_dir(spark, "flat_csv")
    sinks.sink_flat_csv(v.annotations(spark, sf_dir, pinned=False), path)
    return (
        spark.read.schema(
            "text string, label string, is_augmented boolean, source string, augmentation_type string"
        )
        .options(**tabular.CSV_OPTIONS)
        .option("multiLine", True)
        .csv(path)
    )


@query(
    "sink_batch_jsonl",
    """
    SELECT 'request-' || message_id AS custom_id, 'gpt-4o-mini' AS model, 2 AS n_turns, 2000 AS max_tokens,
           label AS message_label, CAST(count(*) AS BIGINT) AS n_claims, prompt
    FROM f_gold JOIN f_prompts USING (message_id) GROUP BY ALL
    """,
)
def sink_batch_jsonl(spark, sf_dir):
    path = scratch_dir(spark, "batch")
    sinks.sink_batch_jsonl(v.gold_rows(spark, sf_dir), path)
    body = F.try_parse_json("value")

    def at(p, kind):
        return F.variant_get(body, p, kind)

    requests = spark.read.text(f"{path}/requests").select(
        at("$.custom_id", "string").alias("custom_id"),
        at("$.body.model", "string").alias("model"),
        F.size(at("$.body.messages", "array<variant>")).alias("n_turns"),
        at("$.body.max_tokens", "int").alias("max_tokens"),
        at("$.body.messages[1].content", "string").alias("prompt"),
    )
    meta = spark.read.parquet(f"{path}/metadata").select(
        "custom_id", "message_label", F.size("spans").alias("n_claims")
    )
    return requests.join(meta, "custom_id")


@query(
    "sink_split_manifest",
    """
    SELECT split, count(*) AS total, count(*) FILTER (label = 'ham') AS ham, count(*) FILTER (label IS DISTINCT FROM 'ham') AS smish,
           CAST(sum((SELECT count(*) FROM f_gold g WHERE g.doc_id = m.doc_id)) AS BIGINT) AS claims FROM f_meta m GROUP BY 1
    """,
)
def sink_split_manifest(spark, sf_dir):
    path = scratch_dir(spark, "manifest")
    docs = v.annotations(spark, sf_dir, pinned=False)
    sinks.sink_split_manifest(an.flatten_messages(docs), v.gold(spark, sf_dir), path)
    return spark.read.schema("split string, total long, ham long, smish long, claims long").json(
        f"{path}/stats"
    )


# ---------------------------------------------------------------- labels and filters


_RAW_LABEL = "CASE WHEN l.toxic = 1 THEN 'phishing' WHEN l.quality = 1 THEN 'ham' WHEN l.quality = 0 THEN 'spam' ELSE 'unknown' END"


def raw_labelled(spark, sf_dir):
    """Messages with the label set of the raw source."""
    toxic, quality = F.col("toxic"), F.col("quality")
    label = (
        F.when(toxic == 1, "phishing")
        .when(quality == 1, "ham")
        .when(quality == 0, "spam")
        .otherwise("unknown")
    )
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(v.table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("message_id"), "doc_id", "text", label.alias("label")
    )


@query(
    "label_normalize",
    f"""
    SELECT message_id, CASE label WHEN 'phishing' THEN 'smishing' ELSE label END AS label FROM (
      SELECT CAST(d.doc_id AS VARCHAR) AS message_id, {_RAW_LABEL} AS label FROM documents d LEFT JOIN labels l USING (doc_id))
    WHERE label <> 'unknown'
    """,
)
def label_normalize(spark, sf_dir):
    return lb.label_normalize(raw_labelled(spark, sf_dir)).select("message_id", "label")


@query(
    "label_default_smish",
    "SELECT message_id, coalesce(label, 'smish') AS label, CASE WHEN label = 'ham' THEN 'ham' ELSE 'smish' END AS stratum FROM f_messages",
)
def label_default_smish(spark, sf_dir):
    return lb.label_default_smish(v.messages(spark, sf_dir)).select("message_id", "label", "stratum")


@query(
    "label_from_claims",
    """
    SELECT message_id, CASE WHEN label = 'ham' OR NOT EXISTS (SELECT 1 FROM f_results r WHERE r.doc_id = m.doc_id)
           THEN 'HAM' ELSE 'SMISH' END AS class FROM f_meta m
    """,
)
def label_from_claims(spark, sf_dir):
    return lb.label_from_claims(v.annotations(spark, sf_dir))


@query(
    "collapse_rare_types",
    f"SELECT message_id, claim_id, {sql_collapse('claim_type')} AS claim_type FROM f_gold",
)
def collapse_rare_types(spark, sf_dir):
    return v.gold(spark, sf_dir).select(
        "message_id", "claim_id", collapse(F.col("claim_type")).alias("claim_type")
    )


@query("filter_by_split", "SELECT message_id, label FROM f_meta WHERE split = 'test'")
def filter_by_split(spark, sf_dir):
    docs = an.flatten_messages(v.annotations(spark, sf_dir, pinned=False))
    return lb.filter_by_split(docs, "test").select("message_id", "label")


@query("filter_by_split_pruned", "SELECT message_id, label FROM f_meta WHERE split = 'test'")
def filter_by_split_pruned(spark, sf_dir):
    """Metadata laid out by split and id range; the read opens one split's files."""
    docs = an.flatten_messages(v.annotations(spark, sf_dir, pinned=False)).select("message_id", "label", "split")
    laid = SplitLayout.write(docs, scratch_dir(spark, "layout"))
    return laid.split("test").select("message_id", "label")


@query(
    "semi_by_ids_pruned",
    "SELECT message_id, label, split FROM f_meta WHERE message_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)",
)
def semi_by_ids_pruned(spark, sf_dir):
    """The same layout read by ids; ranges without one of them are skipped."""
    docs = an.flatten_messages(v.annotations(spark, sf_dir, pinned=False)).select("message_id", "label", "split")
    laid = SplitLayout.write(docs, scratch_dir(spark, "layout"))
    ids = v.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("message_id"))
    return laid.by_ids(ids).select("message_id", "label", "split")


@query("lookup_message", "SELECT message_id, text FROM f_messages WHERE message_id = '7'")
def lookup_message(spark, sf_dir):
    return lb.lookup_message(v.messages(spark, sf_dir), "7")


@query(
    "lookup_spans",
    """SELECT message_id, claim_id, claim_type, s AS "start", e AS "end", text FROM f_gold
    WHERE message_id = (SELECT max(message_id) FROM f_gold)""",
)
def lookup_spans(spark, sf_dir):
    """The spans of the last message id that has any."""
    spans = v.gold(spark, sf_dir).select("message_id", "claim_id", "claim_type", "start", "end", "text")
    return lb.lookup_spans(spans, spans.agg(F.max("message_id")).first()[0])


@query(
    "messages_with_claims",
    "SELECT message_id, label FROM f_messages m WHERE EXISTS (SELECT 1 FROM f_gold g WHERE g.doc_id = m.doc_id)",
)
def messages_with_claims(spark, sf_dir):
    m = v.messages(spark, sf_dir).select("message_id", "label")
    return lb.messages_with_claims(m, v.gold(spark, sf_dir))


_QUEUE = """
    SELECT message_id, claim_id, claim_type, f.text AS claim_text, CASE WHEN s_null THEN NULL ELSE s END AS "start", e AS "end", m.text AS message
    FROM f_results f JOIN f_messages m USING (message_id) WHERE NOT v_null AND NOT l_empty AND claim_type IN ({})
"""


@query("identity_review_queue", _QUEUE.format("'IDENTITY_CLAIM'"))
def identity_review_queue(spark, sf_dir):
    return lb.identity_review_queue(v.annotations(spark, sf_dir))


@query("common_review_queue", _QUEUE.format("'URGENCY_CLAIM', 'ACTION_CLAIM', 'REWARD_CLAIM'"))
def common_review_queue(spark, sf_dir):
    return lb.common_review_queue(v.annotations(spark, sf_dir))


@query(
    "span_quality_filter",
    rf"""
    SELECT message_id, s AS "start", e AS "end", claim_type FROM (SELECT *, regexp_replace(text, {_TRIM}) AS t FROM f_pred)
    WHERE confidence >= 0.5 AND length(t) >= 3 AND regexp_matches(t, '[\p{{L}}\p{{N}}]')
      AND lower(t) NOT IN ('to', 'a', 'an', 'the', 'of', 'in', 'on', 'at', 'by', 'for', 'with', 'from')
    """,
)
def span_quality_filter(spark, sf_dir):
    spans = v.results(spark, sf_dir).select("message_id", F.explode("pred").alias("s"))
    return spans.where(good_span(F.col("s.text"), F.col("s.confidence"))).select(
        "message_id", "s.start", "s.end", "s.claim_type"
    )


@query(
    "message_features",
    """
    SELECT m.message_id, length(m.text) AS n_chars, (SELECT count(*) FROM f_words w WHERE w.doc_id = m.doc_id) AS n_words,
           (SELECT count(*) FROM f_gold g WHERE g.doc_id = m.doc_id) AS n_entities,
           (SELECT count(DISTINCT claim_type) FROM f_gold g WHERE g.doc_id = m.doc_id) AS n_types FROM f_messages m
    """,
)
def message_features(spark, sf_dir):
    return lb.message_features(v.gold_rows(spark, sf_dir))


@query(
    "length_bucket",
    """
    WITH b AS (SELECT CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) <= 160 THEN 'normal' ELSE 'long' END AS bucket, count(*) AS n
               FROM documents GROUP BY 1)
    SELECT bucket, n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM b), 6) AS pct FROM b
    """,
)
def length_bucket(spark, sf_dir):
    out = lb.length_bucket(v.table(spark, sf_dir, "documents"))
    return out.withColumn("pct", F.round("pct", 6))


@query(
    "preview_truncate",
    "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS preview FROM documents",
)
def preview_truncate(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text"), 80).alias("preview"))


@query(
    "class_distribution",
    """
    WITH c AS (
      SELECT split, CASE WHEN grouping(k) = 1 THEN '_total' ELSE k END AS label, count(*) AS n
      FROM (SELECT split, CASE WHEN label = 'ham' THEN 'ham' ELSE 'smish' END AS k FROM f_meta) GROUP BY GROUPING SETS ((split, k), (split)))
    SELECT c.split, c.label, c.n, round(c.n * 100.0::DOUBLE / t.n, 6) AS pct FROM c JOIN c t ON t.split = c.split AND t.label = '_total'
    """,
)
def class_distribution(spark, sf_dir):
    out = lb.class_distribution(an.flatten_messages(v.annotations(spark, sf_dir, pinned=False)))
    return out.withColumn("pct", F.round("pct", 6))


# ---------------------------------------------------------------- joins


@query(
    "semi_by_ids",
    "SELECT message_id, claim_id, claim_type FROM f_gold WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def semi_by_ids(spark, sf_dir):
    ids = v.table(spark, sf_dir, "labels").where("quality = 1")
    ids = ids.select(F.col("doc_id").cast("string").alias("message_id"))
    return sp.semi_by_ids(v.gold(spark, sf_dir), ids).select("message_id", "claim_id", "claim_type")


@query(
    "anti_selected",
    "SELECT message_id, label FROM f_messages WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def anti_selected(spark, sf_dir):
    ids = v.table(spark, sf_dir, "labels").where("quality = 1")
    ids = ids.select(F.col("doc_id").cast("string").alias("message_id"))
    m = v.messages(spark, sf_dir).select("message_id", "label")
    return sp.anti_selected(m, ids)


@query(
    "group_spans_by_message",
    """
    SELECT m.message_id, count(g.claim_id) AS n_spans,
           coalesce(string_agg(g.claim_id || ':' || g.claim_type || ':' || g.s || '-' || g.e, ' ' ORDER BY g.claim_id), '') AS listing
    FROM f_messages m LEFT JOIN f_spans g ON g.doc_id = m.doc_id GROUP BY 1
    """,
)
def group_spans_by_message(spark, sf_dir):
    spans = an.explode_spans(v.annotations(spark, sf_dir))
    out = sp.group_spans_by_message(v.messages(spark, sf_dir).select("message_id"), spans)
    line = F.transform(
        "spans",
        lambda s: F.format_string("%d:%s:%d-%d", s["claim_id"], s["claim_type"], s["start"], s["end"]),
    )
    return out.select(
        "message_id", F.size("spans").alias("n_spans"), F.array_join(line, " ").alias("listing")
    )


@query(
    "span_overlap_pairs",
    """
    WITH cut AS (
      SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
                THEN 1 ELSE 0 END AS opens FROM f_raw),
    isl AS MATERIALIZED (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, claim_id ROWS UNBOUNDED PRECEDING) AS island FROM cut)
    SELECT a.message_id, a.claim_id AS claim_a, b.claim_id AS claim_b FROM isl a JOIN isl b
    ON a.doc_id = b.doc_id AND a.island = b.island AND a.claim_id < b.claim_id AND a.s < b.e AND b.s < a.e
    """,
)
def span_overlap_pairs(spark, sf_dir):
    return sp.span_overlap_pairs(v.raw_rows(spark, sf_dir))


@query("span_overlap_flat", ORACLES["span_overlap_pairs"])
def span_overlap_flat(spark, sf_dir):
    """The same pairs of one row per span, joined by position bins."""
    flat = v.explode_span_rows(v.raw_rows(spark, sf_dir))
    # three passes follow over the spans, which are derived once
    return iv.span_pairs(stage(flat.select("message_id", "claim_id", "start", "end"), "raw_spans"))


@query(
    "word_span_overlap",
    """
    SELECT w.message_id, w.idx AS word_idx, min(g.claim_id) AS claim_id, arg_min(g.claim_type, g.claim_id) AS claim_type
    FROM f_words w JOIN f_gold g ON g.doc_id = w.doc_id AND w.ws < g.e AND g.s < w.we GROUP BY 1, 2
    """,
)
def word_span_overlap(spark, sf_dir):
    return sp.word_span_overlap(v.gold_rows(spark, sf_dir))


_RESOLVE = """
    WITH RECURSIVE cut AS (
      SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
                THEN 1 ELSE 0 END AS opens FROM f_raw),
    isl AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, claim_id ROWS UNBOUNDED PRECEDING) AS island FROM cut),
    packed AS (
      SELECT doc_id, island, list({'s': s, 'e': e, 'n': length(text), 'ord': claim_id} ORDER BY s, -length(text), claim_id) AS todo FROM isl GROUP BY 1, 2),
    fold AS (
      SELECT doc_id, island, 0 AS i, todo, todo[1:0] AS kept FROM packed
      UNION ALL
      SELECT doc_id, island, i + 1, todo,
             CASE WHEN hit IS NULL THEN list_append(kept, x)
                  WHEN x.n > hit.n THEN list_append(list_filter(kept, lambda k: k.ord <> hit.ord), x) ELSE kept END
      FROM (SELECT *, list_filter(kept, lambda k: NOT (x.e <= k.s OR x.s >= k.e))[1] AS hit
            FROM (SELECT *, todo[i + 1] AS x FROM fold WHERE i < len(todo)))),
    done AS (SELECT doc_id, unnest(kept) AS k FROM fold WHERE i = len(todo))
    SELECT f.message_id, f.claim_id AS kept_id, f.s AS "start", f.e AS "end", f.claim_type
    FROM done JOIN f_raw f ON f.doc_id = done.doc_id AND f.claim_id = done.k.ord
"""


@query("resolve_overlaps", _RESOLVE)
def resolve_overlaps(spark, sf_dir):
    rows = v.raw_rows(spark, sf_dir)
    numbered = rows.withColumn(
        "spans",
        F.transform(
            "spans",
            lambda s, i: F.struct(
                s["start"], s["end"], s["text"], s["claim_type"], i.alias("kept_id")
            ),
        ),
    )
    done = sp.resolve_rows(numbered).select("message_id", F.explode("spans").alias("s"))
    return done.select("message_id", "s.kept_id", "s.start", "s.end", "s.claim_type")


@query(
    "apply_review",
    """
    WITH k AS (
      SELECT g.message_id, g.doc_id, g.claim_id, coalesce(r.new_type, g.claim_type) AS claim_type, coalesce(r.new_text, g.text) AS text, g.s AS "start",
             CASE WHEN r.new_text IS NOT NULL THEN g.s + length(r.new_text) ELSE g.e END AS "end"
      FROM f_gold g LEFT JOIN f_reviews r ON r.doc_id = g.doc_id AND r.claim_id = g.claim_id WHERE r.action IS DISTINCT FROM 'reject')
    SELECT * EXCLUDE (doc_id), count(*) OVER (PARTITION BY doc_id) AS result_count FROM k
    """,
)
def apply_review(spark, sf_dir):
    return sp.apply_review(v.gold(spark, sf_dir), v.review_decisions(spark, sf_dir))


@query(
    "apply_identity_review",
    """
    WITH k AS (
      SELECT g.message_id, g.doc_id, g.claim_id, coalesce(r.new_type, g.claim_type) AS claim_type, coalesce(r.new_text, g.text) AS text, g.s AS "start", g.e AS "end"
      FROM f_gold g LEFT JOIN f_reviews r ON r.doc_id = g.doc_id AND r.claim_id = g.claim_id
      WHERE g.claim_type = 'IDENTITY_CLAIM' AND r.action IS DISTINCT FROM 'reject')
    SELECT * EXCLUDE (doc_id), count(*) OVER (PARTITION BY doc_id) AS result_count FROM k
    """,
)
def apply_identity_review(spark, sf_dir):
    """Identity claims only; edits keep the bounds."""
    spans = v.gold(spark, sf_dir).where(F.col("claim_type") == "IDENTITY_CLAIM")
    return sp.apply_review(spans, v.review_decisions(spark, sf_dir), move_end=False)


@query(
    "review_summary",
    """
    SELECT count(*) FILTER (action = 'reject') AS removed, count(*) FILTER (action <> 'reject' AND new_text IS NOT NULL) AS edited,
           count(*) FILTER (action <> 'reject' AND new_type IS NOT NULL) AS type_changed FROM f_reviews
    """,
)
def review_summary(spark, sf_dir):
    return sp.review_summary(v.gold(spark, sf_dir), v.review_decisions(spark, sf_dir))


@query(
    "schema_dimension_join",
    """
    SELECT g.message_id, g.claim_id, g.claim_type, d.pos, d.slot, d.value_type
    FROM f_gold g JOIN d_slots d ON d.claim_type = CASE WHEN g.wl > 12 THEN 'OTHER_CLAIM' ELSE g.claim_type END
    """
    .replace("g.claim_type, d.pos", "CASE WHEN g.wl > 12 THEN 'LONG_WORD_CLAIM' ELSE g.claim_type END AS claim_type, d.pos"),
)
def schema_dimension_join(spark, sf_dir):
    kind = F.when(F.col("wl") > 12, "LONG_WORD_CLAIM").otherwise(F.col("claim_type"))
    spans = v.gold(spark, sf_dir).select("message_id", "claim_id", kind.alias("claim_type"))
    return sp.schema_dimension_join(spans)


@query(
    "unknown_slots",
    """
    WITH s AS (
      SELECT g.message_id, g.claim_id, CASE WHEN g.wl > 12 THEN 'LONG_WORD_CLAIM' ELSE g.claim_type END AS claim_type,
             list(s.slot ORDER BY s.slot) FILTER (s.slot IS NOT NULL AND g.wl > 12 AND s.slot NOT IN ('claim_description', 'context')) AS bad
      FROM f_pclaims_g g LEFT JOIN f_slots_g s ON s.message_id = g.message_id AND s.claim_id = g.claim_id GROUP BY ALL)
    SELECT message_id, claim_id, claim_type, bad IS NULL AS valid, coalesce(array_to_string(bad, ','), '') AS unknown FROM s
    """,
)
def unknown_slots(spark, sf_dir):
    kind = F.when(F.col("wl") > 12, "LONG_WORD_CLAIM").otherwise(F.col("claim_type"))
    out = sp.unknown_slots(v.parsed_gold(spark, sf_dir).withColumn("claim_type", kind))
    return out.withColumn("unknown", F.array_join("unknown", ","))


