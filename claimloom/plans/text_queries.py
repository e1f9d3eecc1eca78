"""Queries of text functions, entities, prompts, response parsing, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions import responses as rs
from ..functions import text as tx
from ..functions.arrays import let, pin
from ..functions.constants import MONTH_MARKS, TIME_MARKS, URGENCY_KEYWORDS
from ..functions.ratios import safe_ratio as ratio_of
from ..operators import entities as en
from ..operators import ranking as rk
from ..operators import retrieval as rt
from ..operators import spans as sp
from ..session import scratch_dir
from ..sources import tabular
from . import views as v
from .prompt_sql import quoted
from .quality_checks import FINGERPRINT
from .registry import query
from .sampling_queries import _TARGET
from .views import _WS

_TRIM = rf"'^{_WS}+|{_WS}+$', '', 'g'"


# ---------------------------------------------------------------- text functions


@query("text_fingerprint", f"SELECT doc_id, {FINGERPRINT} AS fingerprint FROM documents")
def text_fingerprint(spark, sf_dir):
    return v.documents(spark, sf_dir, "text").select(
        "doc_id", tx.fingerprint(F.col("text")).alias("fingerprint")
    )


def _any(marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains(x, {quoted(m)})" for m in marks) + ")"


@query(
    "strip_device_metadata",
    rf"""
    WITH l AS (SELECT page_id, list_transform(string_split(html, chr(10)), lambda x: regexp_replace(x, {_TRIM})) AS ls FROM pages),
    k AS (SELECT page_id, array_to_string(list_filter(ls, lambda x: x <> '' AND NOT (starts_with(x, '<') OR starts_with(x, '+') OR contains(x, 'Text Message')
          OR ({_any(MONTH_MARKS)} AND {_any(TIME_MARKS)}))), ' ') AS text FROM l)
    SELECT page_id, text FROM k WHERE text <> ''
    """,
)
def strip_device_metadata(spark, sf_dir):
    pages = v.table(spark, sf_dir, "pages").select("page_id", "html")
    out = pin(pages, "page_id", text=tx.strip_device_metadata(F.col("html")))
    return out.where(F.col("text") != "")


_URGENT = "CASE " + " ".join(
    f"WHEN contains(lower(text), '{k}') THEN '{k}'" for k in URGENCY_KEYWORDS
) + " END"


@query("urgency_keyword", f"SELECT doc_id, {_URGENT} AS keyword FROM documents")
def urgency_keyword(spark, sf_dir):
    return v.documents(spark, sf_dir, "text").select(
        "doc_id", tx.urgency_keyword(F.col("text")).alias("keyword")
    )


def _source_text(spark, sf_dir):
    """Whole documents and whole pages as one message relation."""
    docs = v.documents(spark, sf_dir, "text").select(
        F.concat(F.lit("d"), "doc_id").alias("message_id"), "text"
    )
    pages = v.table(spark, sf_dir, "pages").select("page_id", "html").select(
        F.concat(F.lit("p"), "page_id").alias("message_id"), F.col("html").alias("text")
    )
    return docs.unionByName(pages)


def _entity_sql() -> str:
    parts = []
    for kind, pattern in tx.ENTITY_PATTERNS.items():
        p = quoted(pattern)
        parts.append(
            f"SELECT message_id, '{kind}' AS entity_type, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS gs FROM f_sources"
        )
    return (
        "WITH m AS (" + " UNION ALL ".join(parts) + "),"
        " x AS (SELECT message_id, entity_type, unnest(ms) AS text, unnest(gs[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM m),"
        " o AS (SELECT *, CAST(sum(length(gap) + length(text)) OVER (PARTITION BY message_id, entity_type ORDER BY i) AS BIGINT) AS e FROM x),"
        " ents AS (SELECT message_id, entity_type, e - length(text) AS s, e, text FROM o)"
    )


v.SQL["f_sources"] = (
    "SELECT 'd' || doc_id AS message_id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages"
)


@query(
    "pattern_entities",
    _entity_sql() + ' SELECT message_id, entity_type, s AS "start", e AS "end", text, 1.0::DOUBLE AS confidence FROM ents',
)
def pattern_entities(spark, sf_dir):
    return en.pattern_entities(_source_text(spark, sf_dir), "message_id")


_CLAIMS = """
    claims AS (
      SELECT message_id, CASE WHEN entity_type IN ('PHONE', 'URL') THEN 'ACTION_CLAIM' WHEN entity_type = 'AMOUNT' THEN 'FINANCIAL_CLAIM' ELSE 'ACCOUNT_CLAIM' END AS claim_type,
             text, CASE WHEN entity_type IN ('PHONE', 'URL') THEN 'Requests action via ' || lower(entity_type)
                        WHEN entity_type = 'AMOUNT' THEN 'Mentions money: ' || text ELSE 'References account: ' || text END AS evidence, 1.0::DOUBLE AS confidence
      FROM ents WHERE entity_type IN ('PHONE', 'URL', 'AMOUNT', 'ACCOUNT')
      UNION ALL
      SELECT message_id, 'URGENCY_CLAIM', k, 'Uses urgency language: ''' || k || '''', 0.8::DOUBLE FROM (SELECT message_id, {urgent} AS k FROM f_sources) WHERE k IS NOT NULL)
""".format(urgent=_URGENT)


@query("entities_to_claims", _entity_sql() + "," + _CLAIMS + " SELECT * FROM claims")
def entities_to_claims(spark, sf_dir):
    m = _source_text(spark, sf_dir)
    return en.entities_to_claims(m, en.pattern_entities(m, "message_id"), "message_id")


@query(
    "span_text",
    rf"SELECT message_id, ord, regexp_replace(text, {_TRIM}) AS text FROM f_pred",
)
def span_text(spark, sf_dir):
    rows = v.results(spark, sf_dir).select("message_id", "text", F.col("pred").alias("spans"))
    cut = F.transform(
        "spans", lambda s: tx.strip(tx.slice_text(F.col("text"), s["start"], s["end"]))
    )
    return rows.select("message_id", F.posexplode(cut).alias("ord", "text"))


@query(
    "safe_ratio",
    "SELECT event_type, round(coalesce(sum(value) FILTER (value > 100) / nullif(count(*) FILTER (value > 100), 0), 0.0), 6) AS mean_large FROM events GROUP BY 1",
)
def safe_ratio(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    big = F.col("value") > 100
    sums = e.groupBy("event_type").agg(
        F.sum(F.when(big, F.col("value"))).alias("s"), F.count_if(big).alias("n")
    )
    return sums.select("event_type", F.round(ratio_of(F.col("s"), F.col("n")), 6).alias("mean_large"))


# ---------------------------------------------------------------- prompts


@query("claim_prompt", "SELECT message_id, prompt FROM f_prompts")
def claim_prompt(spark, sf_dir):
    rows = v.gold_rows(spark, sf_dir).where(F.size("spans") > 0)
    return rows.select("message_id", pr.claim_prompt(F.col("text"), F.col("spans")).alias("prompt"))


@query("spot_prompt", "SELECT message_id, prompt FROM f_spot_prompts")
def spot_prompt(spark, sf_dir):
    rows = v.gold_rows(spark, sf_dir).where(F.size("spans") > 0)
    return rows.select("message_id", pr.spot_prompt(F.col("text"), F.col("spans")).alias("prompt"))


@query("quality_prompt", "SELECT message_id, prompt FROM f_quality_prompts")
def quality_prompt(spark, sf_dir):
    rows = v.messages(spark, sf_dir).where(~F.col("label").eqNullSafe(F.lit("ham")))
    return rows.select("message_id", pr.quality_prompt(F.col("text")).alias("prompt"))


@query("fewshot_prompt", "SELECT message_id, prompt FROM f_fewshot_prompts")
def fewshot_prompt(spark, sf_dir):
    """A prompt for every message with parsed claims.

    Messages are dealt into FOLDS by a hash.  Examples are the nearest parsed claims of
    the type in the other folds, so none comes from the message itself.  The tables hold
    no claim vectors; a claim takes one of ``embeddings`` by its ids.
    """
    parsed = v.parsed_gold(spark, sf_dir).select(
        "message_id",
        "claim_type",
        "claim_text",
        "canonical_form",
        F.map_entries("slots").alias("slots"),
        F.col("claim_id").cast("int").alias("claim_id"),
        (F.col("doc_id") * 1_000_000 + F.col("claim_id")).alias("id"),
        (F.col("doc_id") * 31 + F.col("claim_id")).alias("pick"),
    )
    vectors = v.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = F.broadcast(vectors.agg(F.count("*").alias("size")))
    placed = parsed.select("id", "claim_type", fold(F.col("message_id")).alias("fold"), "pick").join(size)
    placed = placed.withColumn("vec_id", F.col("pick") % F.col("size")).join(vectors, "vec_id")
    found = rt.example_topk(placed, placed, 3, apart="fold")
    return retrieved_prompts(v.gold_rows(spark, sf_dir), parsed, found)


FOLDS = 4


def fold(message_id):
    """One of FOLDS by the first digit of a hash; fold 0 are the digits 0 to 3."""
    digit = F.conv(F.substring(F.md5(F.concat(F.lit("fewshot:"), message_id)), 1, 1), 16, 10)
    return F.floor(digit.cast("int") * FOLDS / 16).cast("int")


def retrieved_prompts(rows, parsed, found):
    """Prompts of messages (message_id, text, spans) with the retrieved examples of each span.

    ``parsed``: id, message_id, claim_id and the parsed claim; ``found``: query_id,
    example_id, rank.  Spans are in claim order.
    """
    known = parsed.select(F.col("id").alias("example_id"), "claim_text", "canonical_form", "slots")
    shown = (
        found.join(known, "example_id")
        .groupBy(F.col("query_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "claim_text", "canonical_form", "slots"))).alias("examples"))
    )
    claims = parsed.select("id", "message_id", "claim_id").join(shown, "id", "left")
    packed = claims.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("claim_id", "examples"))).alias("known")
    )
    none = F.expr("cast(array() as array<struct<rank:int,claim_text:string,canonical_form:string,slots:array<struct<key:string,value:string>>>>)")

    def with_examples(known):
        def lines(i):
            return F.transform(
                F.coalesce(F.get(known, i)["examples"], none),
                lambda k: F.struct(k["claim_text"], k["canonical_form"], F.map_from_entries(k["slots"]).alias("slots")),
            )

        return F.transform(
            "spans",
            lambda s, i: F.struct(s["claim_type"], s["text"], s["start"], s["end"], lines(i).alias("examples")),
        )

    spans = let(F.col("known"), with_examples)
    return rows.join(packed, "message_id").select(
        "message_id", let(spans, lambda s: pr.fewshot_prompt(F.col("text"), s)).alias("prompt")
    )


@query(
    "seq2seq_input",
    """SELECT g.message_id, g.claim_id, md5('CLAIM_TYPE: ' || g.claim_type || '; TEXT: ' || g.text || '; CONTEXT: ' || m.text) AS input_md5
    FROM f_gold g JOIN f_messages m USING (message_id)""",
)
def seq2seq_input(spark, sf_dir):
    text = F.col("text")
    lines = F.transform(
        "spans", lambda s: F.md5(pr.seq2seq_input(s["claim_type"], s["text"], text))
    )
    return v.gold_rows(spark, sf_dir).select(
        "message_id", F.posexplode(lines).alias("claim_id", "input_md5")
    )


@query("seq2seq_target", _TARGET)
def seq2seq_target(spark, sf_dir):
    return v.parsed_gold(spark, sf_dir).select(
        "message_id",
        "claim_id",
        pr.seq2seq_target(F.col("canonical_form"), F.col("slots")).alias("target_text"),
    )


# ---------------------------------------------------------------- responses

v.SQL["f_replies"] = """
    SELECT message_id, doc_id, claim_id, claim_type, wl, doc_id % 6 AS kind, doc_id % 17 = 0 AS failed FROM f_gold
"""
_PARSED = """
    SELECT message_id, claim_id, claim_type, CASE WHEN kind = 5 THEN '' ELSE 'says ' || claim_type END AS canonical_form,
           CASE WHEN kind = 5 THEN NULL ELSE CAST(wl AS VARCHAR) END AS slot_k
    FROM f_replies WHERE kind IN (0, 1, 2) OR (kind = 5 AND claim_id = 0)
"""


def _parsed(df):
    """Spans are numbered in their array, so a parsed claim brings its own position."""
    numbered = F.transform("spans", lambda s, i: s.withField("place", i))
    small = F.transform(
        rs.parse_claim_list(F.col("content"), numbered),
        lambda p: F.struct(
            p["span"]["place"].cast("int").alias("claim_id"),
            p["span"]["claim_type"].alias("claim_type"),
            p["canonical_form"].alias("canonical_form"),
            F.try_element_at(p["slots"], F.lit("k")).alias("slot_k"),
        ),
    )
    return df.select("message_id", F.inline(small))


@query("parse_llm_array", _PARSED)
def parse_llm_array(spark, sf_dir):
    return _parsed(v.responses(spark, sf_dir))


@query(
    "attach_responses",
    """SELECT message_id, doc_id, count(*) AS n_spans FROM f_replies WHERE NOT failed GROUP BY 1, 2 HAVING count(*) > 1""",
)
def attach_responses(spark, sf_dir):
    r = v.responses(spark, sf_dir)
    # requests for a single span are not on record
    known = r.where(F.size("spans") > 1).select("custom_id", "message_id", "doc_id", "spans")
    joined = sp.attach_responses(r.select("custom_id", "content", "error"), known)
    return joined.select("message_id", "doc_id", F.size("spans").alias("n_spans"))


@query(
    "strip_code_fence",
    """
    WITH b AS (
      SELECT message_id, any_value(kind) AS kind, '[' || string_agg('{"claim_id":' || (claim_id + 1) || ',"canonical_form":"says ' || claim_type || '","slots":{"k":"' || wl || '"}}', ',' ORDER BY claim_id) || ']' AS body,
             arg_min('{"claim_id":1,"canonical_form":"says ' || claim_type || '","slots":{"k":"' || wl || '"}}', claim_id) AS one, count(*) AS n
      FROM f_replies GROUP BY 1)
    SELECT message_id, CASE WHEN kind IN (0, 1, 2) THEN body WHEN kind = 3 THEN 'Sorry: ' || body WHEN kind = 4 THEN one
           ELSE '[{"claim_id": 0, "canonical_form": "zero"}, {"canonical_form": "none"}, {"claim_id": ' || (n + 1) || ', "canonical_form": "far"}, {"claim_id": 1}]' END AS content FROM b
    """,
)
def strip_code_fence(spark, sf_dir):
    return v.responses(spark, sf_dir).select(
        "message_id", rs.strip_code_fence(F.col("content")).alias("content")
    )


@query(
    "flatten_predictions",
    "SELECT message_id, claim_id, claim_type FROM (" + _PARSED + ")",
)
def flatten_predictions(spark, sf_dir):
    r = v.responses(spark, sf_dir)
    packed = _parsed(r).groupBy("message_id").agg(
        F.collect_list(F.struct("claim_id", "claim_type")).alias("claims")
    )
    return packed.select("message_id", F.explode("claims").alias("c")).select("message_id", "c.*")


def _kv_text():
    wl, cid = F.col("wl"), F.col("claim_id")
    return F.concat(
        F.lit("canonical= "),
        "canonical_form",
        F.lit(" ; brand=v"),
        wl,
        F.lit("; reason="),
        F.when(wl % 3 == 0, "null").when(wl % 3 == 1, "N/A").otherwise("a=b"),
        F.lit("; brand=w"),
        cid,
        F.lit("; status= None ;"),
    )


@query(
    "parse_kv_output",
    """
    SELECT message_id, claim_id, canonical_form, 'w' || claim_id AS brand, CASE WHEN wl % 3 = 2 THEN 'a=b' END AS reason, NULL::VARCHAR AS status, 3 AS n_slots
    FROM f_pclaims_g
    """,
)
def parse_kv_output(spark, sf_dir):
    rows = v.parsed_gold(spark, sf_dir).select(
        "message_id", "claim_id", rs.parse_kv_output(_kv_text()).alias("p")
    )
    return rows.select(
        "message_id",
        "claim_id",
        "p.canonical_form",
        *[F.try_element_at("p.slots", F.lit(s)).alias(s) for s in ("brand", "reason", "status")],
        F.size("p.slots").alias("n_slots"),
    )


@query(
    "parse_pipe_output",
    """
    SELECT message_id, claim_id, CASE wl % 3 WHEN 0 THEN 'canonical: ' || canonical_form ELSE canonical_form END AS canonical_form,
           CASE WHEN wl % 3 = 1 THEN 'v' || wl END AS brand, CASE WHEN wl % 3 = 1 THEN 1 ELSE 0 END AS n_slots FROM f_pclaims_g
    """,
)
def parse_pipe_output(spark, sf_dir):
    wl = F.col("wl") % 3
    head = F.concat(F.lit("canonical: "), "canonical_form")
    text = (
        F.when(wl == 0, head)
        .when(wl == 1, F.concat(head, F.lit(' | slots: {"brand": "v'), "wl", F.lit('"}')))
        .otherwise(F.concat(head, F.lit(" | slots: {broken")))
    )
    rows = v.parsed_gold(spark, sf_dir).select(
        "message_id", "claim_id", rs.parse_pipe_output(text).alias("p")
    )
    return rows.select(
        "message_id",
        "claim_id",
        "p.canonical_form",
        F.try_element_at("p.slots", F.lit("brand")).alias("brand"),
        F.size("p.slots").alias("n_slots"),
    )


@query(
    "parse_spot",
    """
    SELECT message_id, claim_id, claim_type, 'w' || wl AS original_text, 'sender' AS subject, CASE WHEN wl % 2 = 0 THEN 'now' END AS "time", 'is it true?' AS verification_question
    FROM f_gold WHERE doc_id % 3 <> 2 OR claim_id = 0
    """,
)
def parse_spot(spark, sf_dir):
    rows = v.gold_rows(spark, sf_dir).where(F.size("spans") > 0)
    items = F.transform(
        "spans",
        lambda s: F.struct(
            s["claim_type"],
            F.concat(F.lit("w"), s["wl"]).alias("original_text"),
            F.struct(
                F.lit("sender").alias("subject"), F.when(s["wl"] % 2 == 0, "now").alias("time")
            ).alias("spot"),
            F.lit("is it true?").alias("verification_question"),
        ),
    )
    kind = F.col("doc_id") % 3
    reply = (
        F.when(kind == 0, F.concat(F.lit('{"claims": '), F.to_json(items), F.lit("}")))
        .when(kind == 1, F.to_json(items))
        .otherwise(F.to_json(F.get(items, F.lit(0))))
    )
    out = rows.select("message_id", F.posexplode(rs.parse_spot(reply)).alias("claim_id", "c"))
    return out.select(
        "message_id", "claim_id", "c.claim_type", "c.original_text", "c.subject", "c.time", "c.verification_question"
    )


# ---------------------------------------------------------------- ranking

v.SQL["f_experiments"] = """
    WITH c AS (
      SELECT d.source || '-' || d.lang AS experiment, d.source AS name, d.lang AS approach, count(*) FILTER (toxic = 1 AND quality = 1) AS tp,
             count(*) FILTER (toxic = 0 AND quality = 1) AS fp, count(*) FILTER (toxic = 0 AND quality = 0) AS tn, count(*) FILTER (toxic = 1 AND quality = 0) AS fn,
             CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS n
      FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2, 3),
    r AS (SELECT *, (tp + 1)::DOUBLE / (tp + fp + 2) AS precision, (tp + 1)::DOUBLE / (tp + fn + 2) AS recall, (tp + tn + 1)::DOUBLE / (tp + fp + tn + fn + 2) AS accuracy FROM c)
    SELECT *, 2 * precision * recall / (precision + recall) AS f1, chars::DOUBLE / n AS ms FROM r
"""


def experiment_trees(spark, sf_dir):
    """A result tree per source and language, in three layouts by language."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    toxic, quality = F.col("toxic") == 1, F.col("quality") == 1
    c = (
        docs.join(v.table(spark, sf_dir, "labels"), "doc_id", "left")
        .groupBy("source", "lang")
        .agg(
            F.count_if(toxic & quality).alias("tp"),
            F.count_if(~toxic & quality).alias("fp"),
            F.count_if(~toxic & ~quality).alias("tn"),
            F.count_if(toxic & ~quality).alias("fn"),
            F.sum("n_chars").alias("chars"),
            F.count("*").alias("n"),
        )
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p, r = (tp + 1) / (tp + fp + 2), (tp + 1) / (tp + fn + 2)
    scored = c.withColumns(
        {
            "precision": p,
            "recall": r,
            "accuracy": (tp + tn + 1) / (tp + fp + tn + fn + 2),
            "f1": 2 * p * r / (p + r),
            "ms": F.col("chars") / F.col("n"),
        }
    )
    detection = F.struct(
        "accuracy",
        "precision",
        "recall",
        "f1",
        F.struct(
            tp.alias("true_positive"), fp.alias("false_positive"), tn.alias("true_negative"), fn.alias("false_negative")
        ).alias("confusion_matrix"),
    )
    times = F.struct(F.col("ms").alias("mean"), F.col("ms").alias("p50"), (F.col("ms") * 2).alias("p95"), (F.col("ms") * 3).alias("p99"))
    lang = F.col("lang")
    metrics = F.struct(
        F.when(lang == "en", F.col("f1")).alias("eval_f1"),
        F.when(lang == "en", F.col("precision")).alias("eval_precision"),
        F.when(lang == "en", F.col("recall")).alias("eval_recall"),
        F.when(lang == "en", F.col("accuracy")).alias("eval_accuracy"),
        F.when(lang == "fr", detection).alias("end_to_end_phishing_detection"),
        F.when(lang == "es", detection).alias("in_distribution_performance"),
        F.when(lang == "de", F.col("ms")).alias("test_loss"),
        F.when(lang == "en", times).alias("inference_time_ms"),
        F.when(lang == "fr", F.struct(times.alias("total_time_ms"))).alias("inference_pipeline"),
        F.when(
            lang == "es", F.struct(times.alias("encoding_time_ms"), (F.col("ms") + 1).alias("total_inference_ms"))
        ).alias("inference_efficiency"),
    )
    return scored.select(
        F.concat_ws("-", "source", "lang").alias("experiment"),
        F.struct(F.struct(F.col("source").alias("name"), lang.alias("approach")).alias("config"), metrics.alias("test_metrics")).alias("tree"),
    )


def _experiments(spark, sf_dir):
    return experiment_trees(spark, sf_dir).select(
        "experiment", F.try_parse_json(F.to_json("tree")).alias("result")
    )


@query("scan_experiments", "SELECT 'run=' || experiment AS experiment, name, approach FROM f_experiments")
def scan_experiments(spark, sf_dir):
    path = scratch_dir(spark, "experiments")
    trees = experiment_trees(spark, sf_dir)
    trees.select(F.col("experiment").alias("run"), "tree.*").write.partitionBy("run").json(path)
    return rk.extract_metrics(tabular.read_experiments(spark, path)).select("experiment", "name", "approach")


_RANK = """
    SELECT experiment, name, approach, CASE WHEN approach <> 'de' THEN round(f1, 6) END AS f1, CASE WHEN approach <> 'de' THEN round(precision, 6) END AS precision,
           CASE WHEN approach <> 'de' THEN round(recall, 6) END AS recall, CASE WHEN approach <> 'de' THEN round(accuracy, 6) END AS accuracy,
           CASE WHEN approach = 'de' THEN round(ms, 6) END AS loss,
           CASE WHEN approach IN ('fr', 'es') THEN round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0.0), 6) END AS fpr,
           CASE WHEN approach IN ('fr', 'es') THEN round(coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0.0), 6) END AS fnr
    FROM f_experiments
"""


@query("model_ranking", _RANK)
def model_ranking(spark, sf_dir):
    out = rk.model_ranking(_experiments(spark, sf_dir)).drop("tp", "fp", "tn", "fn")
    return out.withColumns({c: F.round(c, 6) for c in out.columns[3:]})


@query(
    "best_models",
    f"""
    WITH l AS (UNPIVOT (SELECT experiment, f1, precision, recall, accuracy FROM ({_RANK})) ON f1, precision, recall, accuracy INTO NAME metric VALUE value)
    SELECT metric, arg_max(experiment, {{'v': value, 'e': experiment}}) AS experiment, max(value) AS value FROM l GROUP BY 1
    """,
)
def best_models(spark, sf_dir):
    return rk.best_models(_experiments(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "kfold_summary",
    """
    SELECT name, count(*) AS n_folds, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std
    FROM f_experiments GROUP BY 1
    """,
)
def kfold_summary(spark, sf_dir):
    """Folds of a source are its languages."""
    rows = fold_scores(spark, sf_dir)
    out = rk.kfold_summary(rows, "name", ["f1", "recall"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns[2:]})


def fold_scores(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    toxic, quality = F.col("toxic") == 1, F.col("quality") == 1
    c = (
        docs.join(v.table(spark, sf_dir, "labels"), "doc_id", "left")
        .groupBy(F.col("source").alias("name"), "lang")
        .agg(
            F.count_if(toxic & quality).alias("tp"),
            F.count_if(~toxic & quality).alias("fp"),
            F.count_if(toxic & ~quality).alias("fn"),
        )
    )
    p = (F.col("tp") + 1) / (F.col("tp") + F.col("fp") + 2)
    r = (F.col("tp") + 1) / (F.col("tp") + F.col("fn") + 2)
    return c.select("name", "lang", r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))


@query(
    "latency_profile",
    """
    SELECT event_type, round(avg(value), 6) AS mean, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
           round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1
    """,
)
def latency_profile(spark, sf_dir):
    out = rk.latency_profile(v.table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


@query(
    "latency_stored",
    """
    SELECT experiment, round(CASE WHEN approach = 'es' THEN ms + 1 ELSE ms END, 6) AS mean, round(ms, 6) AS p50, round(ms * 2, 6) AS p95, round(ms * 3, 6) AS p99
    FROM f_experiments WHERE approach <> 'de'
    """,
)
def latency_stored(spark, sf_dir):
    out = rk.latency_stored(_experiments(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


@query(
    "cost_estimate",
    """
    WITH c AS (SELECT count(DISTINCT doc_id) AS messages, count(*) AS claims FROM f_gold)
    SELECT messages, claims, round(claims::DOUBLE / messages, 6) AS claims_per_message, round(claims * 0.01::DOUBLE, 6) AS cost,
           round(claims * 0.005::DOUBLE, 6) AS batch_cost, messages * 0.5::DOUBLE AS seconds FROM c
    """,
)
def cost_estimate(spark, sf_dir):
    out = rk.cost_estimate(v.gold(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("claims_per_message", "cost", "batch_cost")})


@query(
    "ood_summary",
    """
    WITH h AS (SELECT doc_id FROM f_messages),
    n AS (SELECT doc_id, (SELECT count(*) FROM f_pred p WHERE p.doc_id = h.doc_id) AS k FROM h JOIN f_messages USING (doc_id) WHERE trim(text) <> ''),
    t AS (SELECT count(*)::DOUBLE AS messages, (count(*) FILTER (k > 0))::DOUBLE AS with_claims, sum(k)::DOUBLE AS claims FROM n)
    SELECT item, round(value, 6) AS value FROM (
      SELECT 'messages' AS item, messages AS value FROM t UNION ALL SELECT 'with_claims', with_claims FROM t UNION ALL SELECT 'claims', claims FROM t
      UNION ALL SELECT 'mean_per_message', claims / messages FROM t UNION ALL SELECT 'mean_with_claims', claims / with_claims FROM t
      UNION ALL SELECT 'pct:' || claim_type, count(*) * 100.0::DOUBLE / any_value(claims) FROM f_pred JOIN h USING (doc_id), t GROUP BY claim_type)
    """,
)
def ood_summary(spark, sf_dir):
    out = rk.ood_summary(v.results_of(rk.first_inputs(v.messages(spark, sf_dir), "doc_id")))
    return out.withColumn("value", F.round("value", 6))
