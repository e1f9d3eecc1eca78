"""Queries for splits, samples, training material and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.claims import slot_names
from ..functions.constants import GOLD_QUOTAS, SLOT_SCHEMA, SUBSTITUTIONS
from ..functions.responses import parse_pipe_output
from ..operators import sampling as sm
from ..operators import spans as sp
from ..operators import retrieval as rt
from ..operators import training as tr
from ..operators.labels import label_normalize
from ..session import scratch_dir
from ..sources import annotations as an
from ..sources.tabular import with_source_index
from . import views as v
from .dataset import _RAW_LABEL, raw_labelled
from .prompt_sql import quoted
from .registry import query

_H = "md5('{seed}:' || message_id)"


def _rank(seed: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {_H.format(seed=seed)}, message_id)"


def _plain(spark, sf_dir):
    return v.messages(spark, sf_dir).select("message_id", "doc_id", "label")


@query(
    "stratified_split",
    f"""
    WITH s AS (SELECT message_id, label, CASE WHEN label = 'ham' THEN 'ham' ELSE 'smish' END AS k FROM f_messages),
    r AS (SELECT *, {_rank(42, 'k')} AS r, count(*) OVER (PARTITION BY k) AS n FROM s)
    SELECT message_id, label, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r
    """,
)
def stratified_split(spark, sf_dir):
    return sm.stratified_split(_plain(spark, sf_dir)).select("message_id", "label", "split")


@query(
    "stratified_split_labelled",
    f"""
    WITH r AS (SELECT *, {_rank(42, 'label')} AS r, count(*) OVER (PARTITION BY label) AS n FROM f_messages)
    SELECT message_id, label, CASE WHEN label IS NOT NULL AND r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r
    """,
)
def stratified_split_labelled(spark, sf_dir):
    return sm.stratified_split(_plain(spark, sf_dir), unlabelled="train").select(
        "message_id", "label", "split"
    )


@query(
    "three_way_split",
    f"""
    WITH r AS (SELECT message_id, {_rank(42)} AS r, count(*) OVER () AS n FROM f_messages)
    SELECT message_id, CASE WHEN r <= floor(n * 0.67::DOUBLE) THEN 'train'
           WHEN r <= floor(n * 0.67::DOUBLE) + floor(n * 0.17::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r
    """,
)
def three_way_split(spark, sf_dir):
    return sm.three_way_split(_plain(spark, sf_dir)).select("message_id", "split")


@query(
    "nested_split",
    f"""
    WITH s AS (SELECT message_id, CASE WHEN label = 'ham' THEN 'HAM' ELSE 'SMISH' END AS class FROM f_messages),
    r AS (SELECT *, {_rank(42, 'class')} AS r, count(*) OVER (PARTITION BY class) AS n FROM s),
    t AS (SELECT *, ceil(n * 0.15::DOUBLE) AS t FROM r)
    SELECT message_id, class, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((n - t) * 0.176::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM t
    """,
)
def nested_split(spark, sf_dir):
    ham = F.col("label").eqNullSafe(F.lit("ham"))
    rows = _plain(spark, sf_dir).withColumn("class", F.when(ham, "HAM").otherwise("SMISH"))
    return sm.nested_split(rows, "class").select("message_id", "class", "split")


@query(
    "kfold_assign",
    f"""
    WITH s AS (SELECT message_id, CASE WHEN label = 'ham' THEN 'ham' ELSE 'smish' END AS label FROM f_messages)
    SELECT message_id, label, CAST(({_rank(42, 'label')} - 1) % 5 AS INTEGER) AS fold FROM s
    """,
)
def kfold_assign(spark, sf_dir):
    ham = F.col("label").eqNullSafe(F.lit("ham"))
    rows = _plain(spark, sf_dir).withColumn("label", F.when(ham, "ham").otherwise("smish"))
    return sm.kfold_assign(rows, "label")


@query(
    "sample_n",
    f"SELECT message_id FROM f_messages WHERE label = 'ham' ORDER BY {_H.format(seed=42)}, message_id LIMIT 200",
)
def sample_n(spark, sf_dir):
    return sm.sample_n(_plain(spark, sf_dir).where("label = 'ham'"), 200).select("message_id")


@query(
    "proportional_sample",
    f"""
    WITH s AS (SELECT message_id, CASE WHEN label = 'ham' THEN 0 ELSE (SELECT count(*) FROM f_gold g WHERE g.doc_id = m.doc_id) END AS stratum FROM f_messages m),
    r AS (SELECT *, {_rank(42, 'stratum')} AS r, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total FROM s),
    p AS (SELECT message_id, stratum FROM r WHERE r <= least(greatest(floor(150 * (n::DOUBLE / total)), 5), n)),
    q AS (SELECT *, {_rank(43)} AS r2 FROM p)
    SELECT message_id, stratum FROM q WHERE r2 <= 150
    """,
)
def proportional_sample(spark, sf_dir):
    return sm.proportional_sample(v.gold_rows(spark, sf_dir)).select("message_id", "stratum")


@query(
    "annotation_pool",
    f"""
    WITH m AS (SELECT CAST(d.doc_id AS VARCHAR) AS message_id, d.doc_id, CASE {_RAW_LABEL} WHEN 'phishing' THEN 'smishing' ELSE {_RAW_LABEL} END AS label
               FROM documents d LEFT JOIN labels l USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS a, {_rank(42, 'label')} AS b FROM m),
    p AS (SELECT message_id, label FROM r WHERE (label = 'smishing' AND a <= 510) OR (label = 'ham' AND b <= 100) OR (label = 'spam' AND b <= 50)),
    o AS (SELECT *, row_number() OVER (ORDER BY md5('42:pool:' || message_id), message_id) AS position FROM p)
    SELECT *, position <= 20 AS pilot FROM o
    """,
)
def annotation_pool(spark, sf_dir):
    rows = label_normalize(raw_labelled(spark, sf_dir).select("message_id", "doc_id", "label"))
    return sm.annotation_pool(rows, "doc_id").drop("doc_id")


def _quota_sql() -> str:
    ctes, done = [], []
    for i, (kind, q) in enumerate(GOLD_QUOTAS.items()):
        taken = " UNION ALL ".join(f"SELECT message_id FROM q{j}" for j in range(i))
        free = f"WHERE message_id NOT IN ({taken})" if taken else ""
        ctes.append(
            f"q{i} AS (SELECT message_id FROM (SELECT DISTINCT message_id FROM f_gold WHERE claim_type = '{kind}') "
            f"{free} ORDER BY {_H.format(seed=42)}, message_id LIMIT {q})"
        )
        done.append(f"SELECT message_id FROM q{i}")
    ctes.append("picked AS (" + " UNION ALL ".join(done) + ")")
    ctes.append("room AS (SELECT greatest(300 - count(*), 0) AS n FROM picked)")
    for name, label, n in (("fh", "ham", "n // 2"), ("fs", "smish", "n - n // 2")):
        ctes.append(
            f"{name} AS (SELECT message_id FROM (SELECT message_id, {_rank(42)} AS r FROM f_messages WHERE label = '{label}' "
            f"AND message_id NOT IN (SELECT message_id FROM picked)), room WHERE r <= {n})"
        )
    return (
        "WITH " + ", ".join(ctes)
        + " SELECT message_id FROM picked UNION ALL SELECT message_id FROM fh UNION ALL SELECT message_id FROM fs"
    )


@query("gold_quota_sample", _quota_sql())
def gold_quota_sample(spark, sf_dir):
    return sm.gold_quota_sample(_plain(spark, sf_dir), v.gold(spark, sf_dir))


@query(
    "dense_task_ids",
    "SELECT message_id, 1000 + row_number() OVER (ORDER BY doc_id) AS id FROM f_messages WHERE label = 'ham'",
)
def dense_task_ids(spark, sf_dir):
    path = scratch_dir(spark, "ham")
    ham = _plain(spark, sf_dir).where("label = 'ham'")
    ham.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    rows = with_source_index(spark.read.parquet(path))
    return rows.select("message_id", (F.col("row_index") + 1001).alias("id"))


@query(
    "task_document",
    """
    SELECT message_id AS id, text, 1 AS n_annotations, 0 AS n_results, FALSE AS is_augmented, 'ham_source' AS source, 'ham' AS label
    FROM f_messages WHERE label = 'ham'
    """,
)
def task_document(spark, sf_dir):
    path = scratch_dir(spark, "tasks")
    an.write_annotations(
        an.task_document(v.messages(spark, sf_dir).where("label = 'ham'"), "message_id", "ham_source"), path
    )
    docs = an.read_annotations(spark, path)
    return docs.select(
        "id",
        "data.text",
        F.size("annotations").alias("n_annotations"),
        F.size(an.first_result(docs)).alias("n_results"),
        "meta.is_augmented",
        "meta.source",
        "meta.label",
    )


@query(
    "union_balance",
    """
    SELECT message_id AS id, label, is_augmented, source, md5('42:' || message_id) AS shuffle_key
    FROM (SELECT message_id, label, is_augmented, source FROM f_meta WHERE label IS DISTINCT FROM 'ham'
          UNION ALL SELECT message_id, 'ham', FALSE, 'ham_source' FROM f_messages WHERE label = 'ham')
    """,
)
def union_balance(spark, sf_dir):
    ham = an.task_document(v.messages(spark, sf_dir).where("label = 'ham'"), "message_id", "ham_source")
    phishing = v.annotations(spark, sf_dir, pinned=False).where(~F.col("meta.label").eqNullSafe(F.lit("ham")))
    both = tr.union_balance(phishing.select("id", "data", "meta"), ham)
    return both.select("id", "meta.label", "meta.is_augmented", "meta.source", "shuffle_key")


# ---------------------------------------------------------------- training pairs

_TARGET = """
    SELECT g.message_id, g.claim_id, 'canonical=' || g.canonical_form ||
           coalesce(string_agg('; ' || s.slot || '=' || s.value, '' ORDER BY s.slot) FILTER (s.value IS NOT NULL), '') AS target_text
    FROM f_pclaims_g g LEFT JOIN f_slots_g s ON s.message_id = g.message_id AND s.claim_id = g.claim_id
    GROUP BY g.message_id, g.claim_id, g.canonical_form
"""


@query(
    "training_pairs_join",
    f"""
    WITH t AS ({_TARGET})
    SELECT g.message_id, g.claim_id, g.claim_type, md5('CLAIM_TYPE: ' || g.claim_type || '; TEXT: ' || g.text || '; CONTEXT: ' || m.text) AS input_md5,
           length(m.text) + length(g.text) + length(g.claim_type) + 31 AS input_length, target_text
    FROM f_gold g JOIN t USING (message_id, claim_id) JOIN f_messages m ON m.message_id = g.message_id
    """,
)
def training_pairs_join(spark, sf_dir):
    pairs = sp.training_pairs_join(
        v.messages(spark, sf_dir), v.gold(spark, sf_dir), v.parsed_gold(spark, sf_dir)
    )
    # the whole message is in every input; digests keep the result small
    return pairs.select(
        "message_id",
        "claim_id",
        "claim_type",
        F.md5("input_text").alias("input_md5"),
        F.length("input_text").alias("input_length"),
        "target_text",
    )


@query(
    "training_pairs_last_wins",
    f"""
    WITH t AS ({_TARGET})
    SELECT g.message_id, g.claim_id, md5('CLAIM_TYPE: ' || g.claim_type || '; TEXT: ' || g.text || '; CONTEXT: ' || m.text) AS input_md5, target_text
    FROM f_gold g JOIN t USING (message_id, claim_id) JOIN f_messages m ON m.message_id = g.message_id
    """,
)
def training_pairs_last_wins(spark, sf_dir):
    """Every claim was parsed twice; the later run's parse becomes the target."""
    parsed = v.parsed_gold(spark, sf_dir).select("message_id", "claim_id", "canonical_form", "slots")
    draft = parsed.withColumn("canonical_form", F.lit("draft")).withColumn("run", F.lit(1))
    runs = draft.unionByName(parsed.withColumn("run", F.lit(2)))
    pairs = sp.training_pairs_join(v.messages(spark, sf_dir), v.gold(spark, sf_dir), runs, "run")
    return pairs.select("message_id", "claim_id", F.md5("input_text").alias("input_md5"), "target_text")


_NAMES = " ".join(f"WHEN '{t}' THEN {quoted(', '.join(s[0] for s in slots))}" for t, slots in SLOT_SCHEMA.items())


@query(
    "slot_aware_input",
    f"""
    SELECT g.message_id, g.claim_id, md5('[' || g.claim_type || '] [SLOTS: ' || CASE g.claim_type {_NAMES} END || '] Message: ' || m.text || ' | Claim: ' || g.text) AS input_md5
    FROM f_gold g JOIN f_messages m USING (message_id)
    """,
)
def slot_aware_input(spark, sf_dir):
    pairs = tr.slot_aware_pairs(
        v.messages(spark, sf_dir), v.gold(spark, sf_dir), v.parsed_gold(spark, sf_dir)
    )
    return pairs.select("message_id", "claim_id", F.md5("input").alias("input_md5"))


@query(
    "slot_aware_target",
    """
    SELECT g.message_id, g.claim_id, g.canonical_form,
           coalesce(string_agg(s.slot || '=' || coalesce(s.value, 'NULL'), ';' ORDER BY s.slot), '') AS slots
    FROM f_pclaims_g g LEFT JOIN f_slots_g s ON s.message_id = g.message_id AND s.claim_id = g.claim_id GROUP BY 1, 2, 3
    """,
)
def slot_aware_target(spark, sf_dir):
    """Written and parsed back: JSON layout differs between engines, content must not."""
    pairs = tr.slot_aware_pairs(
        v.messages(spark, sf_dir), v.gold(spark, sf_dir), v.parsed_gold(spark, sf_dir)
    )
    back = pairs.select("message_id", "claim_id", parse_pipe_output(F.col("output")).alias("p"))
    line = F.transform(
        F.array_sort(F.map_entries("p.slots")),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL"))),
    )
    return back.select(
        "message_id", "claim_id", F.col("p.canonical_form").alias("canonical_form"), F.array_join(line, ";").alias("slots")
    )


@query(
    "curriculum_phases",
    """
    SELECT message_id, claim_id, claim_type, phase FROM f_gold, (VALUES (1), (2), (3)) p(phase)
    WHERE phase >= CASE WHEN claim_type IN ('ACTION_CLAIM', 'URGENCY_CLAIM', 'REWARD_CLAIM') THEN 1
      WHEN claim_type IN ('FINANCIAL_CLAIM', 'ACCOUNT_CLAIM', 'DELIVERY_CLAIM', 'VERIFICATION_CLAIM') THEN 2 ELSE 3 END
    """,
)
def curriculum_phases(spark, sf_dir):
    g = v.gold(spark, sf_dir).select("message_id", "claim_id", "claim_type")
    return tr.curriculum_phases(g)


def _swap_sql() -> str:
    steps, prev = [], "a0"
    for i, (word, options) in enumerate(SUBSTITUTIONS.items(), 1):
        lst = "[" + ", ".join(quoted(o) for o in options) + "]"
        pick = f"({lst})[CAST(('0x' || md5('42:' || draw || ':' || {quoted(word)})[1:8])::BIGINT % {len(options)} AS INTEGER) + 1]"
        steps.append(
            f"a{i} AS (SELECT example_id, draw, claim_type, message_id, "
            f"CASE WHEN contains(input, {quoted(word)}) THEN replace(input, {quoted(word)}, {pick}) ELSE input END AS input, "
            f"CASE WHEN contains(input, {quoted(word)}) THEN replace(output, {quoted(word)}, {pick}) ELSE output END AS output FROM {prev})"
        )
        prev = f"a{i}"
    return ", ".join(steps) + f", last AS (SELECT * FROM {prev})"


@query(
    "augment_substitute",
    f"""
    WITH x AS (
      SELECT message_id || '-' || claim_id AS example_id, message_id, claim_type,
             '[' || claim_type || '] [SLOTS: ' || CASE claim_type {_NAMES} END || '] Claim: ' || claim_text AS input, 'canonical: your account: ' || canonical_form AS output
      FROM f_pclaims_g),
    r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || example_id), example_id) - 1 AS rank, count(*) OVER () AS n FROM x),
    d AS (SELECT rank AS draw, ('0x' || md5('42:' || rank)[1:8])::BIGINT % n AS pick FROM r),
    a0 AS (SELECT r.example_id, d.draw, r.claim_type, r.message_id, r.input, r.output FROM d JOIN r ON r.rank = d.pick),
    {_swap_sql()}
    SELECT example_id, draw, input, output, claim_type, message_id || '_aug' AS message_id FROM last
    UNION ALL SELECT example_id, NULL, input, output, claim_type, message_id FROM x
    """,
)
def augment_substitute(spark, sf_dir):
    names = F.array_join(slot_names(F.col("claim_type")), ", ")
    examples = v.parsed_gold(spark, sf_dir).select(
        F.concat_ws("-", "message_id", "claim_id").alias("example_id"),
        "message_id",
        "claim_type",
        F.concat(
            F.lit("["), "claim_type", F.lit("] [SLOTS: "), names, F.lit("] Claim: "), "claim_text"
        ).alias("input"),
        F.concat(F.lit("canonical: your account: "), "canonical_form").alias("output"),
    )
    return tr.augment_substitute(examples, 2)


@query(
    "example_topk",
    f"""
    WITH x AS (SELECT vec_id AS id, ({v.DIM12})[label + 1] AS claim_type, embedding::DOUBLE[] AS e, md5('split:' || vec_id) < '4' AS is_query FROM embeddings),
    s AS (SELECT q.id AS query_id, c.id AS example_id, round(list_inner_product(q.e, c.e), 6) AS score FROM x q JOIN x c USING (claim_type)
          WHERE q.is_query AND NOT c.is_query),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM s)
    SELECT query_id, rank, example_id, score FROM r WHERE rank <= 3
    """,
)
def example_topk(spark, sf_dir):
    e = _example_vectors(spark, sf_dir)
    is_query = F.md5(F.concat(F.lit("split:"), F.col("id").cast("string"))) < "4"
    return rt.example_topk(e.where(~is_query), e.where(is_query))


def _example_vectors(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), v.type_at(F.col("label")).alias("claim_type"), "embedding"
    )


@query(
    "example_index",
    f"""
    WITH x AS (SELECT vec_id AS id, ({v.DIM12})[label + 1] AS claim_type FROM embeddings),
    n AS (SELECT claim_type, count(*) AS n FROM x GROUP BY 1)
    SELECT count(*) AS n_queries, sum(least(n, 3))::BIGINT AS n_wanted, count(*) AS n_answered, true AS recall_reached
    FROM x JOIN n USING (claim_type) WHERE id % 50 = 0
    """,
)
def example_index(spark, sf_dir):
    """Lists that hold every row, asked by the ids divisible by 50; recall against the exact product."""
    e = _example_vectors(spark, sf_dir)
    asked = e.where("id % 50 = 0")
    found = rt.VectorIndex.build(e).search(asked)
    hits = rt.recall(found, rt.example_topk(e, asked))
    answered = found.select(F.col("query_id").alias("q")).distinct()
    return hits.join(answered, F.col("query_id") == F.col("q"), "left").agg(
        F.count("*").alias("n_queries"),
        F.sum("wanted").alias("n_wanted"),
        F.count("q").alias("n_answered"),
        (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("recall_reached"),
    )
