"""Message labels, filters, review queues and per-message features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COMMON_REVIEW_TYPES
from ..functions.text import length_bucket as bucket_of
from ..functions.text import word_count
from ..sources.annotations import first_result


def label_normalize(messages: DataFrame) -> DataFrame:
    """Keep ham, spam and smishing; phishing counts as smishing."""
    label = F.when(F.col("label") == "phishing", "smishing").otherwise(F.col("label"))
    return messages.withColumn("label", label).where(F.col("label").isin("ham", "spam", "smishing"))


def label_default_smish(messages: DataFrame) -> DataFrame:
    """No label means smish; ``stratum`` is ham or smish, whatever the label."""
    label = F.coalesce("label", F.lit("smish"))
    return messages.withColumns(
        {"label": label, "stratum": F.when(label == "ham", "ham").otherwise("smish")}
    )


def label_from_claims(docs: DataFrame) -> DataFrame:
    """HAM when the first annotation has no result, or the label says ham."""
    spans = F.coalesce(F.size(first_result(docs)), F.lit(0))
    ham = (spans <= 0) | F.col("meta.label").eqNullSafe(F.lit("ham"))
    return docs.select(
        F.col("id").alias("message_id"), F.when(ham, "HAM").otherwise("SMISH").alias("class")
    )


def filter_by_split(messages: DataFrame, split: str) -> DataFrame:
    return messages.where(F.col("split") == split)


def lookup_message(messages: DataFrame, message_id: str, strict: bool = True) -> DataFrame:
    """The text of one message; an unknown id is an error in strict mode.

    The error is raised when the result is computed.
    """
    found = messages.where(F.col("message_id") == message_id).select("message_id", "text")
    if not strict:
        return found
    problem = F.raise_error(F.lit(f"message not found: {message_id}")).cast("string")
    return found.groupBy().agg(
        F.first("message_id").alias("message_id"), F.first("text").alias("text"), F.count("*").alias("_n")
    ).select(
        "message_id", F.when(F.col("_n") == 0, problem).otherwise(F.col("text")).alias("text")
    )


def lookup_spans(spans: DataFrame, message_id: str) -> DataFrame:
    return spans.where(F.col("message_id") == message_id)


def messages_with_claims(messages: DataFrame, spans: DataFrame) -> DataFrame:
    return messages.join(spans.select("message_id"), "message_id", "left_semi")


def _queue(docs: DataFrame, wanted: Column) -> DataFrame:
    rows = docs.select(
        F.col("id").alias("message_id"),
        F.col("data.text").alias("message"),
        F.posexplode(first_result(docs)).alias("claim_id", "r"),
    ).where(wanted)
    v = F.col("r.value")
    return rows.select(
        "message_id",
        "claim_id",
        F.get(v["labels"], F.lit(0)).alias("claim_type"),
        F.coalesce(v["text"], F.lit("")).alias("claim_text"),
        v["start"].alias("start"),
        v["end"].alias("end"),
        "message",
    )


def identity_review_queue(docs: DataFrame) -> DataFrame:
    """Results with IDENTITY_CLAIM anywhere in their label list."""
    return _queue(docs, F.array_contains("r.value.labels", "IDENTITY_CLAIM"))


def common_review_queue(docs: DataFrame) -> DataFrame:
    """Results whose first label is one of the common types."""
    return _queue(docs, F.get("r.value.labels", F.lit(0)).isin(COMMON_REVIEW_TYPES))


def message_features(rows: DataFrame) -> DataFrame:
    """Lengths and entity counts of rows holding a ``spans`` array."""
    types = F.transform("spans", lambda s: s["claim_type"])
    return rows.select(
        "message_id",
        F.length("text").alias("n_chars"),
        word_count(F.col("text")).alias("n_words"),
        F.size("spans").alias("n_entities"),
        F.size(F.array_distinct(types)).alias("n_types"),
    )


def length_bucket(messages: DataFrame) -> DataFrame:
    counts = messages.groupBy(bucket_of(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))
    return with_share(counts, "n", "pct", 100.0)


def with_share(counts: DataFrame, n: str, name: str, scale: float = 1.0) -> DataFrame:
    """Add each row's share of the total.

    ``counts`` is a finished aggregate with few rows (types, labels, splits),
    so the total is joined as a one-row table.
    """
    total = counts.agg(F.sum(n).alias("_total"))
    return (
        counts.join(F.broadcast(total))
        .withColumn(name, F.col(n).cast("double") * scale / F.col("_total"))
        .drop("_total")
    )


def class_distribution(messages: DataFrame) -> DataFrame:
    """Counts per split and label with totals, and the share in the split."""
    label = F.when(F.col("label").eqNullSafe(F.lit("ham")), "ham").otherwise("smish")
    counts = (
        messages.select("split", label.alias("label"))
        .groupingSets([[F.col("split"), F.col("label")], [F.col("split")]], F.col("split"), F.col("label"))
        .agg(F.grouping("label").alias("_all"), F.count("*").alias("n"))
    )
    totals = counts.where(F.col("_all") == 1).select("split", F.col("n").alias("_total"))
    return (
        counts.join(totals, "split")
        .select(
            "split",
            F.when(F.col("_all") == 1, "_total").otherwise(F.col("label")).alias("label"),
            "n",
            (F.col("n") * 100.0 / F.col("_total")).alias("pct"),
        )
    )
