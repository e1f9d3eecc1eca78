"""Writers.  All of them write in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import batch_request, claim_prompt
from ..session import stage


def sink_parsed_claims(claims: DataFrame, path: str, flag: str | None = None) -> None:
    """Parsed claims by claim type; ``flag`` marks them for review or as silver."""
    if flag not in (None, "needs_review", "silver_label"):
        raise ValueError("flag is needs_review, silver_label or None")
    out = claims if flag is None else claims.withColumn(flag, F.lit(True))
    out.write.mode("overwrite").partitionBy("claim_type").json(path)


def flat_rows(docs: DataFrame) -> DataFrame:
    meta = F.col("meta")
    augmented = F.coalesce(meta["is_augmented"], F.lit(False))
    return docs.select(
        F.col("data.text").alias("text"),
        F.when(meta["label"] == "ham", "ham").otherwise("phishing").alias("label"),
        augmented.alias("is_augmented"),
        F.coalesce(meta["source"], F.lit("unknown")).alias("source"),
        F.when(augmented, F.coalesce(meta["augmentation_type"], F.lit("N/A")))
        .otherwise("original")
        .alias("augmentation_type"),
    )


def sink_flat_csv(docs: DataFrame, path: str) -> None:
    flat_rows(docs).write.mode("overwrite").options(
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def batch_requests(rows: DataFrame, prompt: Column | None = None) -> DataFrame:
    """Requests for messages with spans: custom_id, request line, span list."""
    custom_id = F.concat(F.lit("request-"), F.col("message_id"))
    body = claim_prompt(F.col("text"), F.col("spans")) if prompt is None else prompt
    return rows.where(F.size("spans") > 0).select(
        custom_id.alias("custom_id"),
        "message_id",
        F.col("label").alias("message_label"),
        batch_request(custom_id, body).alias("request"),
        "spans",
    )


def sink_batch_jsonl(rows: DataFrame, path: str) -> None:
    """Request lines as text, and the span table keyed by custom_id beside it."""
    requests = stage(batch_requests(rows), "requests")
    requests.select("request").write.mode("overwrite").text(f"{path}/requests")
    requests.drop("request").write.mode("overwrite").parquet(f"{path}/metadata")


def sink_split_manifest(split_messages: DataFrame, claims: DataFrame, path: str) -> None:
    """Ids by split, and one summary row per split."""
    split_messages.select("message_id", "label", "split").write.mode("overwrite").partitionBy(
        "split"
    ).parquet(f"{path}/ids")
    split_summary(split_messages, claims).write.mode("overwrite").json(f"{path}/stats")


def split_summary(split_messages: DataFrame, claims: DataFrame) -> DataFrame:
    """Messages, ham, smish and claims per split."""
    per_message = claims.groupBy("message_id").agg(F.count("*").alias("n_claims"))
    ham = F.col("label").eqNullSafe(F.lit("ham"))
    return (
        split_messages.join(per_message, "message_id", "left")
        .groupBy("split")
        .agg(
            F.count("*").alias("total"),
            F.count_if(ham).alias("ham"),
            F.count_if(~ham).alias("smish"),
            F.coalesce(F.sum("n_claims"), F.lit(0)).alias("claims"),
        )
    )
