"""Joins and grouping on messages, spans and parsed claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let, pin
from ..functions.claims import schema_type, slot_dimension, slot_names
from ..functions.bio import word_hits
from ..functions.matching import overlapping_pairs, resolve_overlaps
from ..functions.prompts import seq2seq_input, seq2seq_target
from ..functions.text import with_words
from .evaluate import last_per_key


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str = "message_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def anti_selected(df: DataFrame, selected: DataFrame, key: str = "message_id") -> DataFrame:
    return df.join(selected.select(key), key, "left_anti")


def group_spans_by_message(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """Messages with their ordered span list (empty when there are none).

    The list is as long as the spans of one message, which its text bounds.
    """
    packed = spans.groupBy("message_id").agg(
        F.sort_array(
            F.collect_list(F.struct("claim_id", "start", "end", "claim_type", "text"))
        ).alias("spans")
    )
    kind = packed.schema["spans"].dataType
    return messages.join(packed, "message_id", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(kind))
    )


def training_pairs_join(
    messages: DataFrame, spans: DataFrame, parsed: DataFrame, order: str | None = None
) -> DataFrame:
    """Input and target text per span that has a parse and a message."""
    key = ["message_id", "claim_id"]
    best = last_per_key(parsed.select(*key, "canonical_form", "slots", *([order] if order else [])), key, order)
    joined = spans.join(best.select(*key, "canonical_form", "slots"), key).join(
        messages.select("message_id", F.col("text").alias("message")), "message_id"
    )
    return joined.select(
        *key,
        "claim_type",
        seq2seq_input(F.col("claim_type"), F.col("text"), F.col("message")).alias("input_text"),
        seq2seq_target(F.col("canonical_form"), F.col("slots")).alias("target_text"),
    )


def span_overlap_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of intersecting spans of one message, in list order."""
    return rows.select("message_id", F.explode(overlapping_pairs(F.col("spans"))).alias("x")).select(
        "message_id", F.col("x.a").alias("claim_a"), F.col("x.b").alias("claim_b")
    )


def resolve_rows(rows: DataFrame) -> DataFrame:
    """Replace ``spans`` by the resolved list; ``n_removed`` tells the loss."""
    keep = [c for c in rows.columns if c != "spans"]
    done = pin(rows, *keep, F.size("spans").alias("_n"), resolved=resolve_overlaps(F.col("spans")))
    return done.select(
        *keep,
        (F.col("_n") - F.size("resolved")).alias("n_removed"),
        F.col("resolved").alias("spans"),
    )


def word_intervals(w: Column, ws: Column) -> Column:
    """Words as spans, so they can be matched against claim spans."""
    return F.zip_with(
        ws, w, lambda s, word: F.struct(s.alias("start"), (s + F.length(word)).alias("end"))
    )


def word_span_overlap(rows: DataFrame) -> DataFrame:
    """For each word that meets a span: the first such span in list order."""
    hits = let(
        word_intervals(F.col("w"), F.col("ws")),
        lambda words: let(F.col("spans"), lambda spans: word_hits(words, spans)),
    )
    types = F.transform("spans", lambda s: s["claim_type"])
    small = let(
        types,
        lambda kinds: F.transform(
            first_hits(hits),
            lambda x: F.struct(
                x["l"].alias("word_idx"),
                x["r"].alias("claim_id"),
                F.get(kinds, x["r"]).alias("claim_type"),
            ),
        ),
    )
    return with_words(rows).select("message_id", F.inline(small))


def first_hits(hits: Column) -> Column:
    """Of sorted (l, r) pairs, the first per l."""
    return let(
        F.sort_array(hits),
        lambda xs: F.filter(
            xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["l"] != x["l"])
        ),
    )


# ---------------------------------------------------------------- review


def apply_review(spans: DataFrame, decisions: DataFrame, move_end: bool = True) -> DataFrame:
    """Apply review decisions: reject drops, edits replace text or type.

    With ``move_end`` an edited text sets ``end = start + length``; the
    identity reviewer keeps the bounds (``move_end=False``).
    ``result_count`` is the number of spans the message keeps.
    """
    d = decisions.select(
        "message_id", "claim_id", "action", "new_text", "new_type"
    )
    kept = spans.join(d, ["message_id", "claim_id"], "left").where(
        ~F.col("action").eqNullSafe(F.lit("reject"))
    )
    text = F.coalesce("new_text", "text")
    end = F.col("end")
    if move_end:
        end = F.when(
            F.col("new_text").isNotNull(), F.col("start") + F.length("new_text")
        ).otherwise(end)
    edited = kept.select(
        "message_id",
        "claim_id",
        F.coalesce("new_type", "claim_type").alias("claim_type"),
        text.alias("text"),
        "start",
        end.alias("end"),
    )
    of_message = Window.partitionBy("message_id")
    return edited.withColumn("result_count", F.count("*").over(of_message))


def review_summary(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    d = spans.select("message_id", "claim_id").join(decisions, ["message_id", "claim_id"])
    rejected = F.col("action") == "reject"
    return d.agg(
        F.count_if(rejected).alias("removed"),
        F.count_if(~rejected & F.col("new_text").isNotNull()).alias("edited"),
        F.count_if(~rejected & F.col("new_type").isNotNull()).alias("type_changed"),
    )


# ---------------------------------------------------------------- responses


def attach_responses(responses: DataFrame, metadata: DataFrame) -> DataFrame:
    """Responses with their request's metadata; failed or unknown ones drop."""
    failed = F.coalesce(F.length("error") > 0, F.lit(False))
    return responses.where(~failed).drop("error").join(metadata, "custom_id")


def schema_dimension_join(spans: DataFrame) -> DataFrame:
    """One row per span and slot of its type (OTHER_CLAIM's when unknown)."""
    dim = slot_dimension(spans.sparkSession).select(
        F.col("claim_type").alias("_type"), "pos", "slot", "value_type"
    )
    return (
        spans.withColumn("_type", schema_type(F.col("claim_type")))
        .join(F.broadcast(dim), "_type")
        .drop("_type")
    )


def unknown_slots(parsed: DataFrame) -> DataFrame:
    """Slot names a claim's schema does not have; valid when there are none."""
    unknown = F.sort_array(F.array_except(F.map_keys("slots"), slot_names(F.col("claim_type"))))
    return parsed.select(
        "message_id",
        "claim_id",
        "claim_type",
        (F.size(unknown) == 0).alias("valid"),
        unknown.alias("unknown"),
    )
