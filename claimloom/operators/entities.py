"""Rule-based entities and the claims they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pin
from ..functions.constants import ENTITY_CLAIMS, URGENCY_CONFIDENCE
from ..functions.text import ENTITY_PATTERNS, pattern_matches, urgency_keyword


def entity_array(text: Column) -> Column:
    """array<struct<entity_type, start, end, text>> over all patterns."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(
            pattern_matches(text, pattern),
            lambda m: F.struct(
                F.lit(kind).alias("entity_type"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["text"].alias("text"),
            ),
        )

    return F.concat(*[of(kind, pattern) for kind, pattern in ENTITY_PATTERNS.items()])


def pattern_entities(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per entity, with code-point offsets; e-mail, URL, phone,
    amount, date and account patterns, no model needed."""
    return messages.select(*keep, F.explode(entity_array(F.col("text"))).alias("e")).select(
        *keep, "e.*", F.lit(1.0).alias("confidence")
    )


def _lookup(position: int) -> Column:
    cells = []
    for kind, row in ENTITY_CLAIMS.items():
        cells += [F.lit(kind), F.lit(row[position])]
    return F.create_map(*cells)


def entity_claims(entities: DataFrame, *keep: str) -> DataFrame:
    """Claims of entity rows; types that support no claim give none."""
    kind = F.col("entity_type")
    prefix = F.try_element_at(_lookup(1), kind)
    shown = F.try_element_at(_lookup(2), kind)
    return entities.where(kind.isin(list(ENTITY_CLAIMS))).select(
        *keep,
        F.try_element_at(_lookup(0), kind).alias("claim_type"),
        "text",
        F.concat(prefix, F.when(shown, F.col("text")).otherwise("")).alias("evidence"),
        "confidence",
    )


def urgency_claims(messages: DataFrame, *keep: str) -> DataFrame:
    hit = pin(messages, *keep, found=urgency_keyword(F.col("text"))).withColumnRenamed("found", "text")
    return hit.where(F.col("text").isNotNull()).select(
        *keep,
        F.lit("URGENCY_CLAIM").alias("claim_type"),
        "text",
        F.concat(F.lit("Uses urgency language: '"), "text", F.lit("'")).alias("evidence"),
        F.lit(URGENCY_CONFIDENCE).alias("confidence"),
    )


def entities_to_claims(messages: DataFrame, entities: DataFrame, *keep: str) -> DataFrame:
    return entity_claims(entities, *keep).unionByName(urgency_claims(messages, *keep))


def claim_scan(messages: DataFrame, *keep: str) -> DataFrame:
    """Claims straight from the text, in one pass over the messages."""
    kind = "e.entity_type"
    urgent = urgency_keyword(F.col("text"))
    extra = F.when(
        urgent.isNotNull(),
        F.array(
            F.struct(
                F.lit("URGENCY").alias("entity_type"),
                F.lit(0).alias("start"),
                F.lit(0).alias("end"),
                urgent.alias("text"),
            )
        ),
    )
    both = F.array_compact(F.concat(entity_array(F.col("text")), F.coalesce(extra, F.array().cast(
        "array<struct<entity_type:string,start:int,end:int,text:string>>"))))
    rows = messages.select(*keep, F.explode(both).alias("e"))
    is_urgent = F.col(kind) == "URGENCY"
    prefix = F.try_element_at(_lookup(1), F.col(kind))
    shown = F.try_element_at(_lookup(2), F.col(kind))
    return rows.where(is_urgent | F.col(kind).isin(list(ENTITY_CLAIMS))).select(
        *keep,
        F.when(is_urgent, F.lit("URGENCY_CLAIM")).otherwise(F.try_element_at(_lookup(0), F.col(kind))).alias("claim_type"),
        F.col("e.text").alias("text"),
        F.when(is_urgent, F.concat(F.lit("Uses urgency language: '"), "e.text", F.lit("'")))
        .otherwise(F.concat(prefix, F.when(shown, F.col("e.text")).otherwise("")))
        .alias("evidence"),
        F.when(is_urgent, F.lit(URGENCY_CONFIDENCE)).otherwise(1.0).alias("confidence"),
    )
