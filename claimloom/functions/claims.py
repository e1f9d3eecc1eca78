"""Claim-type helpers: collapsing rare types, slot schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import CLAIM_TYPES, OTHER_CLAIM, RARE_TYPES, SLOT_SCHEMA


def collapse(claim_type: Column) -> Column:
    return F.when(claim_type.isin(RARE_TYPES), F.lit(OTHER_CLAIM)).otherwise(claim_type)


def type_at(index: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in CLAIM_TYPES]), index.cast("int"))


def schema_type(claim_type: Column) -> Column:
    """The type whose slots apply: unknown types use OTHER_CLAIM's."""
    known = claim_type.isin(list(SLOT_SCHEMA))
    return F.when(known, claim_type).otherwise(F.lit(OTHER_CLAIM))


def _lookup(values: dict[str, Column]) -> Column:
    cells = []
    for key, value in values.items():
        cells += [F.lit(key), value]
    return F.create_map(*cells)


def slot_names(claim_type: Column) -> Column:
    table = _lookup(
        {t: F.array(*[F.lit(s[0]) for s in slots]) for t, slots in SLOT_SCHEMA.items()}
    )
    return F.try_element_at(table, schema_type(claim_type))


def schema_block(claim_type: Column) -> Column:
    """The prompt block listing a type's slots, headed by the type as given."""
    table = _lookup(
        {
            t: F.lit("".join(f"\n  - {name}: {text}" for name, text, _ in slots))
            for t, slots in SLOT_SCHEMA.items()
        }
    )
    return F.concat(
        F.lit("Slots for "), claim_type, F.lit(":"), F.try_element_at(table, schema_type(claim_type))
    )


def slot_dimension(spark: SparkSession) -> DataFrame:
    """The slot registry as a 52-row dimension."""
    rows = [
        (t, pos, name, text, kind)
        for t, slots in SLOT_SCHEMA.items()
        for pos, (name, text, kind) in enumerate(slots)
    ]
    return spark.createDataFrame(
        rows, "claim_type string, pos int, slot string, description string, value_type string"
    )


def type_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, t) for i, t in enumerate(CLAIM_TYPES)], "pos int, claim_type string"
    )
