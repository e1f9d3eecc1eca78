"""Annotation documents: reading, flattening, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import json_ranges

VALUE = "struct<start:int,end:int,text:string,labels:array<string>>"
RESULT = f"array<struct<value:{VALUE}>>"
META = (
    "struct<label:string,split:string,is_augmented:boolean,source:string,"
    "augmentation_type:string,original_text:string,claim_types:array<string>>"
)
ANNOTATION_SCHEMA = (
    f"id string, data struct<text:string>, annotations array<struct<result:{RESULT}>>, meta {META}"
)
PARSED_SCHEMA = (
    "message_id string, message_label string, claim_id int, claim_type string, "
    "canonical_form string, slots map<string,string>, claim_text string"
)


def read_annotations(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Annotation documents with a fixed schema; absent fields become NULL.

    JSON lines by default; ``one_array`` reads files that hold JSON arrays, in ranges.  A
    missing path is an error.
    """
    if one_array:
        return json_ranges.read(spark, path, ANNOTATION_SCHEMA)
    return spark.read.schema(ANNOTATION_SCHEMA).json(path)


def read_parsed_claims(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Parsed claims; slots default to an empty map, extra fields are ignored."""
    raw = json_ranges.read(spark, path, PARSED_SCHEMA) if one_array else spark.read.schema(PARSED_SCHEMA).json(path)
    empty = F.create_map().cast("map<string,string>")
    return raw.withColumn("slots", F.coalesce("slots", empty))


def flatten_messages(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("id", F.lit("")).alias("message_id"),
        F.coalesce("data.text", F.lit("")).alias("text"),
        F.col("meta.label").alias("label"),
        F.col("meta.split").alias("split"),
    )


def first_result(docs: DataFrame) -> Column:
    """The result list of the first annotation; NULL when there is none."""
    return F.get("annotations", F.lit(0))["result"]


def explode_spans(docs: DataFrame) -> DataFrame:
    """One row per labelled result of the first annotation.

    ``claim_id`` is the position in the result list before entries without
    labels are dropped, so gaps can occur.
    """
    rows = docs.select(
        F.coalesce("id", F.lit("")).alias("message_id"),
        F.col("meta.label").alias("message_label"),
        F.posexplode(first_result(docs)).alias("claim_id", "r"),
    ).where(F.size("r.value.labels") > 0)
    value = F.col("r.value")
    return rows.select(
        "message_id",
        "message_label",
        "claim_id",
        F.get(value["labels"], F.lit(0)).alias("claim_type"),
        F.coalesce(value["text"], F.lit("")).alias("text"),
        F.coalesce(value["start"], F.lit(0)).alias("start"),
        F.coalesce(value["end"], F.lit(0)).alias("end"),
        F.lit(None).cast("double").alias("confidence"),
    )


def task_document(messages: DataFrame, id_column: str, source: str) -> DataFrame:
    """Ham messages as annotation documents with an empty result list."""
    return messages.select(
        F.col(id_column).cast("string").alias("id"),
        F.struct(F.col("text")).alias("data"),
        F.array(F.struct(F.array().cast(RESULT).alias("result"))).alias("annotations"),
        F.struct(
            F.lit("ham").alias("label"),
            F.lit(None).cast("string").alias("split"),
            F.lit(False).alias("is_augmented"),
            F.lit(source).alias("source"),
            F.lit(None).cast("string").alias("augmentation_type"),
            F.lit(None).cast("string").alias("original_text"),
            F.lit(None).cast("array<string>").alias("claim_types"),
        ).alias("meta"),
    )


def write_annotations(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)
