"""Parsing of model output into claims and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .constants import NULL_WORDS
from .text import strip

SLOTS = "map<string,string>"
ITEM = f"array<struct<claim_id:int,canonical_form:string,slots:{SLOTS}>>"


def no_slots() -> Column:
    return F.create_map().cast(SLOTS)


def strip_code_fence(text: Column) -> Column:
    """Remove a leading ```json or ``` and a trailing ```, then trim."""

    def cut_start(t: Column, mark: str) -> Column:
        return F.when(F.startswith(t, F.lit(mark)), F.substr(t, F.lit(len(mark) + 1))).otherwise(t)

    def cut_end(t: Column, mark: str) -> Column:
        return F.when(
            F.endswith(t, F.lit(mark)), F.left(t, F.length(t) - len(mark))
        ).otherwise(t)

    return let(
        strip(text),
        lambda t: let(
            cut_start(t, "```json"),
            lambda u: let(cut_start(u, "```"), lambda w: strip(cut_end(w, "```"))),
        ),
    )


def parse_claim_list(response: Column, spans: Column) -> Column:
    """array of parsed claims, or an empty array.

    The response has to be a well-formed JSON list; ``claim_id`` counts the
    message's spans from 1 and entries out of range are dropped.
    """

    def items(clean: Column) -> Column:
        usable = F.startswith(clean, F.lit("[")) & F.try_parse_json(clean).isNotNull()
        return F.when(usable, F.from_json(clean, ITEM))

    def build(bound: Column) -> Column:
        rows = F.transform(
            let(strip_code_fence(response), items),
            lambda it: F.struct(
                F.get(bound, it["claim_id"] - 1).alias("span"),
                F.coalesce(it["canonical_form"], F.lit("")).alias("canonical_form"),
                F.coalesce(it["slots"], no_slots()).alias("slots"),
            ),
        )
        return F.filter(rows, lambda r: r["span"].isNotNull())

    return let(spans, build)


def parse_reannotation(response: Column) -> Column:
    """array of (text, claim_type) from a reply {"claims": [{"text", "label"}, ...]}.

    A reply that is no JSON object, or has no such list, gives an empty array;
    an absent text is empty.
    """
    schema = "struct<claims:array<struct<text:string,label:string>>>"

    def claims(clean: Column) -> Column:
        usable = F.startswith(clean, F.lit("{")) & F.try_parse_json(clean).isNotNull()
        return F.when(usable, F.from_json(clean, schema)["claims"])

    empty = F.expr("cast(array() as array<struct<text:string,label:string>>)")
    return F.transform(
        F.coalesce(let(strip_code_fence(response), claims), empty),
        lambda c: F.struct(F.coalesce(c["text"], F.lit("")).alias("text"), c["label"].alias("claim_type")),
    )


def _last_wins(keys: Column, values: Column) -> Column:
    """A map from parallel arrays; of equal keys the last one counts."""
    return let(
        keys,
        lambda ks: let(
            values,
            lambda vs: F.map_from_entries(
                F.transform(
                    F.filter(
                        F.transform(ks, lambda k, i: F.struct(k.alias("key"), F.get(vs, i).alias("value"), i.alias("i"))),
                        lambda e: ~F.exists(
                            F.slice(ks, e["i"] + 2, F.size(ks)), lambda later: later == e["key"]
                        )
                        & (e["key"] != "canonical"),
                    ),
                    lambda e: F.struct(e["key"], e["value"]),
                )
            ),
        ),
    )


def _or_null(value: Column) -> Column:
    return F.when(~F.lower(value).isin(NULL_WORDS), value)


def parse_kv_output(text: Column) -> Column:
    """struct<canonical_form, slots> from ``canonical=...; slot=value; ...``."""
    pattern = r"([\p{L}\p{N}_]+)=([^;]+)"
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: _or_null(strip(x))
    )
    canonical = strip(F.regexp_extract(text, r"canonical=([^;]+)", 1))
    return F.struct(canonical.alias("canonical_form"), _last_wins(keys, values).alias("slots"))


def parse_pipe_output(text: Column) -> Column:
    """struct<canonical_form, slots> from ``canonical: ... | slots: {json}``."""

    def build(parts: Column) -> Column:
        piped = F.size(parts) > 1
        head = F.replace(F.get(parts, F.lit(0)), F.lit("canonical:"), F.lit(""))
        tail = strip(F.replace(F.get(parts, F.lit(1)), F.lit("slots:"), F.lit("")))
        canonical = F.when(piped, strip(head)).otherwise(strip(text))
        slots = F.when(
            F.startswith(tail, F.lit("{")) & F.try_parse_json(tail).isNotNull(),
            F.from_json(tail, SLOTS),
        )
        return F.struct(
            canonical.alias("canonical_form"), F.coalesce(slots, no_slots()).alias("slots")
        )

    return let(F.split(text, r" \| ", 2), build)


def parse_spot(response: Column) -> Column:
    """array of SPOT claims from {"claims": [...]}, a list, or one object."""

    def text_at(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def build(v: Column) -> Column:
        listed = F.coalesce(
            F.try_variant_get(v, "$.claims", "array<variant>"),
            F.try_variant_get(v, "$", "array<variant>"),
            F.when(v.isNotNull(), F.array(v)),
        )
        return F.transform(
            listed,
            lambda c: F.struct(
                text_at(c, "$.claim_type").alias("claim_type"),
                text_at(c, "$.original_text").alias("original_text"),
                text_at(c, "$.spot.subject").alias("subject"),
                text_at(c, "$.spot.predicate").alias("predicate"),
                text_at(c, "$.spot.object").alias("object"),
                text_at(c, "$.spot.time").alias("time"),
                text_at(c, "$.verification_question").alias("verification_question"),
            ),
        )

    return let(F.try_parse_json(response), build)
