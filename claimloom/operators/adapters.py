"""Where a caller's own model plugs in.

A parser takes rows (message_id, message_label, message, claim_id, claim_type,
text, start, end) and returns parsed claims.  Anything with that shape works
with ``DataFrame.transform``; a model is wrapped by ``model_parser``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.annotations import PARSED_SCHEMA


class ClaimParser(Protocol):
    def __call__(self, claims: DataFrame) -> DataFrame: ...


PARSERS: dict[str, ClaimParser] = {}


def model_parser(predict: Callable[[pd.DataFrame], pd.DataFrame]) -> ClaimParser:
    """Run ``predict`` on Arrow batches inside the tasks.

    ``predict`` gets a batch of input rows and returns canonical_form and
    slots (a dict) for each, in the same order.
    """

    def parse(claims: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = predict(batch)
                yield pd.DataFrame(
                    {
                        "message_id": batch["message_id"].to_numpy(),
                        "message_label": batch["message_label"].to_numpy(),
                        "claim_id": batch["claim_id"].to_numpy(),
                        "claim_type": batch["claim_type"].to_numpy(),
                        "canonical_form": out["canonical_form"].to_numpy(),
                        "slots": list(out["slots"]),
                        "claim_text": batch["text"].to_numpy(),
                    }
                )

        return claims.mapInPandas(run, PARSED_SCHEMA)

    return parse


def register_parser(name: str, parser: ClaimParser) -> None:
    PARSERS[name] = parser


def predict_batch(name: str, claims: DataFrame) -> DataFrame:
    """Parse with the parser registered under ``name``."""
    if name not in PARSERS:
        raise ValueError(f"unknown parser {name}; known: {sorted(PARSERS)}")
    return claims.transform(PARSERS[name])


def parser_input(rows: DataFrame) -> DataFrame:
    """Parser input from message rows with a ``spans`` array."""
    return rows.select(
        "message_id",
        F.col("label").alias("message_label"),
        F.col("text").alias("message"),
        F.posexplode("spans").alias("claim_id", "s"),
    ).select(
        "message_id",
        "message_label",
        "message",
        "claim_id",
        F.col("s.claim_type").alias("claim_type"),
        F.col("s.text").alias("text"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
    )
