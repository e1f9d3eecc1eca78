"""Imports every query module, so the registry is complete."""

from . import (  # noqa: F401
    dataset,
    evaluation,
    quality_checks,
    sampling_queries,
    stream_queries,
    tagging,
    text_queries,
)
from .registry import ORACLES, QUERIES, full_sql  # noqa: F401
