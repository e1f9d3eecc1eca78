"""Comparing stored experiment results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import safe_ratio
from ..functions.text import strip
from .quantiles import exact_quantiles

# Where result files keep their scores, first match wins.
DETECTION_PATHS = ["$.test_metrics.end_to_end_phishing_detection", "$.test_metrics.in_distribution_performance"]
TIME_PATHS = [
    "$.test_metrics.inference_time_ms",
    "$.test_metrics.inference_pipeline.total_time_ms",
    "$.test_metrics.inference_efficiency.encoding_time_ms",
]
SCORES = ["f1", "precision", "recall", "accuracy"]


def _number(path: str) -> Column:
    return F.try_variant_get("result", path, "double")


def _first(paths: list[str]) -> Column:
    return F.coalesce(*[_number(p) for p in paths])


def extract_metrics(experiments: DataFrame) -> DataFrame:
    """One flat row per result tree (``experiment``, VARIANT ``result``)."""

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get("result", path, "string"), F.lit("Unknown"))

    def score(name: str) -> Column:
        return _first([f"$.test_metrics.eval_{name}", *[f"{p}.{name}" for p in DETECTION_PATHS]])

    def cell(name: str) -> Column:
        return _first([f"{p}.confusion_matrix.{name}" for p in DETECTION_PATHS]).cast("long")

    return experiments.select(
        "experiment",
        text("$.config.name").alias("name"),
        text("$.config.approach").alias("approach"),
        *[score(s).alias(s) for s in SCORES],
        _number("$.test_metrics.test_loss").alias("loss"),
        *[
            cell(long).alias(short)
            for short, long in (
                ("tp", "true_positive"), ("fp", "false_positive"),
                ("tn", "true_negative"), ("fn", "false_negative"),
            )
        ],
    )


def model_ranking(experiments: DataFrame) -> DataFrame:
    """Scored models by F1 descending, then loss-only ones by loss."""
    m = extract_metrics(experiments)
    rates = m.withColumns(
        {
            "fpr": F.when(F.col("fp").isNotNull(), safe_ratio(F.col("fp"), F.col("fp") + F.col("tn"))),
            "fnr": F.when(F.col("fn").isNotNull(), safe_ratio(F.col("fn"), F.col("fn") + F.col("tp"))),
        }
    )
    return rates.orderBy(F.col("f1").desc_nulls_last(), F.col("loss").asc_nulls_last(), "experiment")


def best_models(experiments: DataFrame) -> DataFrame:
    """The best experiment by each score, long form."""
    scores = extract_metrics(experiments).unpivot("experiment", SCORES, "metric", "value")
    order = F.struct(F.col("value"), F.col("experiment"))
    return (
        scores.where(F.col("value").isNotNull())
        .groupBy("metric")
        .agg(F.max_by("experiment", order).alias("experiment"), F.max("value").alias("value"))
    )


def kfold_summary(folds: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation of each metric over folds."""
    return folds.groupBy(by).agg(
        F.count("*").alias("n_folds"),
        *[
            agg(m).alias(f"{m}_{name}")
            for m in metrics
            for name, agg in (("mean", F.avg), ("std", F.stddev_pop))
        ],
    )


def latency_profile(samples: DataFrame, model: str, millis: str) -> DataFrame:
    """Mean and exact P50/P95/P99 per model, fastest first."""
    means = samples.groupBy(model).agg(F.avg(millis).alias("mean"), F.count(millis).alias("n"))
    q = exact_quantiles(samples, [model], millis, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return means.join(q, model).orderBy("mean", model)


def latency_stored(experiments: DataFrame) -> DataFrame:
    """Latency numbers kept in result trees, whatever their shape."""
    total = _number("$.test_metrics.inference_efficiency.total_inference_ms")
    picked = experiments.select(
        "experiment",
        F.coalesce(total, _first([f"{p}.mean" for p in TIME_PATHS])).alias("mean"),
        *[
            F.coalesce(_first([f"{p}.{q}" for p in TIME_PATHS]), F.lit(0.0)).alias(q)
            for q in ("p50", "p95", "p99")
        ],
    )
    return picked.where(F.col("mean").isNotNull()).orderBy("mean", "experiment")


# Cost per claim, batch discount, seconds per message.
CLAIM_COST, BATCH_CLAIM_COST, SECONDS_PER_MESSAGE = 0.01, 0.005, 0.5


def cost_estimate(spans: DataFrame) -> DataFrame:
    """Expected cost and time of labelling all spans with a remote model."""
    per_message = spans.groupBy("message_id").agg(F.count("*").alias("n"))
    c = per_message.agg(
        F.count("*").alias("messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("claims")
    )
    return c.select(
        "messages",
        "claims",
        safe_ratio(F.col("claims"), F.col("messages")).alias("claims_per_message"),
        (F.col("claims") * CLAIM_COST).alias("cost"),
        (F.col("claims") * BATCH_CLAIM_COST).alias("batch_cost"),
        (F.col("messages") * SECONDS_PER_MESSAGE).alias("seconds"),
    )


def first_inputs(messages: DataFrame, order: str, first: int | None = None) -> DataFrame:
    """All inputs, or for a demonstration the first ones in input order."""
    return messages if first is None else messages.orderBy(order).limit(first)


def ood_summary(rows: DataFrame) -> DataFrame:
    """Claim totals and type shares, long form; blank texts are skipped.

    ``rows``: text and the ``pred`` array.
    """
    head = rows.where(F.length(strip(F.col("text"))) > 0)
    n = F.size("pred")
    totals = head.agg(
        F.count("*").cast("double").alias("messages"),
        F.count_if(n > 0).cast("double").alias("with_claims"),
        F.sum(n).cast("double").alias("claims"),
    )
    means = totals.select(
        "*",
        safe_ratio(F.col("claims"), F.col("messages")).alias("mean_per_message"),
        safe_ratio(F.col("claims"), F.col("with_claims")).alias("mean_with_claims"),
    )
    long = means.unpivot([], means.columns, "item", "value")
    types = (
        head.select(F.explode("pred").alias("p")).groupBy("p.claim_type").agg(F.count("*").alias("n"))
    )
    share = types.join(F.broadcast(totals.select("claims"))).select(
        F.concat(F.lit("pct:"), "claim_type").alias("item"),
        safe_ratio(F.col("n"), F.col("claims"), 100.0).alias("value"),
    )
    return long.unionByName(share)
