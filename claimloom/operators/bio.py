"""BIO operators over rows that hold words, spans or token tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bio
from ..functions.claims import collapse
from ..functions.matching import resolve_overlaps
from ..functions.ratios import prf, safe_ratio
from ..functions.text import with_words


def _tagged_words(rows: DataFrame, tags: Column) -> DataFrame:
    zipped = F.arrays_zip(F.col("w").alias("word"), tags.alias("tag"))
    return rows.select("message_id", F.posexplode(zipped).alias("idx", "t")).select(
        "message_id", "idx", F.col("t.word").alias("word"), F.col("t.tag").alias("tag")
    )


def bio_encode_words(rows: DataFrame) -> DataFrame:
    """Word tags of rows with ``text`` and ``spans``."""
    return _tagged_words(
        with_words(rows), bio.bio_encode_words(F.col("w"), F.col("ws"), F.col("spans"))
    )


def model_spans(spans: Column) -> Column:
    """Spans as the model is trained on them: overlaps resolved, types collapsed."""
    return F.transform(
        resolve_overlaps(spans),
        lambda s: F.struct(s["start"], s["end"], collapse(s["claim_type"]).alias("claim_type")),
    )


def bio_encode_chars(rows: DataFrame) -> DataFrame:
    """Word tags taken from the character tag at each word's start."""
    return _tagged_words(
        with_words(rows), bio.tags_at(F.col("ws"), model_spans(F.col("spans")), ascending=True)
    )


def bio_align_tokens(rows: DataFrame) -> DataFrame:
    """Label id per token of rows with ``text``, ``spans`` and ``offsets``."""
    ids = bio.bio_align_tokens(F.col("offsets"), F.col("text"), model_spans(F.col("spans")))
    zipped = F.arrays_zip(F.col("offsets").alias("o"), ids.alias("label_id"))
    return rows.select("message_id", F.posexplode(zipped).alias("idx", "t")).select(
        "message_id",
        "idx",
        F.col("t.o.start").alias("start"),
        F.col("t.o.end").alias("end"),
        F.col("t.label_id").alias("label_id"),
    )


def bio_decode(rows: DataFrame, confidence: str = "mean") -> DataFrame:
    """Spans decoded from rows with a ``tokens`` array."""
    spans = bio.bio_decode(F.col("tokens"), confidence)
    return rows.select("message_id", F.posexplode(spans).alias("claim_id", "s")).select(
        "message_id", "claim_id", "s.*"
    )


def label_distribution(rows: DataFrame) -> DataFrame:
    """Tag counts and shares; ``claim_type`` is set on B tags only."""
    tags = bio_encode_words(rows).groupBy("tag").agg(F.count("*").alias("n"))
    total = tags.agg(F.sum("n").alias("_all"))
    return tags.join(F.broadcast(total)).select(
        "tag",
        "n",
        safe_ratio(F.col("n"), F.col("_all"), 100.0).alias("pct"),
        F.when(F.col("tag").startswith("B-"), bio.tag_type(F.col("tag"))).alias("claim_type"),
    )


def strict_entity_prf(rows: DataFrame) -> DataFrame:
    """Exact entity scores of ``true_tags`` against ``pred_tags``.

    One row per type, then micro, macro and weighted averages; token accuracy
    stands on every row.
    """
    chunked = rows.select(
        bio.entity_chunks(F.col("true_tags")).alias("t"),
        bio.entity_chunks(F.col("pred_tags")).alias("p"),
        F.size("true_tags").alias("n_tokens"),
        F.size(
            F.filter(F.zip_with("true_tags", "pred_tags", lambda a, b: a == b), lambda x: x)
        ).alias("n_equal"),
    )

    def entry(kind: Column, g: int, p: int, tp: int) -> Column:
        return F.struct(
            kind.alias("claim_type"), F.lit(g).alias("g"), F.lit(p).alias("p"), F.lit(tp).alias("tp")
        )

    entries = F.concat(
        F.transform("t", lambda c: entry(c["claim_type"], 1, 0, 0)),
        F.transform("p", lambda c: entry(c["claim_type"], 0, 1, 0)),
        F.transform(F.array_intersect("t", "p"), lambda c: entry(c["claim_type"], 0, 0, 1)),
        F.array(
            F.struct(
                F.lit(None).cast("string").alias("claim_type"),
                F.col("n_tokens").alias("g"),
                F.col("n_equal").alias("p"),
                F.lit(0).alias("tp"),
            )
        ),
    )
    sums = (
        chunked.select(F.explode(entries).alias("e"))
        .groupBy("e.claim_type")
        .agg(F.sum("e.g").alias("support"), F.sum("e.p").alias("predicted"), F.sum("e.tp").alias("tp"))
    )
    everything = Window.partitionBy()  # over one row per type
    accuracy = safe_ratio(
        F.max(F.when(F.col("claim_type").isNull(), F.col("predicted"))).over(everything),
        F.max(F.when(F.col("claim_type").isNull(), F.col("support"))).over(everything),
    )
    p, r, f1 = prf(F.col("tp"), F.col("predicted"), F.col("support"))
    by_type = (
        sums.withColumns({"precision": p, "recall": r, "f1": f1, "token_accuracy": accuracy})
        .where(F.col("claim_type").isNotNull())
    )
    total = by_type.agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("tp").alias("tp"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[
            safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")
            for c in ("precision", "recall", "f1")
        ],
        F.max("token_accuracy").alias("token_accuracy"),
    )
    mp, mr, mf = prf(F.col("tp"), F.col("predicted"), F.col("support"))
    micro = F.struct(F.lit("_micro").alias("claim_type"), mp.alias("precision"), mr.alias("recall"), mf.alias("f1"))

    def average(name: str) -> Column:
        return F.struct(
            F.lit(f"_{name}").alias("claim_type"),
            *[F.col(f"{name}_{c}").alias(c) for c in ("precision", "recall", "f1")],
        )

    averages = total.select(
        F.explode(F.array(micro, average("macro"), average("weighted"))).alias("x"),
        "support",
        "predicted",
        "tp",
        "token_accuracy",
    )
    cols = ["claim_type", "support", "predicted", "tp", "precision", "recall", "f1", "token_accuracy"]
    return by_type.select(*cols).unionByName(
        averages.select("x.*", "support", "predicted", "tp", "token_accuracy").select(*cols)
    )
