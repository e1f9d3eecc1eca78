"""Training material: pairs, phases, augmentation, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import PHASE_ONE, PHASE_TWO, SLOT_SCHEMA, SUBSTITUTIONS
from ..functions.prompts import slot_aware_input, slot_aware_target
from .sampling import _histogram, hash_key, hashed


def slot_aware_pairs(messages: DataFrame, spans: DataFrame, parsed: DataFrame) -> DataFrame:
    """Input and output text per parsed claim that has a span and a message."""
    key = ["message_id", "claim_id"]
    claims = parsed.select(*key, "claim_type", "canonical_form", "slots")
    joined = claims.join(
        spans.select(*key, F.col("claim_type").alias("span_type"), F.col("text").alias("claim")), key
    ).join(messages.select("message_id", F.col("text").alias("message")), "message_id")
    known = F.col("span_type").isin(list(SLOT_SCHEMA))
    return joined.select(
        *key,
        "claim_type",
        slot_aware_input(F.col("span_type"), F.col("claim"), F.col("message"), known).alias("input"),
        slot_aware_target(F.col("canonical_form"), F.col("slots")).alias("output"),
    )


def curriculum_phases(examples: DataFrame) -> DataFrame:
    """One row per example and phase it takes part in.  Phase 1 holds the
    common types, phase 2 adds the medium ones, phase 3 is everything."""
    first = (
        F.when(F.col("claim_type").isin(PHASE_ONE), 1)
        .when(F.col("claim_type").isin(PHASE_TWO), 2)
        .otherwise(3)
    )
    return examples.withColumn("phase", F.explode(F.sequence(first, F.lit(3))))


def union_balance(phishing: DataFrame, ham: DataFrame, seed: int = 42) -> DataFrame:
    """Both sets as one, in hash order."""
    both = phishing.unionByName(ham, allowMissingColumns=True)
    return both.withColumn("shuffle_key", hash_key(seed, "id")).orderBy("shuffle_key", "id")


def _hash_int(*parts: Column) -> Column:
    """A non-negative integer from the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def augment_substitute(examples: DataFrame, factor: int = 2, seed: int = 42) -> DataFrame:
    """Examples plus n * (factor - 1) changed copies, drawn with replacement.

    Draw i takes the example of rank hash(i) mod n in hash order and swaps
    listed words in input and output; a swapped-in word can be swapped again
    by a later entry.  ``examples``: example_id (unique), input, output,
    claim_type, message_id.
    """
    _, cells = _histogram(examples, "example_id", seed, [])
    inside = Window.partitionBy("_cell").orderBy("_h", "_id")
    payload = ["input", "output", "claim_type", "message_id"]
    # the cell table has a fixed bound of 65,536 rows
    ranked = (
        hashed(examples, "example_id", seed)
        .join(F.broadcast(cells.select("_cell", "_before")), "_cell")
        .select(
            F.col("_id").alias("example_id"),
            (F.col("_before") + F.row_number().over(inside) - 1).alias("rank"),
            *payload,
        )
    )
    # one draw per rank and round, straight from the cell table, whose rows are dealt over the session's partitions
    spread = cells.repartition(int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cell")
    rounds = F.filter(F.sequence(F.lit(0), F.lit(max(factor - 2, 0))), lambda r: r < factor - 1)
    ranks = F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_in") - 1))
    draws = (
        spread.select("_n", ranks.alias("_r"))
        .select("_n", "_r", F.explode(rounds).alias("_round"))
        .select((F.col("_round") * F.col("_n") + F.col("_r")).alias("draw"), F.col("_n").alias("n"))
    )
    # there are as many draws as examples, but Spark takes them for as few as the cells and would send them all to the driver
    chosen = (
        draws.select("draw", (_hash_int(F.lit(str(seed)), F.col("draw").cast("string")) % F.col("n")).alias("rank"))
        .hint("merge")
        .join(ranked, "rank")
    )

    copies = chosen
    for word, options in SUBSTITUTIONS.items():
        index = _hash_int(F.lit(str(seed)), F.col("draw").cast("string"), F.lit(word)) % len(options)
        swap = F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))
        hit = F.contains(F.col("input"), F.lit(word))
        copies = copies.withColumn("_hit", hit).withColumn("_swap", swap)
        copies = copies.withColumns(
            {
                c: F.when(F.col("_hit"), F.replace(F.col(c), F.lit(word), F.col("_swap"))).otherwise(F.col(c))
                for c in ("input", "output")
            }
        )
    copies = copies.select(
        "example_id",
        "draw",
        "input",
        "output",
        "claim_type",
        F.concat("message_id", F.lit("_aug")).alias("message_id"),
    )
    originals = ranked.select("example_id", F.lit(None).cast("long").alias("draw"), *payload)
    return originals.unionByName(copies)
