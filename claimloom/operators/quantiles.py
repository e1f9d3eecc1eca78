"""Exact quantiles that do not gather a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, unstage

CELLS = 128
#: Distinct values of one cell that a task may order; larger cells are cut again.
CELL_ROWS = 1 << 16
#: Distinct values that one salted key of a cut may meet, on average.
SALT_ROWS = 1 << 20


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per key group with one column per entry of ``probs``.

    Interpolates linearly between neighbouring ranks.  Equal values are counted before
    any shuffle of rows.  Then the wanted ranks are narrowed down in rounds: a bounded
    sketch of its distinct values cuts every cell (at first a whole group) into ``CELLS``
    of about equal size, exact counts tell which of them hold wanted ranks, and only those
    go on, until none has more than ``cell_rows`` values.  These are ordered.  The sketch
    decides only where cells end, never the result.
    Groups without a non-NULL value, and a NULL key, give no row.
    """
    own = keys or ["_all"]
    source = df.where(F.col(value).isNotNull())
    counted = source.groupBy(*[F.col(k) if keys else F.lit(0).alias(k) for k in own], F.col(value).alias("_v"))
    rows = stage(counted.agg(F.count("*").alias("_n")), "values").withColumn("_path", F.lit(""))
    salts = -(-rows.count() // SALT_ROWS)
    place = [*own, "_path"]

    # wanted ranks (0-based): the two neighbours of p * (n - 1)
    def rank(p: float, up: bool) -> Column:
        at = F.lit(p) * (F.col("_total") - 1)
        return (F.ceil(at) if up else F.floor(at)).cast("long")

    ranks = [
        F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), rank(p, up).alias("rank"))
        for name, p in probs.items()
        for up in (False, True)
    ]
    totals = rows.groupBy(*own).agg(F.sum("_n").alias("_total"))
    wanted = totals.select(
        *own, "_total", F.explode(F.array(*ranks)).alias("_w"), F.lit("").alias("_path"), F.lit(0).cast("long").alias("_before")
    )
    done: list[DataFrame] = []
    while True:
        largest = rows.groupBy(*place).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= cell_rows:
            break
        ends = [i / CELLS for i in range(1, CELLS)]
        bounds = rows.groupBy(*place).agg(F.percentile_approx("_v", ends, 10000).alias("_ends"))
        dealt = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int")
        cell = F.size(F.filter("_ends", lambda end: end <= F.col("_v")))
        celled = rows.withColumn("_salt", salt).join(dealt, [*place, "_salt"]).withColumn("_cell", cell).drop("_ends", "_salt")
        celled = stage(celled, "celled")
        earlier = Window.partitionBy(*place).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = celled.groupBy(*place, "_cell").agg(F.sum("_n").alias("_in"))
        cells = cells.withColumn("_start", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
        at = F.col("_w.rank") - F.col("_before")
        hit = wanted.join(cells, place).where((at >= F.col("_start")) & (at < F.col("_start") + F.col("_in")))
        path = F.concat("_path", F.col("_cell").cast("string"), F.lit("."))
        wanted = stage(
            hit.select(*own, "_total", "_w", (F.col("_before") + F.col("_start")).alias("_before"), path.alias("_path")), "wanted"
        )
        rows = stage(celled.withColumn("_path", path).drop("_cell").join(wanted.select(*place).distinct(), place, "left_semi"), "values")
        unstage(celled, *done)
        done = [rows, wanted]

    inside = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    lists = wanted.groupBy(*place, "_before").agg(F.collect_list("_w").alias("_ws"), F.max("_total").alias("_total"))
    ranked = (
        rows.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(lists, place)
        .withColumn("_from", F.col("_before") + F.col("_first"))
        .withColumn("_w", F.explode("_ws"))
        .where((F.col("_w.rank") >= F.col("_from")) & (F.col("_w.rank") < F.col("_from") + F.col("_n")))
    )

    def interpolated(name: str, p: float) -> Column:
        is_name = F.col("_w.name") == name
        low = F.max(F.when(is_name & ~F.col("_w.up"), F.col("_v").cast("double")))
        high = F.max(F.when(is_name & F.col("_w.up"), F.col("_v").cast("double")))
        at = F.lit(p) * (F.max("_total") - 1)
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return ranked.groupBy(*own).agg(*[interpolated(n, p) for n, p in probs.items()]).drop(*(() if keys else own))
