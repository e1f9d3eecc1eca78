"""The most frequent values of each group, exact, without a shuffle of all distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

#: Values that the mergeable summary of a group tracks; fixes its size.
TRACKED = 1 << 12
#: Cells of each of the two hash counts of a group.
CELLS = 1 << 14
#: Rows of the tables of proposed values and of kept cells that may be broadcast.
BROADCAST_ROWS = 1 << 20


def top_values(
    df: DataFrame, keys: list[str], value: str, k: int, tracked: int = TRACKED, cells: int = CELLS
) -> DataFrame:
    """The ``k`` most frequent values per group: keys, value, ``n``, ``rank`` (ties by value).

    A mergeable frequent-items summary per group proposes up to ``k`` values; their exact
    counts give a bound that the k-th value reaches.  Two hash counts of fixed size bound
    every value from above, and only values that may reach the bound are shuffled and
    counted.  The summary decides how much is left out, never the result: where it proposes
    fewer than ``k`` values (all about equally rare) everything is counted.
    NULL is a group and a value like any other.
    """
    own = keys or ["_all"]
    source = df.select(*[F.col(c) if keys else F.lit(0).alias(c) for c in own], F.col(value).alias("_v"))
    rows = stage(source.withColumn("_s", F.col("_v").cast("string")), "frequent")

    def beside(left: DataFrame, right: DataFrame, on: list[str], how: str, small: bool = False) -> DataFrame:
        """Join on columns of the same names, NULL with NULL; the right one's are dropped."""
        theirs = right.select(*[F.col(c).alias(f"{c}_right" if c in on else c) for c in right.columns])
        test = F.lit(True)
        for c in on:
            test = test & F.col(c).eqNullSafe(F.col(f"{c}_right"))
        return left.join(F.broadcast(theirs) if small else theirs, test, how).drop(*[f"{c}_right" for c in on])

    proposed = rows.where(F.col("_s").isNotNull()).groupBy(*own).agg(
        F.expr(f"approx_top_k(_s, {int(k)}, {int(tracked)})").alias("_t")
    )
    proposed = stage(proposed.select(*own, F.explode("_t.item").alias("_s")), "frequent_proposed")
    few = proposed.count() <= BROADCAST_ROWS
    recounted = beside(rows, proposed, [*own, "_s"], "left_semi", few).groupBy(*own, "_v").agg(F.count("*").alias("_n"))
    kth = F.get(F.sort_array(F.collect_list("_n"), asc=False), F.lit(k - 1))
    bounds = recounted.groupBy(*own).agg(F.coalesce(kth, F.lit(1)).alias("_least"))

    marked = rows.withColumns(
        {
            "_a": F.pmod(F.xxhash64("_v"), F.lit(cells)).cast("int"),
            "_b": F.pmod(F.xxhash64(F.lit("b"), "_v"), F.lit(cells)).cast("int") + cells,
        }
    )
    counted = marked.select(*own, F.explode(F.array("_a", "_b")).alias("_c")).groupBy(*own, "_c").agg(F.count("*").alias("_n"))
    kept = beside(counted, bounds, own, "left").where(F.col("_n") >= F.coalesce("_least", F.lit(1)))
    kept = stage(kept.select(*own, "_c"), "frequent_cells")
    small = kept.count() <= BROADCAST_ROWS

    left = marked
    for cell in ("_a", "_b"):
        left = beside(left, kept.withColumnRenamed("_c", cell), [*own, cell], "left_semi", small)
    order = Window.partitionBy(*own).orderBy(F.col("n").desc(), "_v")
    counts = left.groupBy(*own, "_v").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(*keys, F.col("_v").alias(value), "n", "rank")
