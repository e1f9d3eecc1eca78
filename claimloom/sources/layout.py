"""Tables laid out on disk so that later reads skip files or shuffles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Id ranges of a layout, and sampled ids for each range's end.
RANGES = 64
SAMPLED = 100
ROWS_PER_FILE = 1 << 20


def _range_of(key: Column, ends: list[str]) -> Column:
    """Number of range ends at or below the key; a NULL key belongs to the first range."""
    known = F.array(*[F.lit(e) for e in ends]) if ends else F.array().cast("array<string>")
    return F.size(F.filter(known, lambda end: end <= key))


class SplitLayout:
    """Rows in folders by split and id range.

    A read of one split lists that split's folders only, and a read by ids only the ranges
    that hold one of them.  Range ends are taken from a sample of ``SAMPLED`` ids a range
    (smallest hashes), which decides how even the ranges are and nothing else.  Rows of one
    folder are dealt over files of about ``rows_per_file`` rows, so a split or range with a third of
    all rows is written by many tasks.  Ids are compared as strings.
    """

    def __init__(self, spark: SparkSession, path: str, schema, ends: list[str], key: str):
        self.spark, self.path, self.schema, self.ends, self.key = spark, path, schema, ends, key

    @classmethod
    def write(
        cls,
        df: DataFrame,
        path: str,
        key: str = "message_id",
        split: str = "split",
        ranges: int = RANGES,
        rows_per_file: int = ROWS_PER_FILE,
    ) -> SplitLayout:
        spark = df.sparkSession
        ids = df.select(F.col(key).cast("string").alias("id")).where(F.col("id").isNotNull())
        drawn = ids.orderBy(F.xxhash64("id"), "id").limit(ranges * SAMPLED)
        known = sorted(r.id for r in drawn.collect())
        ends = sorted({known[i * len(known) // ranges] for i in range(1, ranges)}) if known else []
        files = max(1, -(-df.count() // (ranges * rows_per_file)))
        placed = df.withColumn("id_range", _range_of(F.col(key).cast("string"), ends))
        salt = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
        dealt = placed.repartition(F.col(split), F.col("id_range"), salt)
        dealt.write.option("maxRecordsPerFile", 2 * rows_per_file).partitionBy(split, "id_range").parquet(path)
        return cls(spark, path, placed.schema, ends, key)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def split(self, name: str, column: str = "split") -> DataFrame:
        """Rows of one split; other splits' files are not opened."""
        return self.rows().where(F.col(column) == name).drop("id_range")

    def by_ids(self, ids: DataFrame, key: str | None = None) -> DataFrame:
        """Rows whose id is among ``ids``; only the files of their ranges are opened.

        The driver sees the numbers of the ranges (at most ``ranges``), not the ids.
        """
        wanted = ids.select(F.col(key or self.key).cast("string").alias("_id")).where(F.col("_id").isNotNull())
        hit = [r.r for r in wanted.select(_range_of(F.col("_id"), self.ends).alias("r")).distinct().collect()]
        some = self.rows().where(F.col("id_range").isin(hit))
        same = some[self.key].cast("string") == wanted["_id"]
        return some.join(wanted, same, "left_semi").drop("id_range")


def write_bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The rows as a table bucketed and sorted by ``keys``, read back.

    Joins and groupings on exactly these keys of tables with equal ``buckets`` need no
    exchange.  Take the buckets so that one fits a task; reduce repeated keys first, because
    a key's rows share a bucket.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch_dir(spark, name)).saveAsTable(name)
    return spark.table(name)
