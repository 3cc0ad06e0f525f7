"""Caches as bucketed, sorted tables: what is kept by the same key is joined where it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.select import few_enough


def write_cache(df: DataFrame, table: str, key: str = "frame_key", buckets: int = 64, path: str | None = None) -> DataFrame:
    """The table under a name of the catalog, in buckets of the key and sorted by it; one file per bucket. path: a folder of its own, else the warehouse.

    Tables of one key and number of buckets join and aggregate by it without an exchange.
    """
    out = df.repartition(buckets, key).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key).mode("errorifexists")
    (out.option("path", path) if path else out).saveAsTable(table)
    return df.sparkSession.table(table)


def _first(df: DataFrame, key: str) -> str | None:
    row = df.select(key).first()
    return None if row is None else row[0]


def align(spark: SparkSession, index: str, cache: str, key: str = "frame_key") -> DataFrame:
    """Rows of an index table with those of a cache table. Both must hold the same keys, once each; else an error names one that is not.

    Three anti joins and counts by bucket check it; nothing is exchanged if both are written by write_cache with as many buckets.
    """
    a, b = spark.table(index), spark.table(cache)
    for rows, name in ((a, index), (b, cache)):
        if not few_enough(rows.where(F.col(key).isNull()), 0):
            raise ValueError(f"{name} has rows without a {key}")
        twice = rows.groupBy(key).count().where("count > 1")
        if not few_enough(twice, 0):
            raise ValueError(f"{name} has {key} {_first(twice, key)!r} more than once")
    for rows, other, name in ((a, b, cache), (b, a, index)):
        lost = rows.join(other, key, "left_anti")
        if not few_enough(lost, 0):
            raise ValueError(f"{name} lacks {key} {_first(lost, key)!r}")
    return a.join(b, key)
