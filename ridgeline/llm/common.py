"""Shared helpers: a work folder every executor sees, staged tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, where the session leaves Spark's default of 10,000; Spark bounds its bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI below spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    path = work_dir(session(df), what)
    df.write.parquet(path)
    return session(df).read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        store.delete_dir(root)


def numbered(df: DataFrame, name: str, what: str) -> DataFrame:
    """The table with a unique number for each row, the same at every evaluation.

    Rows of a table as it was read from files have their place: the file's number in the upper 23 bits,
    the row's in the lower 40. Any other table is written to the shared folder.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return _placed(df, name)
        except AnalysisException:  # not from files
            pass
    return staged(df.withColumn(name, F.monotonically_increasing_id()), what)


def _placed(df: DataFrame, name: str) -> DataFrame:
    (key,) = columns_free_of(df, "_file")
    place = df.select("*", F.xxhash64("_metadata.file_path").alias(key), F.col("_metadata.row_index").alias(name))
    files = df.select(F.xxhash64("_metadata.file_path").alias(key), F.col("_metadata.file_path").alias("path")).distinct()
    files = files.groupBy(key).agg(F.count("*").alias("n")).orderBy(key).toArrow()  # 16 bytes for each file
    if len(files) >= 1 << 23 or any(n > 1 for n in files.column("n").to_pylist()):
        raise ValueError("too many files, or two whose paths have one hash: write the table anew")
    numbers = session(df).createDataFrame(pa.table({key: files.column(key), "_number": pa.array(range(len(files)), pa.int64())}))
    if len(files) <= 1_000_000:
        numbers = F.broadcast(numbers)
    packed = F.shiftleft("_number", 40).bitwiseOR(F.col(name))
    return place.join(numbers, key).withColumn(name, packed).select(*[F.col(f"`{c}`") for c in df.columns], name)


def columns_free_of(df: DataFrame, *names: str) -> list[str]:
    """Fresh column names that clash with none of the table's, in the order asked."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        fresh = name
        while fresh.lower() in taken:
            fresh = f"_{fresh}"
        taken.add(fresh.lower())
        out.append(fresh)
    return out


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    if len(keys):
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by a long column: tables that hold whole groups, several small ones together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        last = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] <= keys[-1] else 0
        if last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


class Forest:
    """Union-find over 0..n-1 that keeps the smaller root and remembers which unions joined something."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star steps.

    Returns (node, component): each node that has an edge, and the smallest node it reaches.
    Loops and repeated edges are ignored; an empty edge list gives an empty table. Each step is
    two aggregations to a minimum and two joins with it; every round is a table in the shared
    folder, so that lineage stays short. A node with very many edges meets one row in each join.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large-star")
        discard(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = staged(small.distinct(), "small-star")
        discard(large)
        before, seen = seen, mark(now)
        if before == seen:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def few_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def hint(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of narrow rows if it is that short, else leave the join to Spark."""
    return F.broadcast(df) if few_enough(df, rows) else df


def join_skewed(rows: DataFrame, right: DataFrame, on: list[str], copies: str, hot: int = 100_000) -> DataFrame:
    """Inner join with a table of one row per key that knows, in ``copies``, how many rows have the key.

    Keys of more than ``hot`` rows, of which there are no more than rows / hot, are broadcast, so that
    no task gets a third of all rows; the others meet by shuffle.
    """
    many, few = right.where(F.col(copies) > hot).drop(copies), right.where(F.col(copies) <= hot).drop(copies)
    rest = rows.join(F.broadcast(many.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(many), on).unionByName(rest.join(few, on))


def ascii_lower(col: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())
