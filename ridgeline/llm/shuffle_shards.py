"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows' origins are blocks of the running row number through the input's files in order of their
names (small files share an origin), fixed however Spark splits the scan. How many rows each origin sends to each shard is drawn first, exactly, as a multivariate
hypergeometric matrix whose column sums are the shard sizes: counts at most one apart. Each origin
permutes its rows locally and cuts the permutation by its row of the matrix; the rows are exchanged;
each shard permutes again, by a keyed permutation of its slots (a Feistel network walked into the
range), so that no shard is ever gathered in one task. All draws depend on the seed, the origins and
their counts alone, so a lost task gives the same rows again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import columns_free_of, small_batches, work_dir


@dataclass(frozen=True)
class Shuffle:
    """origin_rows: rows permuted together; max_origins bounds the matrix; slot_block: slots of one exchange key."""

    shards: int = 40
    seed: int = 20240607
    origin_rows: int = 1 << 18
    max_origins: int = 16384
    slot_block: int = 64


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows of each origin for each shard: a uniform shuffle's joint distribution, with exact shard sizes."""
    total = int(counts.sum())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts.tolist()):
        out[i] = _draw(rng, left, n)
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n of all that is left, without replacement, one shard after the other."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, own in enumerate(left.tolist()):
        if not n:
            break
        rest -= own
        k = _hypergeometric(rng, own, rest, n)
        out[s] = k
        n -= k
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # beyond the generator's range: ratio of uniforms with Stadlober's constants
    total, low, high = good + bad, max(0, n - bad), min(n, good)

    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))

    mean = n * good / total
    spread = 2 * math.sqrt(2 / math.e) * math.sqrt(mean * (bad / total) * (total - n) / max(total - 1, 1) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    top = log_weight(min(max((n + 1) * (good + 1) // (total + 2), low), high))
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + spread * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_weight(k) - top:
            return k


def permuted(x: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..size-1 for each key, at x: four Feistel rounds, walked until inside."""
    x, out = x.astype(np.uint64), np.zeros(len(x), np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = (right ^ k) + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (f ^ (f >> np.uint64(31)))) & m
        x[todo] = left << h | right
        inside = x[todo] < size[todo].astype(np.uint64)
        out[todo[inside]] = x[todo[inside]]
        todo = todo[~inside]
    return out.astype(np.int64)


def shuffle_into_shards(docs: DataFrame, opts: Shuffle = Shuffle(), scan: bool = False) -> DataFrame:
    """All rows and columns of docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Shard sizes differ by at most one. Rows come sorted by shard and slot within a partition, ready to
    be written by shard. scan says that docs is a Parquet table as it was read, whose rows have fixed
    places; any other table is written to the shared folder first. Clashing column names get a leading underscore for
    the new ones. Values play no part: nulls, repeated and very long rows are rows like others; with
    fewer rows than shards some shards are empty, and an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = columns_free_of(docs, "shard", "slot", "_origin", "_place")
    shard, slot, origin, place = names
    if not scan:
        path = work_dir(spark, "rows")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    path = F.col("_metadata.file_path")
    rows = docs.select("*", F.xxhash64(path).alias(origin), F.col("_metadata.row_index").alias(place))
    files = docs.select(F.xxhash64(path).alias(origin), path.alias("path"), F.col("_metadata.row_index").alias(place))
    files = files.groupBy(origin).agg(F.max(place).alias("last"), F.count("*").alias("n"), (F.min("path") == F.max("path")).alias("one")).orderBy(origin).toPandas()
    if (files["n"] != files["last"] + 1).any() or not files["one"].all():
        raise ValueError("not a Parquet table as it was read; call with scan=False")
    sizes = files["n"].to_numpy(np.int64)
    total, block = int(sizes.sum()), opts.origin_rows
    while -(-total // block) > opts.max_origins:
        block *= 2
    first = files[origin].to_numpy(np.int64), np.cumsum(sizes) - sizes  # of each file, in order of the paths' hashes: 16 bytes
    counts = np.full(-(-total // block), block, np.int64)
    counts[-1:] -= len(counts) * block - total
    matrix = communication_matrix(counts, opts.shards, opts.seed)
    shared = spark.sparkContext.broadcast((first, counts, np.cumsum(matrix, axis=1), np.cumsum(matrix, axis=0) - matrix, matrix.sum(axis=0)))

    @F.pandas_udf("shard int, slot long")
    def address(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        first, counts, ends, before, sizes = shared.value
        kept: dict[int, np.ndarray] = {}
        for names, index in parts:
            index = index.to_numpy() + first[1][np.searchsorted(first[0], names.to_numpy())] if len(index) else index.to_numpy()
            numbers = index // block
            to, at = np.zeros(len(index), np.int32), np.zeros(len(index), np.int64)
            for o in np.unique(numbers).tolist():
                if o not in kept:
                    kept.clear()
                    kept[o] = np.random.default_rng([opts.seed, o]).permutation(counts[o])
                own = np.flatnonzero(numbers == o)
                p = kept[o][index[own] % block]
                s = np.searchsorted(ends[o], p, side="right")
                to[own] = s
                at[own] = p - np.where(s > 0, ends[o][s - 1], 0) + before[o][s]
            key = (to.astype(np.int64) + 1) * 0x5DEECE66D + opts.seed
            yield pd.DataFrame({"shard": to, "slot": permuted(at, sizes[to], key) if len(to) else at})

    found = rows.withColumn("_at", address(origin, place)).withColumns({shard: F.col("_at.shard"), slot: F.col("_at.slot")}).drop("_at", origin, place)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = F.col(shard), (F.col(slot) / opts.slot_block).cast("long")
    return found.repartition(parts, *keys).sortWithinPartitions(shard, slot)
