"""Bootstrap by replicate vectors: a partial aggregate whose state is a vector of sums, one for each resample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The distribution function of Poisson(1) times 2^32, for 0 to 6 draws of a row.
POISSON = (1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778)
#: The constants of the 64-bit finaliser of the counter generator.
GOLDEN, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BLOCK = 128


def key_digest(seed: int, key: Column | str) -> Column:
    """60 bits of the md5 of seed and key, as a long."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def draws(digests: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row is drawn in each resample (rows, resamples): the counter r of a row's digest gives 32 bits, and these a Poisson(1) number."""
    with np.errstate(over="ignore"):
        z = digests.astype(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
        u = (z ^ (z >> np.uint64(31))) >> np.uint64(32)
    n = np.zeros(u.shape, np.int8)
    for step in POISSON:
        n += u >= np.uint64(step)
    return n


def replicate_sums(df: DataFrame, digest: str, value: str, resamples: int) -> DataFrame:
    """(r, s, w): per resample the drawn sum of values and number of rows; r = -1 holds the plain ones.

    A task keeps two vectors and returns them once, so a shuffle has a row for each task and resample,
    whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w = np.zeros(resamples + 1), np.zeros(resamples + 1, np.int64)
        for batch in batches:
            h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(h), _BLOCK):
                n = draws(h[lo : lo + _BLOCK], resamples)
                s[1:] += d[lo : lo + _BLOCK] @ n
                w[1:] += n.sum(axis=0, dtype=np.int64)
            s[0] += d.sum()
            w[0] += len(d)
        if w[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, resamples)), pa.array(s), pa.array(w)], names=["r", "s", "w"])

    parts = df.select(F.col(digest).alias("h"), F.col(value).cast("double").alias("d")).mapInArrow(run, "r long, s double, w long")
    return parts.groupBy("r").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Mean difference a - b with its 2.5 and 97.5 percentiles over resamples, and the share of them above zero.

    Poisson(1) weights per row and resample stand for the draws with replacement. They come from a
    counter generator over the digest of seed and key, so that rows never have to be numbered, joined
    back or repeated. Rows with a missing side don't count; without any there is one row of NULLs and n = 0.
    """
    d = (F.col(a) - F.col(b)).cast("double")
    rows = pairs.select(key_digest(seed, key).alias("h"), d.alias("d")).where(F.col("h").isNotNull() & F.col("d").isNotNull() & ~F.isnan("d"))
    sums = replicate_sums(rows, "h", "d", resamples).withColumn("m", F.try_divide("s", F.col("w").cast("double")))
    drawn = F.col("r") >= 0
    found = sums.agg(
        F.max(F.when(~drawn, F.col("m"))).alias("mean_diff"), F.coalesce(F.max(F.when(~drawn, F.col("w"))), F.lit(0)).alias("n"),
        F.percentile(F.when(drawn, F.col("m")), F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.avg(F.when(drawn, (F.col("m") > 0).cast("double"))).alias("share_above"),
    )
    return found.select("mean_diff", "n", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "share_above")
