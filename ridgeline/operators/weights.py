"""Sampling weights: inverse frequencies, context, objects, motion, their product, draws.

A total over all rows is one aggregated row that is broadcast back, not a window over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators import order_stats
from ridgeline.operators.select import hint


def with_total(df: DataFrame, **totals: Column) -> DataFrame:
    return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])), F.lit(True))


def normalize_mean(df: DataFrame, weight: str) -> DataFrame:
    """The weight divided by its mean; ones if the mean is not positive."""
    rows = with_total(df, _mean=F.avg(weight))
    return rows.withColumn(weight, F.when(F.col("_mean") > 0, F.col(weight) / F.col("_mean")).otherwise(1.0)).drop("_mean")


def inverse_frequency(df: DataFrame, column: str, out: str, power: float = 1.0) -> DataFrame:
    """(1 / count of the row's value) ** power; the counts are joined back, not windowed."""
    n = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    return df.join(n, F.col(column).eqNullSafe(F.col("_v"))).withColumn(out, F.pow(F.lit(1.0) / F.col("_c"), F.lit(power))).drop("_v", "_c")


def context_weight(df: DataFrame, first: str, second: str, event: Column, out: str) -> DataFrame:
    """The larger lift of two columns, (largest count / count) ** 0.3, twice it on an event, within 1 and 5."""
    rows = df
    for i, c in enumerate((first, second)):
        n = df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_c"))
        n = n.join(F.broadcast(n.agg(F.max("_c").alias("_m"))), F.lit(True)).select("_v", F.pow(F.col("_m") / F.col("_c"), F.lit(0.3)).alias(f"_l{i}"))
        rows = rows.join(n, F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    lift = F.greatest("_l0", "_l1") * F.when(event, 2.0).otherwise(1.0)
    return rows.withColumn(out, F.least(F.lit(5.0), F.greatest(F.lit(1.0), lift))).drop("_l0", "_l1")


def object_weight(n: Column) -> Column:
    """The number of objects between 1 and 4, twice it from three on."""
    return F.least(F.greatest(n, F.lit(1)), F.lit(4)) * F.when(n >= 3, 2).otherwise(1)


def mapped(column: str, factors: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for value, factor in factors.items():
        out = F.when(F.col(column) == value, factor).otherwise(out)
    return out


def combined_weight(df: DataFrame, first: str, second: str, motion: Column, minority: Column, out: str, cap: float = 8.0) -> DataFrame:
    """Product of two weights, each of mean one, divided by its mean and capped; times motion and minority factors; of mean one."""
    rows = normalize_mean(normalize_mean(df, first), second).withColumn(out, F.col(first) * F.col(second))
    rows = normalize_mean(rows, out).withColumn(out, F.least(F.col(out), F.lit(cap)) * motion * minority)
    return normalize_mean(rows, out)


def probabilities(df: DataFrame, weight: str, out: str) -> DataFrame:
    return with_total(df, _sum=F.sum(weight)).withColumn(out, F.try_divide(F.col(weight), F.col("_sum"))).drop("_sum")


def weighted_marginals(df: DataFrame, weight: str, *columns: str) -> DataFrame:
    """(field, value, share) of the weight over several columns, in one pass by grouping sets."""
    rows = df.select(F.col(weight).alias("_w"), *[F.col(c).cast("string").alias(c) for c in columns])
    k = len(columns)
    sets = rows.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.sum("_w").alias("_s"), F.grouping_id().alias("_g"))
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        here = F.col("_g") == (1 << k) - 1 - (1 << (k - 1 - i))
        field, value = F.when(here, c).otherwise(field), F.when(here, F.col(c)).otherwise(value)
    total = df.agg(F.sum(weight).alias("_t"))
    return sets.join(F.broadcast(total), F.lit(True)).select(field.alias("field"), value.alias("value"), F.try_divide(F.col("_s"), F.col("_t")).alias("share"))


def balance_factor(df: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """sqrt(median count / count) within 0.5 and 3, per value of a frequency table."""
    median = order_stats.median(df, n).withColumnRenamed("median", "_m")
    return df.join(F.broadcast(median), F.lit(True)).withColumn(out, F.least(F.lit(3.0), F.greatest(F.lit(0.5), F.sqrt(F.col("_m") / F.col(n))))).drop("_m")


def weighted_draw(df: DataFrame, key: str, weight: str, n: int, seed: int, digits: int = 3) -> DataFrame:
    """n seeded draws with replacement by weight: (draw, key).

    Rows lie in 16 ** digits buckets by the md5 of their key, each after the one before: sums per bucket
    give its start, running sums within it a row's start. A draw's uniform number is a place on that
    line; it belongs to the last row that starts at or before it, found by one window over both.
    """
    rows = df.where(F.col(weight) > 0).withColumn("_b", F.substring(F.md5(F.col(key).cast("string")), 1, digits))
    sums = rows.groupBy("_b").agg(F.sum(weight).alias("_s"))  # no more rows than buckets
    over = Window.orderBy("_b")
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    total = sums.agg(F.sum("_s").alias("_total"))
    within = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.select("_b", F.coalesce(F.sum(weight).over(within), F.lit(0.0)).alias("_at"), F.lit(0).alias("_side"), F.col(key), F.lit(None).cast("long").alias("draw"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total), F.lit(True)).withColumn("_u", u * F.col("_total"))
    bounds = starts.select(F.struct("_start", "_b").alias("x")).agg(F.sort_array(F.collect_list("x")).alias("_all"))
    # the buckets are few, so the one of a draw is found in their sorted list: the last that starts at or before it, whatever rounding did to its end
    mine = draws.join(F.broadcast(bounds), F.lit(True)).withColumn("x", F.try_element_at(F.filter("_all", lambda x: x["_start"] <= F.col("_u")), F.lit(-1)))
    placed = mine.select(F.col("x._b").alias("_b"), (F.col("_u") - F.col("x._start")).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(df.dtypes)[key]).alias(key), "draw")
    last = F.last(key, ignorenulls=True).over(Window.partitionBy("_b").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return spans.unionByName(placed).withColumn(key, last).where("_side = 1").select("draw", key)


#: The answer fields that a stage unlocks; another stage unlocks all.
STAGE_FIELDS = {
    "a": ("context", "events", "presence"),
    "b": ("context", "events", "presence", "count", "obj_open", "type", "point", "rank", "location", "intention", "state", "content"),
}


def unlocked(field: Column, stage: Column) -> Column:
    """Whether a field may be trained in a stage; without a stage, or in one that has no list, all may."""
    out = F.lit(True)
    for name, fields in STAGE_FIELDS.items():
        out = F.when(stage == name, field.isin(*fields)).otherwise(out)
    return out


def stage_of(df: DataFrame, fraction: str, stages: DataFrame) -> DataFrame:
    """df with the stage whose [from, to) holds the progress fraction. stages: stage, from, to."""
    s = hint(stages.select("stage", F.col("from").alias("_f"), F.col("to").alias("_t")), 10_000)
    return df.join(s, (F.col(fraction) >= F.col("_f")) & (F.col(fraction) < F.col("_t")), "left").drop("_f", "_t")
