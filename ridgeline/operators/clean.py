"""Cleaning of labelled sequences: stable runs, de-flicker, edits that hold on, context repair, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import vocab


def runs(df: DataFrame, scene: str, order: str, value: str, eligible: Column, least: int) -> DataFrame:
    """df with run_id and run_len for rows of runs: neighbouring eligible rows of one value, ``least`` at least.

    Gaps and islands: a row starts a run if it is eligible and the row before is not, or has another
    value. Other rows, and runs that are too short, have NULL in both.
    """
    w = Window.partitionBy(scene).orderBy(order)
    rows = df.withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    start = F.col("_ok") & ~(F.coalesce(F.lag("_ok").over(w), F.lit(False)) & F.coalesce(F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(False)))
    rows = rows.withColumn("_start", start.cast("int")).withColumn("_run", F.sum("_start").over(w))
    size = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(scene, "_run"))
    stable = F.col("_ok") & (size >= least)
    return rows.withColumn("run_id", F.when(stable, F.col("_run"))).withColumn("run_len", F.when(stable, size)).drop("_ok", "_start", "_run")


def deflicker(df: DataFrame, scene: str, order: str, value: str, slow: Column, least: int) -> DataFrame:
    """df with ``<value>_corrected``: slow rows take the value of the next stable run, else of the one before, else their own."""
    found = runs(df, scene, order, value, ~slow, least)
    stable = F.when(F.col("run_id").isNotNull(), F.col(value))
    w = Window.partitionBy(scene).orderBy(order)
    after = F.first(stable, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(stable, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn(f"{value}_corrected", F.when(slow, F.coalesce(after, before, F.col(value))).otherwise(F.col(value)))


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    """Counts of ``old->new`` among changed rows."""
    changed = df.where(~F.col(old).eqNullSafe(F.col(new)))
    return changed.groupBy(F.concat_ws("->", F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))).alias("transition")).agg(F.count("*").alias("n"))


def deflicker_report(df: DataFrame, old: str, new: str) -> DataFrame:
    changed = F.count_if(~F.col(old).eqNullSafe(F.col(new)))
    return df.agg(F.count("*").alias("frames"), changed.alias("changed"), F.try_divide(changed.cast("double"), F.count("*").cast("double")).alias("rate"))


def propagate_edits(df: DataFrame, edits: DataFrame, scene: str, order: str, columns: list[str]) -> DataFrame:
    """Each edit (scene, order, some columns) holds from its row to the next edit of that column."""
    marks = edits.select(scene, order, *[F.col(c).alias(f"_e_{c}") for c in columns])
    w = Window.partitionBy(scene).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.join(marks, [scene, order], "left")
    held = {c: F.coalesce(F.last(f"_e_{c}", ignorenulls=True).over(w), F.col(c)) for c in columns}
    return rows.withColumns(held).drop(*[f"_e_{c}" for c in columns])


def clean_context(ann: DataFrame, context: str = "context", events: str = "events") -> DataFrame:
    """ann with repaired context and events (array<array<string>>) and a column ``changes``: which parts changed."""
    scenario = vocab.clean_scenario(F.col(f"{context}.scenario"))
    weather = vocab.clean_weather(F.col(f"{context}.weather"))
    rows = ann.withColumn("_scenario", scenario).withColumn("_weather", weather).withColumn("_events", vocab.clean_events(F.col(events)))
    changes = F.struct(
        F.when(~F.col(f"{context}.scenario").eqNullSafe(F.col("_scenario")), F.concat_ws("->", F.coalesce(F.col(f"{context}.scenario"), F.lit("")), "_scenario")).alias("scenario"),
        F.when(~F.col(f"{context}.weather").eqNullSafe(F.col("_weather")), F.concat_ws("->", F.coalesce(F.col(f"{context}.weather"), F.lit("")), "_weather")).alias("weather"),
        (F.col(events) != F.col("_events")).alias("events"),
    )
    rows = rows.withColumn("changes", changes)
    rows = rows.withColumn(context, F.col(context).withField("scenario", F.col("_scenario")).withField("weather", F.col("_weather"))).withColumn("_old_events", F.col(events)).withColumn(events, F.col("_events"))
    return rows.drop("_scenario", "_weather", "_events")


def hygiene_report(cleaned: DataFrame, events: str = "events") -> DataFrame:
    """(kind, detail, n): transitions of scenario and weather, and event types that were removed (positive differences only)."""
    parts = []
    for kind in ("scenario", "weather"):
        parts.append(cleaned.where(F.col(f"changes.{kind}").isNotNull()).groupBy(F.col(f"changes.{kind}").alias("detail")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "detail", "n"))
    old = cleaned.select(F.explode(F.flatten("_old_events")).alias("detail")).groupBy("detail").agg(F.count("*").alias("o"))
    new = cleaned.select(F.explode(F.flatten(events)).alias("detail")).groupBy("detail").agg(F.count("*").alias("m"))
    gone = old.join(new, "detail", "left").select("detail", (F.col("o") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
    return parts[0].unionByName(parts[1]).unionByName(gone.select(F.lit("event removed").alias("kind"), "detail", "n"))
