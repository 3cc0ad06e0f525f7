"""Frames, objects and answers derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FRAMES_SQL = """frames AS (SELECT user_id AS scene_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no, event_id, event_type,
  CASE event_type WHEN 'purchase' THEN 'GO_LEFT' WHEN 'signup' THEN 'GO_RIGHT' ELSE 'GO_STRAIGHT' END AS intent, value / 20.0 AS speed FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene: user; order: time; intent from the event type, skewed to straight; speed from the value."""
    e = table(spark, sf_dir, "events")
    intent = F.when(F.col("event_type") == "purchase", "GO_LEFT").when(F.col("event_type") == "signup", "GO_RIGHT").otherwise("GO_STRAIGHT")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("scene_id"), n.alias("frame_no"), "event_id", "event_type", intent.alias("intent"), (F.col("value") / 20.0).alias("speed"))


SERIES_SQL = (
    FRAMES_SQL
    + """, series AS (SELECT scene_id, frame_no, event_id, intent, speed AS v0, past, future FROM (SELECT *,
  list(speed) OVER (PARTITION BY scene_id ORDER BY frame_no ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS past,
  list(speed) OVER (PARTITION BY scene_id ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS future FROM frames) WHERE len(future) = 20)"""
)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the speeds of up to 16 past samples (this one last) and 20 future ones; full futures only."""
    w = Window.partitionBy("scene_id").orderBy("frame_no")
    rows = frames(spark, sf_dir).withColumn("past", F.collect_list("speed").over(w.rowsBetween(-15, 0))).withColumn("future", F.collect_list("speed").over(w.rowsBetween(1, 20)))
    return rows.where(F.size("future") == 20).select("scene_id", "frame_no", "event_id", "intent", F.col("speed").alias("v0"), "past", "future")


OBJECTS_SQL = """objects AS (SELECT l_orderkey AS frame, l_linenumber AS g, l_linenumber AS rank, l_returnflag AS class, l_linestatus AS state, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS w, l_quantity / 2 AS h FROM lineitem)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame: order; object: line with rank, class, state and box."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("frame"), c("l_linenumber").alias("g"), c("l_linenumber").alias("rank"), c("l_returnflag").alias("class"), c("l_linestatus").alias("state"),
        c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (c("l_tax") * 100).alias("w"), (c("l_quantity") / 2).alias("h"),
    )
