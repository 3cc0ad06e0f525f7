"""Equal lengths, changes that equal their bound, counts of large tables: where the last digit decides."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import capabilities, curate, match


def test_points_at_nearly_equal_distance(spark):
    """Both points are 7.0710678… away, and the roots of the sums of squares tell which is nearer."""
    truth = spark.createDataFrame([(1, 1, 1, "A", 32.0, 0.07 * 100, 3.0, 16.0)], "frame long, g long, rank long, class string, x double, y double, w double, h double")
    found = spark.createDataFrame([(1, 4, "A", 27.0, 2.0), (1, 6, "A", 42.0, 6.0)], "frame long, p long, pclass string, px double, py double")
    for got in (match.assign_objects(truth, found, "frame"), match.assign_typed(truth, found, "frame"), match.assign_typed(truth, found, "frame", F.lit(True))):
        assert [r.p for r in got.collect()] == [6]


def test_many_distinct_answers_are_counted(spark):
    df = spark.range(1_050_000).select(F.lit("m").alias("model"), F.concat(F.lit("t "), F.col("id") % 600_000).alias("a"))
    found = capabilities.detect_capabilities(df, "model", [capabilities.Field("a", F.col("a"))]).first()
    assert (found.n_frames, found.n_distinct, found.rule) == (1_050_000, 600_000, "able")


@pytest.mark.parametrize("v0,v,up", [(6.0, 4.8, -1), (1.5, 2.5, 1)])
def test_a_change_that_equals_its_bound(spark, v0, v, up):
    """Positions rounded by a nanometre make a change of them that is none of the measured speeds."""
    path = [{"x": i * v * 0.25 + max(i - 16, 0) * up * 1e-9, "y": 0.0} for i in range(1, 21)]
    kind = "frame_key string, v0 double, intent string, intent_corrected string, speeds array<double>, future array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([("k", v0, "GO_STRAIGHT", "", [v] * 20, path)], kind)
    assert curate.label_path(rows, "future", "v0").first().label.lon != "keep"
    assert tuple(curate.label_path(rows, "future", "v0", speeds="speeds").first().label) == ("keep", "keep", "straight")
    ann = spark.createDataFrame([], "frame_key string, context struct<weather:string,daytime:string,visibility:string,scenario:string,road:string>, events array<array<string>>, objects array<struct<type:string,intention:string,state:string,implication:string>>, reason string, final_plan string")
    assert curate.build_caches(rows.select("frame_key"), rows, ann).first().motion_lon == "keep"
