"""Work that grows with the rows: one pass over the frames, masks of a batch together, texts read once for each kind."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ridgeline.functions import geometry, text
from ridgeline.operators import curate, evaluate, match, metrics, prose, select


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_come_from_one_pass(spark):
    path = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct((i * 0.5).alias("x"), (i * F.col("id")).cast("double").alias("y")))
    frames = spark.range(5).select("id", path.alias("truth"), F.lit(2.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col("id") % 2).alias("half"))
    rows = evaluate.reference_predictions(frames, "id", keep=("truth", "half"))
    assert plan(rows).count("Range (") == 1 and "Join" not in plan(rows)
    assert rows.count() == 20 and rows.where("kind = 'ceiling'").select(F.bool_and(F.abs(F.col("pred")[19]["y"] - F.col("truth")[19]["y"]) < 1e-9).alias("ok")).first().ok
    by_kind = evaluate.trajectory_summary(rows, ["half"], ("kind",))
    assert {(r.kind, r.slice, r.value): r.n for r in by_kind.collect()} == {(k, s, v): n for k in ("gt", "cv", "static", "ceiling") for s, v, n in (("all", None, 5), ("half", "0", 3), ("half", "1", 2))}


def test_paths_of_many_lengths_and_histories(spark):
    def row(i, n, past):
        return i, [{"x": float(k * k), "y": float(i)} for k in range(1, n + 1)] if n is not None else None, past

    p = {"x": -1.0, "y": 0.0}
    kind = "i int, p array<struct<x:double,y:double>>, h array<struct<x:double,y:double>>"
    df = spark.createDataFrame([row(0, 5, None), row(1, 5, [p] * 3), row(2, 3, [p] * 2), row(3, 0, None), row(4, None, [p] * 3), row(5, 1, [{"x": float("nan"), "y": 0.0}] * 3)], kind)
    got = {r.i: r.u for r in df.select("i", geometry.upsample(F.col("p"), F.col("h")).alias("u")).collect()}
    assert got[3] is None and got[4] is None and [len(got[i]) for i in (0, 1, 2, 5)] == [20] * 4
    assert [q.x for q in got[0]][3::4] == [1.0, 4.0, 9.0, 16.0, 25.0] and got[1][0].x != got[0][0].x and {q.y for q in got[5]} > {5.0}


def test_masks_of_a_batch(spark):
    counts = [np.array([5, 3, 2, 3, 2, 3, 7]), np.array([], np.int64), np.array([4]), np.array([0, 0, 3, 9])]
    masks = geometry.RunMasks(np.array([5, 5, 2, 4]), counts)
    one = [geometry.RunMask(h, c) for h, c in zip((5, 5, 2, 4), counts, strict=True)]
    x, y = np.array([3.0, 1.0, 1.0, 9.0]), np.array([9.0, 1.0, 1.0, 2.5])
    assert masks.distances(x, y).tolist() == [m.distance(a, b) for m, a, b in zip(one, x, y, strict=True)] and np.isinf(masks.distances(x, y)).tolist() == [False, True, True, False]
    assert [None if np.isnan(a) else (a, b) for a, b in zip(*masks.centre_pixels(), strict=True)] == [m.centre_pixel() for m in one]


def test_texts_of_matches_are_read_once_for_each_pair(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "parked").when(F.col("id") % 3 == 1, "driving").alias("state"), F.lit("cruising").alias("pred_state"))
    found = metrics.collapsed_to_moving(df)
    below = plan(found).rsplit("Aggregate", 1)[1].split("\n", 1)[1]
    assert [tuple(r) for r in found.collect()] == [("parked", 100)] and "RLIKE" not in below.upper()


def test_a_draw_does_not_broadcast_its_table(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("s"))
    quotas = spark.createDataFrame([(0, 3), (1, 200)], "s long, quota long")
    drawn = select.stratified_draw(df, quotas, "s", 1, "id")
    assert "rightHint=(strategy=broadcast)" in plan(drawn) and drawn.groupBy("s").count().orderBy("s").collect() == [(0, 3), (1, 100)]


def test_answers_are_read_once(spark):
    said = F.when(F.col("id") % 3 == 0, "<reason>r</reason><obj type=Car><rank>1</rank></obj>").when(F.col("id") % 3 == 1, "A dog at (1200, 600). There is no bus.\nPlan: stop")
    df = spark.range(300).select(said.alias("text"))
    found = prose.answer_stats(df, "text")
    assert plan(found).count("run(") == 3 and plan(found).rsplit("ArrowEvalPython", 1)[1].count("Aggregate") == 1 and "Filter (size" not in plan(found)
    got = {tuple(r) for r in found.collect()}
    assert got == {tuple(r) for r in prose.extraction_stats(prose.extract_answers(df, "text")).collect()}
    assert {("objects", "strict", 100), ("objects", "prose", 100), ("objects", "none", 100), ("reason", "none", 200), ("final_plan", "prose", 100)} <= got
    read = []
    assert prose.each_once(lambda t: read.append(t) or t, pa.array(["a", None, "b", "a", None]), pa.string()).to_pylist() == ["a", None, "b", "a", None] and sorted(read, key=str) == [None, "a", "b"]


def test_repeats_against_the_pattern():
    pattern, rnd = re.compile(r"(?s)(.{25,200}?)\1\1"), random.Random(1)
    for _ in range(400):
        size, letters = rnd.choice([24, 25, 26, 49, 75, 200, 201]), rnd.choice(["a", "ab", "abcdefgh", "é車😀\n"])
        some = lambda n: "".join(rnd.choices(letters, k=n))  # noqa: E731, B023
        said = some(rnd.randrange(60)) + (some(size) * 3)[: 3 * size - rnd.choice([0, 0, 1, size])] + some(rnd.randrange(60))
        assert text.repeats(said) == (pattern.search(said) is not None), said


def test_chains_read_speeds_and_texts_once(spark):
    one = F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    df = spark.range(60).select("id", F.array(*[one] * 20).alias("p"), F.array(*[F.col("id").cast("double")] * 20).alias("v"), F.lit(1.0).alias("v0"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), F.lit(75))).alias("t"))
    labelled = curate.label_path(df, "p", "v0", speeds="v")
    assert plan(labelled).count("filter(") <= 2 and labelled.count() == 60
    repeated = df.select(text.degenerate(F.col("t")).alias("r"))
    assert "regexp" not in plan(repeated).lower() and repeated.where("r").count() == 40 and repeated.where("r IS NULL").count() == 0
    headings = df.select(geometry.heading(F.when(F.col("id") < 30, F.col("p"))).alias("h")).groupBy("h").count().collect()
    assert {(r.h.theta, r.h.residual, r["count"]) for r in headings} == {(None, None, 30), (0.0, 0.0, 30)}


def test_frames_are_dealt_by_their_rows(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("frame"), "id")
    parts = [t.rdd.getNumPartitions() for rows in (10, 200, 1_000_000) for t in match.dealt("frame", df, df.where("id < 500"), rows=rows)]
    assert parts == [150, 150, 8, 8, 2, 2]
    assert match.dealt("frame", df, rows=1)[0].rdd.getNumPartitions() == match.MOST_PARTS
    boxes = df.select("frame", "id", *[F.col("id").cast("double").alias(c) for c in "xywh"])
    joined = match.match_boxes(boxes, boxes.withColumnRenamed("id", "mask").where("frame <> 3"), "frame", "id", "mask")
    assert joined._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert {(r.id % 50 == 3, r.mask == r.id, r.distance) for r in joined.collect()} == {(True, False, None), (False, True, 0.0)}


def test_a_mask_at_an_unknown_distance_comes_last(spark):
    kind = "frame int, id int, x double, y double, w double, h double"
    ann = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (2, 1, 0.0, 0.0, 1.0, 1.0), (3, 1, None, 0.0, 1.0, 1.0)], kind)
    masks = spark.createDataFrame([(1, 4, None, 0.0, 1.0, 1.0), (1, 5, 3.0, 0.0, 1.0, 1.0), (2, 6, None, 0.0, 1.0, 1.0), (3, 8, 1.0, 0.0, 1.0, 1.0), (3, 7, 1.0, 0.0, 1.0, 1.0)], kind).withColumnRenamed("id", "mask")
    got = sorted(tuple(r) for r in match.match_boxes(ann, masks, "frame", "id", "mask").collect())
    assert got == [(1, 1, 5, 3.0), (2, 1, 6, None), (3, 1, 7, None)]
