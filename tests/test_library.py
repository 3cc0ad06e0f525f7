"""String-case tables, oracle / corner / majority predictors, property checks, sources and sinks."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geometry, motion, text, vocab
from ridgeline.operators import aggregate, clean, evaluate, match, plans, prose, replicates, select, weights
from ridgeline.sources import frames as sources
from ridgeline.sources import sinks
from ridgeline.sources.checksums import crc32c, masked
from ridgeline.streaming.append import append_stream


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v)
    return row.select(column.alias("x")).first().x


def pts(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy]) if xy else F.array().cast("array<struct<x:double,y:double>>")


def test_behaviour_and_content(spark):
    cases = {"u turn": "turn left", "may crossing": "crossing", "Driving straight": "cruising", "walking to the car": "other", "give way": "decelerating", "prepare to park": "parking", "backing up": "backing", "": "other", "lane borrow": "lane change", "standing": "stopping"}
    signs = {"stop here on red": "stop", "RED": "red", "amber arrow": "yellow", "no left turn": "no turn", "speed limit 35": "speed limit", "keep right": "keep right", "x": "other"}
    for table, rule in ((cases, text.behaviour), (signs, text.content)):
        rows = spark.createDataFrame(list(table.items()), "v string, want string").withColumn("got", rule(F.col("v"))).collect()
        assert {r.v: r.got for r in rows} == table
    where = {"front left lane": ("front left", None), "right of the left curb": ("front right", "roadside"), "ahead, same lane": ("front", "ego-lane"), "": (None, None)}
    rows = spark.createDataFrame([(k,) for k in where], "v string").withColumn("s", text.location_slots(F.col("v"))).collect()
    assert {r.v: tuple(r.s) for r in rows} == where


@pytest.mark.parametrize("plan,moving,want", [("decelerate and stop", True, "stop"), ("wait, then proceed", True, "stop"), ("accelerate and proceed through the intersection", True, "accelerate"), ("keep lane", True, "unspecified"), ("proceed", False, "accelerate"), ("follow the stopped car", True, "keep"), ("stop at the stop line", True, "stop"), ("wait for the car to pass", True, "stop"), ("without stopping, cruise", True, "keep"), ("", True, "unmatched"), ("banana", True, "unmatched")])
def test_plan_reading(spark, plan, moving, want):
    df = spark.createDataFrame([(plan, 5.0 if moving else 0.0)], "plan string, v0 double")
    assert plans.classify_plans(df, "plan", "v0").first().plan_read.lon == want


def test_plan_rewrite_reads_as_motion(spark):
    rows = [("keep lane and cruise, then stop", "decelerate"), ("accelerate", "stop"), ("keep lane", "stop"), ("proceed and accelerate", "keep")]
    df = spark.createDataFrame([(p, m, "straight", 5.0, 0.0, None) for p, m in rows], "plan string, m_lon string, m_lat string, v0 double, v_end double, start_t double")
    done = plans.repair_plans(df, "plan", "m_lon", "m_lat", "v0", "v_end", "start_t").collect()
    assert {r.plan for r in done} == {"keep lane and cruise, then stop", "accelerate", "proceed and accelerate"}
    new = {r.plan: r.new_plan for r in done}
    assert new == {"keep lane and cruise, then stop": "keep lane and decelerate, then stop", "accelerate": "stop and wait", "proceed and accelerate": "cruise"}
    again = spark.createDataFrame([(r.new_plan, r.m_lon, 5.0) for r in done], "plan string, m_lon string, v0 double")
    assert all(r.plan_read.lon == r.m_lon for r in plans.classify_plans(again, "plan", "v0").collect())
    assert {r.plan: r.new_plan for r in done}["keep lane and cruise, then stop"] == "keep lane and decelerate, then stop"


def test_motion_rules(spark):
    rows = [(0.0, 0.2, 0.3, "stay", "stop"), (0.0, 2.0, 2.0, "start", "accelerate"), (0.0, 0.1, 2.0, "start", "stop"), (5.0, 0.2, 5.0, "stop", "stop"), (5.0, 3.0, 5.0, "decel", "decelerate"), (5.0, 7.0, 7.0, "accel", "accelerate"), (5.0, 5.5, 6.0, "keep", "keep"), (0.0, None, None, "stay", "stop"), (3.0, None, None, "keep", "keep")]
    df = spark.createDataFrame(rows, "v0 double, v_end double, v_max double, sample string, lon string")
    for r in df.select("sample", "lon", motion.sample_class(*map(F.col, ("v0", "v_end", "v_max"))).alias("s"), motion.lon_class(*map(F.col, ("v0", "v_end", "v_max"))).alias("l")).collect():
        assert (r.s, r.l) == (r.sample, r.lon)
    assert one(spark, motion.effective_intent(F.lit(""), F.lit(None).cast("string"))) == "GO_STRAIGHT"
    assert one(spark, motion.past_speeds(F.array(), F.array(), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0)))) == [4.0, 4.0]
    assert one(spark, motion.trailing_run(F.array(*map(F.lit, (0.1, 1.0, 0.2, 0.3))))) == 2


def test_displacement_pads_and_truncates(spark):
    e = one(spark, motion.displacement(pts((1, 0)), pts((1, 0), (2, 0), (3, 0))))
    assert e == [0.0, 1.0, 2.0]
    assert one(spark, motion.displacement(pts(), pts((1, 0)))) is None
    assert one(spark, motion.trajectory_score(motion.average_error(motion.displacement(pts(), pts((1, 0))), 20))) == 0.0
    r = one(spark, motion.resample(pts((4, 0)), F.lit(1.0)))
    assert [p.x for p in r][:4] == [1.0, 2.0, 3.0, 4.0] and r[-1].x == 4.0
    assert one(spark, motion.resample(pts(), F.lit(1.0)))[7].x == 0.0


def test_geometry(spark):
    t = np.array([0.0, 1, 2, 3, 4, 5])
    v = np.array([0.0, 1, 1, 3, 3, 4])
    at = np.linspace(0, 5, 101)
    got = geometry.pchip(t, v, at)
    assert np.allclose(geometry.pchip(t, v, t), v) and (np.diff(got) >= -1e-12).all() and np.allclose(geometry.pchip(t, 2 * t, at), 2 * at)
    s = np.arange(1, 21) / 4
    theta, residual = (v[0] for v in geometry.path_headings(np.concatenate([[0], np.sin(s / 3) * 30])[None], np.concatenate([[0], (1 - np.cos(s / 3)) * 30])[None]))
    assert 80 < theta < 100 and residual < 1
    rng = np.random.default_rng(3)
    for _ in range(30):
        pixels = rng.random((9, 7)) < 0.3
        flat = pixels.flatten(order="F").astype(int)
        cut = np.flatnonzero(np.diff(flat)) + 1
        counts = np.diff([0, *cut, len(flat)]).tolist()
        counts = [0, *counts] if flat[0] else counts
        mask = geometry.RunMask(9, counts)
        ys, xs = np.nonzero(pixels)
        for x, y in rng.uniform(-3, 12, (10, 2)):
            inside = 0 <= round(y) < 9 and 0 <= round(x) < 7 and pixels[round(y), round(x)]
            want = 0.0 if inside else np.hypot(xs - x, ys - y).min() if len(xs) else float("inf")
            assert abs(mask.distance(x, y) - want) < 1e-9 or mask.distance(x, y) == want
    assert one(spark, geometry.one_decimal(F.lit(0.25))) == "0.2" and one(spark, geometry.one_decimal(F.lit(-0.04))) == "0.0"


def test_deflicker_next_then_previous(spark):
    intents = "SSSLRRRSLLLL"
    speed = [2, 2, 2, 0, 0, 2, 2, 0, 2, 2, 2, 0]
    df = spark.createDataFrame([("a", i, v, float(s)) for i, (v, s) in enumerate(zip(intents, speed, strict=True))] + [("b", 0, "L", 0.0)], "scene string, n int, intent string, speed double")
    out = {(r.scene, r.n): r.intent_corrected for r in clean.deflicker(df, "scene", "n", "intent", F.col("speed") < 1, 3).collect()}
    assert "".join(out["a", i] for i in range(12)) == "SSSLLRRLLLLL" and out["b", 0] == "L"


def test_strides_and_caps(spark):
    df = spark.createDataFrame([("s", i, "n" if i % 3 else "p") for i in range(100)], "scene string, n int, kind string")
    kept = select.stride_select(df, "scene", "n", F.col("kind"), {"n": 12, "p": 1}).collect()
    assert sum(r.kind == "p" for r in kept) == 34 and sum(r.kind == "n" for r in kept) == 6 and any(r.n == 1 for r in kept)
    capped = select.cap_ratio(df, F.col("kind") == "n", 0.35, 1, "n").groupBy("kind").count().collect()
    assert dict(map(tuple, capped)) == {"p": 34, "n": int(0.35 / 0.65 * 34)}


def test_quota_sums_and_repair(spark):
    strata = spark.createDataFrame([("a", 50), ("b", 3), ("c", 1), ("d", 46)], "s string, size long")
    q = {r.s: r.quota for r in select.quota(strata, "s", "size", 33).collect()}
    assert sum(q.values()) == 33 and all(q[k] <= n for k, n in (("a", 50), ("b", 3), ("c", 1), ("d", 46)))
    assert sum(r.quota for r in select.quota(strata, "s", "size", 1000).collect()) == 100
    pool = spark.createDataFrame([(i, "ab"[i % 2], float(i % 10)) for i in range(200)], "k long, s string, m double")
    found = select.select_scenes(pool, "k", "s", 10, {"m": 80.0}, seed=1, restarts=1)
    assert found.count() == 10 and select.shortfall(found, {"m": 80.0}).first().shortfall == 0


def test_oracle_corner_and_majority_predictors(spark):
    truth = spark.createDataFrame([("f", g, g, "car" if g < 5 else "bus", 100.0 * g, 200.0, 40.0, 30.0) for g in range(1, 8)], "frame string, g int, rank int, class string, x double, y double, w double, h double")
    oracle = truth.select("frame", F.col("g").alias("p"), F.col("class").alias("pclass"), (F.col("x") + 20).alias("px"), (F.col("y") + 15).alias("py"))
    corner = oracle.withColumns({"px": F.lit(0.0), "py": F.lit(0.0)})
    good = evaluate.object_metrics(truth, oracle, match.assign_objects(truth, oracle, "frame"), "frame").first()
    assert good.recall == good.precision == good.type_acc == good.loc_hit == 1.0 and good.mean_distance == 0
    bad = evaluate.object_metrics(truth, corner, match.assign_objects(truth, corner, "frame"), "frame").first()
    assert bad.recall < 0.2
    rows = truth.select("class", F.lit("car").alias("said"))
    summary = aggregate.macro_recall(aggregate.class_report(aggregate.confusion(rows, "class", "said")), 1).first()
    assert summary.accuracy == summary.majority_share and summary.majority_class == "car"


def test_assignment_against_brute_force(spark):
    rng = np.random.default_rng(2)
    truth, found = [], []
    for f in range(25):
        truth += [(f, g, int(rng.integers(1, 4)), *map(float, rng.uniform(0, 200, 2)), *map(float, rng.uniform(5, 60, 2))) for g in range(5)]
        found += [(f, p, *map(float, rng.uniform(0, 260, 2))) for p in range(6)]
    t = spark.createDataFrame(truth, "frame int, g int, rank int, x double, y double, w double, h double")
    p = spark.createDataFrame(found, "frame int, p int, px double, py double")
    got = {(r.frame, r.g): r.p for r in match.assign_objects(t, p, "frame").collect()}
    want = {}
    for f in range(25):
        used = set()
        for _, g, _, x, y, w, h in sorted((r for r in truth if r[0] == f), key=lambda r: (r[2], r[1])):
            best = min(((np.hypot(max(x - px, 0, px - x - w), max(y - py, 0, py - y - h)), q) for k, q, px, py in found if k == f and q not in used), default=None)
            if best and best[0] <= min(300, max(60, 1.5 * np.hypot(w, h))):
                want[f, g] = best[1]
                used.add(best[1])
    assert got == want


def test_answers_strict_and_prose(spark):
    rows = [(1, '<ego_state>lon=stopped 3.2s | lat=X</ego_state><obj type="Car"><point>(5, 6)</point></obj><obj type=Bus><traj>[1, 2], [3, 4]'), (2, None), (3, "A dog at (1200, 600). There is no bus.\nPlan: stop\nPath (1.0, 0), (2.0, 0), (3.0, 0), (4.0, 0), (5.0, 0)")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("a", text.parse_answer(F.col("text")))
    a = {r.id: r.a for r in df.collect()}
    assert a[1].ego_state.lon_class == "stopped" and a[1].objects[0].type == "Car" and a[1].objects[0].point.x == 5 and a[1].n_unclosed_obj == 1 and a[1].traj is None and a[1].traj_n_points == 2 and not a[1].traj_closed
    assert a[2].objects == [] and a[2].motion is None and a[2].events == []
    e = {r.id: r for r in prose.extract_answers(df, "text").collect()}
    assert [(o.type, o.point.x) for o in e[3].objects] == [("Animal", 1200.0)] and e[3].final_plan == "stop" and e[3].traj[0].x == 1.0 and e[3].provenance["traj"] == "prose" and e[1].provenance["objects"] == "strict"
    assert tuple(one(spark, text.verdict(F.lit("1, 0")))) == (1, 0) and one(spark, text.verdict(F.lit("sorry"))) is None
    assert one(spark, text.degenerate(F.lit("abcdefghijklmnopqrstuvwxyz " * 3))) and not one(spark, text.degenerate(F.lit("abc")))


def test_judge_slot(spark):
    items = spark.createDataFrame([("f", i, p) for i, p in enumerate(["good", "", "bad reply", None])], "frame string, object_pos int, prediction string")

    def judge(batches):
        for b in batches:
            yield b.assign(reply=["1,0" if p == "good" else "sorry" for p in b["prediction"]])[["frame", "object_pos", "reply"]]

    found = {r.object_pos: (r.cause, r.effect) for r in evaluate.judged(items.na.fill(""), judge, "frame").collect()}
    assert found == {0: (1, 0), 1: (0, 0), 2: (None, None), 3: (0, 0)}
    m = aggregate.judge_metrics(spark.createDataFrame([("k", 1, 1), ("k", 0, 1), ("j", None, None), ("j", 1, 1)], "kind string, cause int, effect int")).collect()
    assert {r.kind: (r.cause, r.dropped) for r in m} == {"k": (0.5, 0.0), "j": (None, 0.5)}


def test_composite_skips_missing(spark):
    wide = spark.createDataFrame([(0.5, 1.0)], "ctx_macro_acc double, events_f1 double")
    assert abs(wide.select(aggregate.composite(wide, 1).alias("c")).first().c - 0.75) < 1e-12
    assert wide.select(aggregate.composite(wide, 2).alias("c")).first().c == pytest.approx(0.75)


def test_bootstrap_and_draw(spark):
    pairs = spark.createDataFrame([(i, 1.0 + (i % 5) * 0.1, 0.5) for i in range(200)], "k long, a double, b double")
    r = replicates.paired_bootstrap(pairs, "k", "a", "b", 300, 1).first()
    assert abs(r.mean_diff - 0.7) < 1e-9 and r.low < 0.7 < r.high and r.high - r.low < 0.1 and r.share_above == 1.0
    w = spark.createDataFrame([(i, float(i)) for i in range(5)], "k long, w double")
    n = {r.k: r["count"] for r in weights.weighted_draw(w, "k", "w", 4000, 2).groupBy("k").count().collect()}
    assert sum(n.values()) == 4000 and 0 not in n and all(abs(n[k] / 4000 - k / 10) < 0.03 for k in n)


def test_enum_and_context(spark):
    events = F.array(F.array(F.lit("traffic jam"), F.lit("none")), F.array(F.lit("Airport")))
    assert one(spark, vocab.clean_events(events)) == [["Traffic jam"]]
    assert one(spark, vocab.clean_scenario(F.lit("Urban, Highway"))) == "Urban Highway" and one(spark, vocab.clean_scenario(F.lit(None).cast("string"))) is None
    assert one(spark, vocab.dataset_class(F.lit("traffic lights"))) == "traffic control" and one(spark, vocab.dataset_class(F.lit("other"))) == "unknown"


def framed(b):
    head = struct.pack("<Q", len(b))
    return head + struct.pack("<I", masked(crc32c(head))) + b + struct.pack("<I", masked(crc32c(b)))


def test_sources(spark, tmp_path):
    for part, scene, n, frame in (("p1--a", "s-x", 3, {"intent": "GO_LEFT", "past_states": {"pos_x": [1.0]}}), ("p2--b", "t", 10, {"intent": ""})):
        d = tmp_path / part / scene / f"{scene}-{n:03d}"
        d.mkdir(parents=True)
        (d / "frame.json").write_text(json.dumps(frame))
        (d / "panorama_geo.json").write_text(json.dumps({"context": {"weather": "Fog"}, "annotations": [{"class": "vehicle 1", "attributes": {"type": "Car", "state": ["moving", "x"], "content": []}}]}))
    bad = tmp_path / "p1--a" / "s-x" / "s-x-004"
    bad.mkdir()
    (bad / "frame.json").write_text("{")
    rows = {r.frame_key: r for r in sources.read_frames(spark, str(tmp_path)).collect()}
    assert set(rows) == {"s-x-003", "t-010"} and rows["s-x-003"].partition == "p1" and rows["s-x-003"].scene_id == "s-x" and rows["t-010"].frame_no == 10
    ann = sources.read_annotations(spark, str(tmp_path)).withColumn("o", F.col("objects")[0])
    got = ann.select(*[sources.attribute(F.col("o.attributes"), f).alias(f) for f in ("type", "state", "content", "intention")]).first()
    assert tuple(got) == ("Car", "moving", "", "")
    (tmp_path / "ids.json").write_text('{"scenes": ["a", "b"]}')
    assert [r.id for r in sources.read_id_list(spark, str(tmp_path / "ids.json")).collect()] == ["a", "b"]
    (tmp_path / "pred.json").write_text('{"results": [{"id": "s-1-007", "pred_traj_xy": [[1, 2]]}]}')
    p = sources.read_predictions(spark, str(tmp_path / "pred.json")).first()
    assert (p.scene_id, p.frame_id, p.pred_xy) == ("s-1", "007", [[1.0, 2.0]])
    assert sources.read_rated_index(spark, str(tmp_path / "none.json")).count() == 0
    shards = tmp_path / "shards"
    shards.mkdir()
    frame = framed
    (shards / "a").write_bytes(frame(b"one") + frame(b"") + b"cut")
    (shards / "b").write_bytes(frame(b"two"))
    sources.register(spark)
    got = sorted((r.shard, r.record_no, bytes(r.payload)) for r in spark.read.format("recordfile").load(str(shards)).collect())
    assert got == [("a", 0, b"one"), ("a", 1, b""), ("b", 0, b"two")]


def test_sinks_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    path = str(tmp_path / "t")
    assert sinks.append_new(df, path, "k").count() == 2
    assert sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, "k").count() == 3
    df.write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "streamed")
    sinks.append_pruned(spark.createDataFrame([(1, "z"), (3, "c")], df.schema), path, "k")
    for _ in range(2):
        append_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "cp"), "k").awaitTermination(60)
    assert spark.read.parquet(path).count() == 3
    assert sinks.versioned_write(df, str(tmp_path / "v"), "1").endswith("version=1")
