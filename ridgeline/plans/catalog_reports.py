"""Registered queries of the reports at width, over inputs that vary by row; their SQL computes every rate from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import motion, text
from ridgeline.operators import metrics, reports, targets
from ridgeline.plans.catalog import query
from ridgeline.plans.views import FRAMES_SQL, OBJECTS_SQL, SERIES_SQL, frames, objects, series


def _rounded(df, *keep: str):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


#: Bent paths with their heading change and speeds, and what an answer of the frame says.
_BENT_SQL = (
    SERIES_SQL
    + """, p AS (SELECT event_id, intent, v0, (scene_id % 7 - 3) / 60.0 AS b, list_transform(range(0, 21), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE list_sum(list_transform(future[1:i], lambda v: v + 1.6)) * 0.25 END) AS r FROM series),
c AS (SELECT *, list_transform(range(0, 21), lambda i: r[i + 1] * cos(b * i)) AS x, list_transform(range(0, 21), lambda i: r[i + 1] * sin(b * i)) AS y FROM p),
h AS (SELECT *, list_transform(range(1, 21), lambda i: atan2(y[i + 1] - y[i], x[i + 1] - x[i])) AS h, list_transform(range(1, 21), lambda i: sqrt(pow(y[i + 1] - y[i], 2) + pow(x[i + 1] - x[i], 2)) / 0.25) AS s FROM c),
k AS (SELECT *, degrees(h[20] - h[1]) AS theta, (s[17] + s[18] + s[19] + s[20]) / 4 AS v_end, list_max(s) AS v_max, greatest(1.0, 0.2 * v0) AS bound FROM h),
l AS (SELECT event_id, intent, v0, CASE WHEN abs(theta) >= 25 THEN CASE WHEN theta > 0 THEN 'left_turn' ELSE 'right_turn' END ELSE 'straight' END AS lat,
  CASE WHEN v_end < 0.5 THEN 'stop' WHEN (v0 < 0.5 AND v_max >= 1.0) OR v_end - v0 > bound THEN 'accelerate' WHEN v0 - v_end > bound THEN 'decelerate' ELSE 'keep' END AS lon,
  CASE event_id % 4 WHEN 1 THEN 'left_turn' WHEN 2 THEN 'right_turn' ELSE 'straight' END AS said_lat, CASE event_id % 3 WHEN 0 THEN 'keep' ELSE 'accelerate' END AS said_lon,
  CASE event_id % 5 WHEN 1 THEN 'accelerate' WHEN 2 THEN 'decelerate' WHEN 3 THEN 'stop' WHEN 4 THEN 'accelerate' END AS plan_lon, CASE event_id % 5 WHEN 1 THEN 'left_turn' WHEN 2 THEN 'right_turn' END AS plan_lat FROM k)"""
)


@query(
    "WITH "
    + _BENT_SQL
    + """, o AS (SELECT 'all' AS slice, NULL AS value, l.* FROM l UNION ALL SELECT 'intent', intent, l.* FROM l)
SELECT slice, value, count(*) AS n_frames, round(avg((lat = said_lat)::INT), 9) AS motion_traj_lat_consistency, round(avg((lon = said_lon)::INT), 9) AS motion_traj_consistency,
round(avg(CASE WHEN plan_lon IS NOT NULL THEN (plan_lon = lon AND (plan_lat IS NULL OR plan_lat = lat))::INT END), 9) AS plan_traj_consistency_strict,
round(avg(CASE WHEN plan_lon IS NOT NULL THEN (plan_lon = said_lon AND (plan_lat IS NULL OR plan_lat = said_lat))::INT END), 9) AS plan_motion_consistency_strict, round(avg((event_id % 7 = 0)::INT), 9) AS cap_hit_rate FROM o GROUP BY 1, 2"""
)
def turning_chains(spark, sf_dir):
    """Chain rates over smooth turns, whose lateral class is the heading change alone, whatever the intent."""
    bend, e = (F.col("scene_id") % 7 - 3) / 60.0, F.col("event_id")
    steps = motion.running_sums(F.transform("future", lambda v: v + 1.6))
    pts = F.transform(steps, lambda d, i: F.struct((d * 0.25 * F.cos(bend * (i + 1))).alias("x"), (d * 0.25 * F.sin(bend * (i + 1))).alias("y")))
    lat = F.when(e % 4 == 1, "left_turn").when(e % 4 == 2, "right_turn").otherwise("straight")
    plan = F.when(e % 5 == 1, "accelerate and turn left").when(e % 5 == 2, "turn right and decelerate").when(e % 5 == 3, "stop").when(e % 5 == 4, "accelerate").otherwise("keep lane")
    said = F.concat(F.lit("<final_plan>"), plan, F.lit("</final_plan><motion>lon="), F.when(e % 3 == 0, "keep").otherwise("accelerate"), F.lit(" | lat="), lat, F.lit("</motion><traj>[1, 0"))
    none = F.lit(None).cast("string")
    rows = series(spark, sf_dir).select("event_id", "v0", "intent", pts.alias("truth"), pts.alias("pred"), said.alias("text"), text.parse_answer(said).alias("answer"))
    rows = rows.withColumns({"ego": F.struct(none.alias("lon"), none.alias("lat"), none.alias("lon_class")), "motion": F.struct(F.lit("keep").alias("lon"), none.alias("lat")), "sample_class": F.lit("keep"), "gt_plan": none, "n_tokens": F.lit(None).cast("int"), "max_tokens": F.lit(None).cast("int"), "hit_cap": F.lit(None).cast("boolean"), "finish_reason": F.when(e % 7 == 0, "length").otherwise("stop")})
    found = metrics.chain_report(metrics.chain_flags(rows), ["intent"])
    return _rounded(found.select("slice", "value", "n_frames", "motion_traj_lat_consistency", "motion_traj_consistency", "plan_traj_consistency_strict", "plan_motion_consistency_strict", "cap_hit_rate"))


#: Plans with their classes in the closed vocabulary: fixed by the row's number.
_PLANS = (("turn left and decelerate", "turn left", "decelerate"), ("keep lane and cruise", "keep lane", "cruise"), ("accelerate", "keep lane", "accelerate"), ("stop", "keep lane", "stop"), ("turn right", "turn right", None), ("merge left and slow down", "lane change left", "decelerate"), ("accelerate and turn left", "turn left", "accelerate"))
_PLAN_SQL = (
    "WITH "
    + FRAMES_SQL
    + ", v(k, lat, lon) AS (VALUES "
    + ", ".join(f"({i}, '{a}', {repr(b) if b else 'NULL'})" for i, (_, a, b) in enumerate(_PLANS))
    + """), r AS (SELECT t.lat AS t_lat, t.lon AS t_lon, CASE WHEN event_id % 5 > 0 THEN coalesce(f.lat, '<missing>') ELSE '<missing>' END AS f_lat, CASE WHEN event_id % 5 > 0 THEN coalesce(f.lon, 'unspecified') ELSE '<missing>' END AS f_lon
  FROM frames JOIN v t ON t.k = event_id % 7 JOIN v f ON f.k = (event_id + CASE WHEN frame_no % 2 = 0 THEN 1 ELSE 0 END) % 7),
m AS (SELECT 'lat' AS kind, t_lat AS truth, f_lat AS found, count(*) AS n FROM r GROUP BY 2, 3 UNION ALL SELECT 'lon', t_lon, f_lon, count(*) FROM r WHERE t_lon IS NOT NULL GROUP BY 2, 3),
t AS (SELECT kind, truth AS label, sum(n)::BIGINT AS n, sum(CASE WHEN truth = found THEN n ELSE 0 END) AS tp FROM m GROUP BY 1, 2), q AS (SELECT kind, found AS label, sum(n) AS f FROM m GROUP BY 1, 2)"""
)


def _planned(spark, sf_dir):
    plan = lambda k: F.element_at(F.array(*[F.lit(p) for p, _, _ in _PLANS]), (k % 7 + 1).cast("int"))
    e = F.col("event_id")
    found = F.when(e % 5 > 0, plan(e + F.when(F.col("frame_no") % 2 == 0, 1).otherwise(0)))
    f = frames(spark, sf_dir).select("event_id", plan(e).alias("gt_plan"), F.struct(found.alias("final_plan")).alias("answer"), F.lit(5.0).alias("v0")).withColumn("_plan", F.col("answer.final_plan"))
    from ridgeline.operators import plans

    read = plans.classify_plans(plans.classify_plans(f, "_plan", "v0", "plan_read"), "gt_plan", "v0", "gt_plan_read")
    return reports.plan_confusions(read)


@query(_PLAN_SQL + " SELECT kind, label, n, round(tp / n::DOUBLE, 9) AS recall, round(tp / f::DOUBLE, 9) AS precision FROM t LEFT JOIN q USING (kind, label)")
def plan_class_rates(spark, sf_dir):
    return _rounded(reports.class_rows(_planned(spark, sf_dir)).drop("missed"))


@query(_PLAN_SQL + " SELECT kind, sum(n)::BIGINT AS n, round(sum(tp) / sum(n)::DOUBLE, 9) AS acc, round(avg(tp / n::DOUBLE), 9) AS macro_recall, round(avg(tp / n::DOUBLE) FILTER (n >= 10), 9) AS macro_recall_min, max({'n': n, 'label': label}).label AS majority_class, round(max(n) / sum(n)::DOUBLE, 9) AS majority_baseline FROM t GROUP BY 1")
def plan_axis_rates(spark, sf_dir):
    return _rounded(reports.kind_rows(_planned(spark, sf_dir)))


#: Words of states and contents with their canonical, coarse and main classes.
_STATES = (("driving", "cruising", "moving"), ("parked", "parking", "parked"), ("crossing", "crossing", "crossing"), ("turning left", "turn left", "turning/merging"), ("stopped", "stopping", "slowing/stopped"), (None, "other", "other"))
_CONTENTS = (("red", "red"), ("GREEN arrow", "green"), ("amber", "yellow"), ("stop here on red", "stop"), ("speed limit 30", "speed limit"))
_sql = lambda v: "NULL" if v is None else f"'{v}'"
_DOING_SQL = (
    "WITH "
    + OBJECTS_SQL
    + ", s(k, word, fine, coarse) AS (VALUES "
    + ", ".join(f"({i}, {_sql(w)}, '{f}', '{c}')" for i, (w, f, c) in enumerate(_STATES))
    + "), c(k, word, fine) AS (VALUES "
    + ", ".join(f"({i}, '{w}', '{f}')" for i, (w, f) in enumerate(_CONTENTS))
    + """), o AS (SELECT frame, g, class, g % 3 > 0 AS hit, (frame + g) % 6 AS ks, (frame + 2 * g) % 6 AS ps, (frame + g) % 5 AS kc, (frame + 3 * g) % 5 AS pc FROM objects),
b AS (SELECT o.*, t.word AS word, t.fine AS tf, t.coarse AS tc, p.fine AS pf, p.coarse AS pco FROM o JOIN s t ON t.k = ks JOIN s p ON p.k = ps WHERE class <> 'N'), l AS (SELECT o.*, t.fine AS tf, p.fine AS pf FROM o JOIN c t ON t.k = kc JOIN c p ON p.k = pc WHERE class = 'N'),
main(kind, truth, found) AS (SELECT 'state_fine', tf, pf FROM b WHERE hit AND word IS NOT NULL UNION ALL SELECT 'state_coarse', tc, pco FROM b WHERE hit AND word IS NOT NULL UNION ALL SELECT 'intention_fine', tf, pf FROM b WHERE hit AND word IS NOT NULL AND g % 2 = 0 UNION ALL SELECT 'intention_coarse', tc, pco FROM b WHERE hit AND word IS NOT NULL AND g % 2 = 0
  UNION ALL SELECT 'content_fine', tf, pf FROM l WHERE hit UNION ALL SELECT 'content_main', CASE WHEN tf = 'speed limit' THEN 'other' ELSE tf END, CASE WHEN pf = 'speed limit' THEN 'other' ELSE pf END FROM l WHERE hit)"""
)


def _doing(spark, sf_dir):
    f, g = F.col("frame"), F.col("g")
    word = lambda table, k: F.element_at(F.array(*[F.lit(x[0]) for x in table]), (k % len(table) + 1).cast("int"))
    kind = F.when(F.col("class") == "A", "Car").when(F.col("class") == "R", "Pedestrian").otherwise("Traffic light")
    state, said = word(_STATES, f + g), word(_STATES, f + 2 * g)
    return objects(spark, sf_dir).select(
        kind.alias("type"), (g % 3 > 0).alias("hit"), state.alias("state"), F.when(g % 2 == 0, state).alias("intention"), word(_CONTENTS, f + g).alias("content"), said.alias("pred_state"), said.alias("pred_intention"), word(_CONTENTS, f + 3 * g).alias("pred_content"),
    )


@query(_DOING_SQL + " SELECT kind, truth, found, count(*) AS n FROM main GROUP BY 1, 2, 3")
def behaviour_confusions(spark, sf_dir):
    return reports.behaviour_confusions(_doing(spark, sf_dir))


@query(
    _DOING_SQL
    + """ SELECT (SELECT count(*) FROM b WHERE word IS NOT NULL) AS state_gt, (SELECT count(*) FROM b WHERE word IS NOT NULL AND hit) AS state_scored, (SELECT count(*) FROM l) AS content_gt, (SELECT count(*) FROM l WHERE hit) AS content_scored,
(SELECT count(*) FROM main WHERE kind = 'state_coarse' AND found = 'moving' AND truth <> 'moving') AS collapsed_to_moving, count(*) AS n_signal, count(*) FILTER (truth = 'red' AND found = 'green') AS red_as_green, count(*) FILTER (truth = 'green' AND found = 'red') AS green_as_red,
round(count(*) FILTER ((truth, found) IN (('red', 'green'), ('green', 'red'))) / count(*)::DOUBLE, 9) AS swapped_rate FROM main WHERE kind = 'content_fine' AND truth IN ('red', 'green')"""
)
def behaviour_totals(spark, sf_dir):
    rows = _doing(spark, sf_dir)
    return _rounded(reports.behaviour_summary(rows, reports.behaviour_confusions(rows)))


@query(
    "WITH "
    + OBJECTS_SQL
    + """, f AS (SELECT *, CASE frame % 3 WHEN 0 THEN 'front left' WHEN 1 THEN 'front right' END AS side, CASE WHEN x < 22.5 THEN 'front left' WHEN x > 27.5 THEN 'front right' ELSE 'front' END AS px FROM objects),
o AS (SELECT 'all' AS slice, NULL AS value, f.* FROM f UNION ALL SELECT 'class', class, f.* FROM f)
SELECT slice, value, count(*) FILTER (g > 2) AS n_pred_objects, count(*) FILTER (g > 2 AND g % 4 = 0) AS n_fp_objects, round(avg((g % 4 > 0)::INT) FILTER (g > 2), 9) AS obj_precision, round(avg((side = px)::INT) FILTER (g > 2 AND g % 5 > 0), 9) AS direction_pixel_consistency, round(avg((side = px)::INT) FILTER (g <= 2), 9) AS gt_direction_pixel_consistency FROM o GROUP BY 1, 2"""
)
def predicted_sides(spark, sf_dir):
    o, g = objects(spark, sf_dir), F.col("g")
    said = F.when(F.col("frame") % 3 == 0, "on the front left, near").when(F.col("frame") % 3 == 1, "front right lane").otherwise("somewhere")
    rows = o.select("class", "g", said.alias("location"), "x", (g % 4 > 0).alias("matched"))
    return _rounded(reports.prediction_rates(rows.where("g > 2").withColumn("x", F.when(g % 5 > 0, F.col("x"))), rows.where("g <= 2"), 50.0, ["class"]))


_TYPES_SQL = (
    "WITH "
    + OBJECTS_SQL
    + """, f AS (SELECT DISTINCT frame, frame % 5 = 0 AS says FROM objects), t AS (SELECT frame, class, class || state AS fine, rank FROM objects WHERE g <= 3 AND frame % 7 > 0), p AS (SELECT frame, class, class || state AS fine FROM objects WHERE g > 3),
m AS (SELECT coalesce(a.class, b.class) AS class, coalesce(a.n, 0) AS t, coalesce(b.n, 0) AS p FROM (SELECT frame, class, count(*) AS n FROM t GROUP BY 1, 2) a FULL JOIN (SELECT frame, class, count(*) AS n FROM p GROUP BY 1, 2) b ON a.frame = b.frame AND a.class = b.class),
s AS (SELECT class, sum(least(t, p))::BIGINT AS tp, sum(greatest(t - p, 0))::BIGINT AS missed, sum(greatest(p - t, 0))::BIGINT AS extra FROM m GROUP BY 1),
z AS (SELECT coalesce(a.n, 0) AS t, coalesce(b.n, 0) AS p FROM (SELECT frame, fine, count(*) AS n FROM t GROUP BY 1, 2) a FULL JOIN (SELECT frame, fine, count(*) AS n FROM p GROUP BY 1, 2) b ON a.frame = b.frame AND a.fine = b.fine),
y AS (SELECT f.frame IN (SELECT frame FROM t) AS t, says OR f.frame IN (SELECT frame FROM p) AS p FROM f)"""
)


def _typed(spark, sf_dir):
    o = objects(spark, sf_dir).withColumn("fine", F.concat("class", "state"))
    fr = o.select("frame", (F.col("frame") % 5 == 0).alias("says")).distinct()
    return reports.typeonly_report(fr, o.where("g <= 3 AND frame % 7 > 0"), o.where("g > 3"), "frame")


@query(_TYPES_SQL + " SELECT class, tp + missed AS n, round(tp / nullif(tp + missed, 0)::DOUBLE, 9) AS recall, round(tp / nullif(tp + extra, 0)::DOUBLE, 9) AS precision, missed, extra AS false_positive FROM s")
def typeonly_classes(spark, sf_dir):
    return _rounded(_typed(spark, sf_dir)[1])


@query(
    _TYPES_SQL
    + """ SELECT count(*) AS n_frames, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, round(avg((t = p)::INT), 9) AS presence_acc, round(avg(t::INT), 9) AS presence_always_yes,
(SELECT count(*) FROM t) AS n_gt_objects, (SELECT count(*) FROM p) AS n_pred_objects, (SELECT round(sum(tp) / sum(tp + missed)::DOUBLE, 9) FROM s) AS det_recall, (SELECT round(sum(tp) / sum(tp + extra)::DOUBLE, 9) FROM s) AS det_precision,
(SELECT round(sum(least(t, p)) / sum(t)::DOUBLE, 9) FROM z) AS fine_type_recall, (SELECT sum(extra)::BIGINT FROM s) AS n_false_positive, (SELECT round(avg(((t.frame, t.class) IN (SELECT frame, class FROM p))::INT), 9) FROM t WHERE rank = 1) AS det_recall_rank1 FROM y"""
)
def typeonly_totals(spark, sf_dir):
    return _rounded(_typed(spark, sf_dir)[0])


@query(
    "WITH "
    + FRAMES_SQL
    + """, r AS (SELECT CASE WHEN event_id % 4 > 0 THEN 'intervene' ELSE 'control' END AS kind, CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'keep' ELSE 'accelerate' END AS target, CASE WHEN frame_no % 6 > 0 THEN CASE WHEN speed < 2 THEN 'stop' WHEN speed < 5 THEN 'keep' ELSE 'accelerate' END END AS derived, CASE WHEN speed < 3 THEN 'stop' ELSE 'keep' END AS base, event_type AS cls, CASE WHEN frame_no % 6 > 0 THEN speed END AS ade FROM frames),
o AS (SELECT 'all' AS slice, NULL AS value, r.* FROM r UNION ALL SELECT 'target_lon', target, r.* FROM r UNION ALL SELECT 'sample_class', cls, r.* FROM r)
SELECT slice, value, count(*) FILTER (kind = 'intervene') AS n_intervened, count(*) FILTER (kind = 'control') AS n_control, round(avg(coalesce(derived = target, false)::INT) FILTER (kind = 'intervene'), 9) AS follow_rate, round(avg((derived <> base)::INT) FILTER (kind = 'intervene'), 9) AS changed_vs_base_rate,
round(avg((derived IS NOT NULL)::INT) FILTER (kind = 'intervene'), 9) AS pred_rate, round(avg(ade) FILTER (kind = 'intervene'), 6) AS intervened_ade5, round(avg(coalesce(derived = target, false)::INT) FILTER (kind = 'control'), 9) AS self_follow_rate, round(avg(ade / 2) FILTER (kind = 'control'), 6) AS reproduction_ade, avg(coalesce(derived = target, false)::INT) FILTER (kind = 'intervene') >= 0.7 AS passed FROM o GROUP BY 1, 2"""
)
def interventions(spark, sf_dir):
    f, e, v = frames(spark, sf_dir), F.col("event_id"), F.col("speed")
    path = F.col("frame_no") % 6 > 0
    rows = f.select(
        F.when(e % 4 > 0, "intervene").otherwise("control").alias("kind"), F.when(e % 3 == 0, "stop").when(e % 3 == 1, "keep").otherwise("accelerate").alias("target_lon"), F.when(path, F.when(v < 2, "stop").when(v < 5, "keep").otherwise("accelerate")).alias("derived_lon"),
        F.when(v < 3, "stop").otherwise("keep").alias("base_derived_lon"), F.col("event_type").alias("sample_class"), F.when(path, v).alias("ade5"), F.when(path, v / 2).alias("ade_vs_base"),
    )
    found = reports.intervention_report(rows)
    return _rounded(found.withColumns({c: F.round(c, 6) for c in ("intervened_ade5", "reproduction_ade")}))


@query("WITH " + OBJECTS_SQL + " SELECT 'state' AS field, CASE state WHEN 'F' THEN 'moving' ELSE 'parked' END AS value, count(*) AS n FROM objects WHERE class = 'A' GROUP BY 2 UNION ALL SELECT 'intention', 'i' || g, count(*) FROM objects WHERE class = 'A' AND g > 2 GROUP BY 2 UNION ALL SELECT 'location', 'ahead', count(*) FROM objects WHERE class <> 'R'")
def owned_attributes(spark, sf_dir):
    """Cars own state, intention and location, animals the location alone, and lights none of these."""
    o, g = objects(spark, sf_dir), F.col("g")
    kind = F.when(F.col("class") == "A", "Car").when(F.col("class") == "N", "Animal").otherwise("Traffic light")
    rows = o.select(kind.alias("type"), F.when(F.col("state") == "F", "moving ").otherwise("parked").alias("state"), F.when(g > 2, F.concat(F.lit("i"), g.cast("string"))).otherwise(" ").alias("intention"), F.lit("ahead").alias("location"))
    return reports.attribute_values(rows, "state", "intention", "location")


@query(
    "WITH "
    + OBJECTS_SQL
    + """, m AS (SELECT *, CASE g % 3 WHEN 0 THEN 'front left' WHEN 1 THEN 'front right' ELSE 'front' END AS td, CASE frame % 2 WHEN 0 THEN 'front left' ELSE 'front right' END AS pd, CASE WHEN g % 2 = 0 THEN 'ego-lane' END AS tl, CASE WHEN frame % 3 = 0 THEN 'ego-lane' ELSE 'roadside' END AS pl FROM objects WHERE g > 1)
SELECT 'direction' AS kind, td AS truth, pd AS found, count(*) AS n FROM m WHERE td <> pd GROUP BY 2, 3 UNION ALL SELECT 'lane', tl, pl, count(*) FROM m WHERE tl <> pl GROUP BY 2, 3 UNION ALL SELECT 'state', CASE WHEN class = 'A' THEN 'crossing' ELSE 'parking' END, 'cruising', count(*) FROM m WHERE class <> 'R' GROUP BY 2"""
)
def wrong_attributes(spark, sf_dir):
    o, g, f = objects(spark, sf_dir), F.col("g"), F.col("frame")
    truth = F.concat(F.when(g % 3 == 0, "front left").when(g % 3 == 1, "front right").otherwise("ahead"), F.when(g % 2 == 0, ", same lane").otherwise(""))
    found = F.concat(F.when(f % 2 == 0, "front left").otherwise("front right"), F.when(f % 3 == 0, ", same lane").otherwise(" at the curb"))
    none = F.lit(None).cast("string")
    rows = o.select((g > 1).alias("hit"), truth.alias("location"), found.alias("pred_location"), none.alias("intention"), none.alias("pred_intention"), F.when(F.col("class") == "A", "crossing").when(F.col("class") == "N", "parking").alias("state"), F.lit("cruising").alias("pred_state"))
    return reports.attribute_confusions(rows)


@query(
    "WITH "
    + FRAMES_SQL
    + """, t AS (SELECT event_id, '<ego_state>lon=cruising ' || frame_no || '.0 m/s | lat=n/a</ego_state><context>weather=Fair;daytime=Unknown;visibility=Unknown;scenario=Unknown;road=Merge</context><events>' || event_type || '</events><has_objects>yes</has_objects><obj type=Car><point>' || frame_no || ',5</point><rank>1</rank><state>moving</state><implication>slows ' || scene_id || '</implication></obj><n_objects>1</n_objects>' AS u, '<final_plan>stop</final_plan><motion>lon=keep | lat=straight</motion><traj>' AS c FROM frames)
SELECT event_id, u AS understanding, u || CASE WHEN event_id % 2 = 0 THEN '<reason>frame ' || event_id || '</reason>' ELSE '' END || c AS chain FROM t"""
)
def truth_prefixes(spark, sf_dir):
    """Targets of both stages' task, cut where a model goes on; every other frame has no reason."""
    f = frames(spark, sf_dir)
    none = F.lit(None).cast("string")
    context = F.struct(F.lit("Fair").alias("weather"), F.lit("").alias("daytime"), none.alias("visibility"), none.alias("scenario"), F.lit("Merge").alias("road"))
    point = F.struct(F.col("frame_no").alias("x"), F.lit(5).alias("y"))
    car = F.struct(F.lit("Car").alias("type"), point.alias("point"), F.lit(1).alias("rank"), none.alias("location"), none.alias("intention"), F.lit("moving").alias("state"), F.lit("red").alias("content"), F.concat(F.lit("slows "), F.col("scene_id").cast("string")).alias("implication"), F.lit(1.0).alias("intention_factor"), F.lit(None).cast("double").alias("state_factor"))
    ego = F.format_string("lon=cruising %d.0 m/s | lat=n/a", "frame_no")
    rows = f.select("event_id", context.alias("context"), F.array(F.array("event_type")).alias("events"), F.array(car).alias("objects"), ego.alias("ego_text"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("frame "), F.col("event_id").cast("string"))).alias("reason"), F.lit(0.5).alias("reason_weight"), F.lit("stop").alias("plan"), F.lit("lon=keep | lat=straight").alias("motion_text"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).alias("points"), F.array(F.lit(3.0)).alias("waypoint_weights"))
    t = targets.build_targets(rows, "s2")
    kept, _ = reports.with_prefix(t, lambda _: targets.truth_prefix(F.col("segments"), "chain"), "chain")
    return kept.select("event_id", targets.truth_prefix(F.col("segments"), "understanding").alias("understanding"), "chain")


#: Words of objects with their types, and of what they do with its canonical behaviour.
_WORDS = (("bus", "Bus"), ("ambulance", "Emergency vehicle"), ("pickup", "Truck"), ("cyclist", "Cyclist"), ("dog", "Animal"), ("traffic cone", "Object"), ("white sedan", "Car"))
_ACTS = (("waiting", "stopping"), ("moving", "cruising"), ("reversing", "backing"), ("slowing down", "decelerating"), ("painted", None))


@query(
    "WITH "
    + FRAMES_SQL
    + ", w(k, word, type) AS (VALUES "
    + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_WORDS))
    + "), d(k, act, state) AS (VALUES "
    + ", ".join(f"({i}, '{a}', {_sql(b)})" for i, (a, b) in enumerate(_ACTS))
    + """), t AS (SELECT event_id, a.word AS word, b.word AS other, act, 'A ' || a.word || ' at (' || (100 + frame_no % 900) || ', ' || (400 + scene_id % 90) || ') is ' || act || ', rank: ' || (1 + event_id % 3) || '.' AS seen FROM frames JOIN w a ON a.k = event_id % 7 JOIN w b ON b.k = (event_id + 3) % 7 JOIN d ON d.k = event_id % 5),
s AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'There is no ' || word || ' here.' WHEN event_id % 4 = 1 THEN seen || ' No ' || other || ' is near.' WHEN event_id % 4 = 2 THEN 'No ' || other || ' is near. ' || seen ELSE seen || chr(10) || 'Plan: follow the ' || other || '.' END AS said FROM t),
p AS (SELECT event_id, regexp_extract(said, 'A ([a-z ]+) at \\((\\d+), (\\d+)\\) is ([a-z ]+), rank: (\\d)', ['word', 'x', 'y', 'act', 'rank']) AS m FROM s)
SELECT event_id, w.type, try_cast(m.x AS DOUBLE) AS x, try_cast(m.y AS DOUBLE) AS y, d.state, try_cast(m.rank AS INTEGER) AS rank, (m.word <> '')::INT AS n FROM p LEFT JOIN w ON w.word = m.word LEFT JOIN d ON d.act = m.act"""
)
def varied_prose(spark, sf_dir):
    """Sentences of many words, places and denials; the SQL reads the same texts by a pattern."""
    from ridgeline.operators import prose

    f, e = frames(spark, sf_dir), F.col("event_id")
    pick = lambda table, k: F.element_at(F.array(*[F.lit(x[0]) for x in table]), (k % len(table) + 1).cast("int"))
    word, other = pick(_WORDS, e), pick(_WORDS, e + 3)
    seen = F.concat(F.lit("A "), word, F.lit(" at ("), (100 + F.col("frame_no") % 900).cast("string"), F.lit(", "), (400 + F.col("scene_id") % 90).cast("string"), F.lit(") is "), pick(_ACTS, e), F.lit(", rank: "), (1 + e % 3).cast("string"), F.lit("."))
    said = F.when(e % 4 == 0, F.concat(F.lit("There is no "), word, F.lit(" here."))).when(e % 4 == 1, F.concat(seen, F.lit(" No "), other, F.lit(" is near."))).when(e % 4 == 2, F.concat(F.lit("No "), other, F.lit(" is near. "), seen)).otherwise(F.concat(seen, F.lit("\nPlan: follow the "), other, F.lit(".")))
    o = F.col("objects")
    one = prose.extract_answers(f.select("event_id", said.alias("text")), "text").select("event_id", "objects", F.get(o, F.lit(0)).alias("o"))
    return one.select("event_id", F.col("o.type").alias("type"), F.col("o.point.x").alias("x"), F.col("o.point.y").alias("y"), F.col("o.state").alias("state"), F.col("o.rank").alias("rank"), F.size("objects").alias("n"))
