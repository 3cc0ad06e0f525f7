"""Wide metric families: answers as chains, understanding of objects and frames, presence, behaviour.

A family is one pass: flag columns (true, false, or NULL where a row is not judged) and measures, then
one aggregation over all rows and by slice. Confusion tables stay long: (kind, truth, found, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import motion, text, vocab
from ridgeline.operators import plans
from ridgeline.operators.aggregate import accuracy, by_slice, mean_valid, prf, rate, weighted_mean
from ridgeline.operators.curate import label_path, path_speeds
from ridgeline.operators.evaluate import duplicate_objects
from ridgeline.operators.match import direction, location_gate
from ridgeline.operators.order_stats import quantiles


def sure(ok: Column) -> Column:
    """A flag that counts as false where it is unknown."""
    return F.coalesce(ok, F.lit(False))


def said(c: Column) -> Column:
    return sure(F.trim(c) != "")


def _error(found: Column, truth: Column) -> Column:
    return F.abs(found - truth)


def chain_flags(rows: DataFrame) -> DataFrame:
    """rows with a flag or measure column for every chain rate.

    rows: answer (as parse_answer gives it), text, v0, intent, pred and truth (paths of 20 samples or
    NULL), ego (lon, lat, lon_class), motion (lon, lat; lat NULL where not judged), sample_class,
    gt_plan, n_tokens, max_tokens, hit_cap, and finish_reason if there is one. pred_speeds and
    truth_speeds, if there are such columns, are the paths' speeds; else their steps are. The lateral class of a
    predicted path is its heading change alone: what the curve or the intent says plays no part here.
    """
    a, v0 = F.col("answer"), F.col("v0")
    measured = {path: f"{path}_speeds" if f"{path}_speeds" in rows.columns else None for path in ("pred", "truth")}
    rows = label_path(rows.withColumn("_path", F.col("pred")), "_path", "v0", speeds=measured["pred"]).withColumnRenamed("label", "_label").drop("_path")
    rows = rows.withColumn("_plan", a["final_plan"])
    rows = plans.classify_plans(plans.classify_plans(rows, "_plan", "v0", "_read"), "gt_plan", "v0", "_gt_read")
    for side, path in (("_p", "pred"), ("_g", "truth")):
        speeds = path_speeds(path, measured[path])
        rows = rows.withColumns({f"{side}_end": motion.end_speed(speeds), f"{side}_start": motion.start_time(speeds)})
    ego, number, truth = F.col("ego"), text.ego_numbers(a["ego_state"]["lon"]), text.ego_numbers(F.col("ego.lon"))
    rows = rows.withColumn("_n", number).withColumn("_t", truth)
    has_path, has_plan = F.col("pred").isNotNull(), said(a["final_plan"])
    lon_class = F.coalesce(a["ego_state"]["lon_class"], F.col("_n.cls"))
    rows = rows.withColumn("_lon", sure(lon_class == ego["lon_class"])).withColumn("_lat", sure(F.upper(F.trim(F.coalesce(a["ego_state"]["lat"], F.lit("n/a")))) == F.upper(F.trim(F.coalesce(ego["lat"], F.lit("n/a"))))) & a["ego_state"].isNotNull())
    moving = F.when(ego["lon_class"] == "cruising", _error(F.col("_n.v"), F.coalesce("_t.v", v0))).when(ego["lon_class"].isin("accelerating", "decelerating"), _error(F.col("_n.v_to"), F.coalesce("_t.v_to", v0)))
    m, lat = a["motion"], F.col("motion.lat")
    label = F.col("_label")

    def agrees(read: str, lon: Column, lat: Column, side: str, strict: bool = False) -> Column:
        return plans.consistent(F.col(read), lon, lat, v0, F.col(f"{side}_end"), F.col(f"{side}_start"), strict)

    def judged(read: str, lon: Column, lat: Column, side: str, when: Column, strict: bool = False) -> Column:
        tolerant = agrees(read, lon, lat, side)
        return F.when(when & tolerant.isNotNull(), sure(agrees(read, lon, lat, side, strict)))

    with_motion, by_path, by_truth = has_plan & m["lon"].isNotNull(), has_plan & has_path, said(F.col("gt_plan")) & F.col("motion").isNotNull()
    found_class = F.when(has_path & F.col("truth").isNotNull(), label["sample"]).otherwise("none")
    plan_class, finish = F.col("_read.lon"), F.col("finish_reason") if "finish_reason" in rows.columns else F.lit(None).cast("string")
    repeated, arith, dup = text.degenerate(F.col("text")), motion.is_progression(a["traj"]) & motion.varies(F.col("truth")), sure(duplicate_objects(a["objects"]))
    flags = {
        "ego_state_present_rate": a["ego_state"].isNotNull(), "ego_state_lon_acc": F.col("_lon"), "ego_state_lat_acc": F.col("_lat"), "ego_state_acc": F.col("_lon") & F.col("_lat"),
        "ego_state_stop_time_mae": F.when(F.col("_lon") & (ego["lon_class"] == "stopped"), _error(F.col("_n.seconds"), F.col("_t.seconds"))), "ego_state_speed_mae": F.when(F.col("_lon"), moving),
        "motion_present_rate": m.isNotNull(), "motion_lon_acc": sure(m["lon"] == F.col("motion.lon")), "motion_lat_acc": F.when(lat.isNotNull(), sure(m["lat"] == lat)),
        "motion_acc": sure(m["lon"] == F.col("motion.lon")) & F.when(lat.isNull(), True).otherwise(sure(m["lat"] == lat)),
        "plan_motion_consistency": judged("_read", m["lon"], m["lat"], "_p", with_motion), "plan_motion_consistency_strict": judged("_read", m["lon"], m["lat"], "_p", with_motion, True),
        "plan_traj_consistency": judged("_read", label["lon"], label["lat"], "_p", by_path), "plan_traj_consistency_strict": judged("_read", label["lon"], label["lat"], "_p", by_path, True),
        "gt_plan_motion_consistency": judged("_gt_read", F.col("motion.lon"), lat, "_g", by_truth), "gt_plan_motion_consistency_strict": judged("_gt_read", F.col("motion.lon"), lat, "_g", by_truth, True),
        "plan_unspecified_rate": F.when(has_plan, plan_class == "unspecified"), "plan_unmatched_rate": F.when(has_plan, plan_class == "unmatched"),
        "motion_traj_consistency": F.when(has_path & m["lon"].isNotNull(), label["lon"] == m["lon"]), "motion_traj_lat_consistency": F.when(has_path & m["lat"].isNotNull(), label["lat"] == m["lat"]),
        "reason_missing_rate": ~said(a["reason"]), "plan_missing_rate": ~has_plan, "ego_state_missing_rate": a["ego_state"].isNull(), "motion_missing_rate": m.isNull(), "traj_missing_rate": ~has_path,
        "start_frame_acc": F.when(F.col("sample_class") == "start", found_class == "start"), "start_pred_static_rate": F.when(F.col("sample_class") == "start", found_class == "stay"),
        "start_frame_motion_acc": F.when((F.col("sample_class") == "start") & m["lon"].isNotNull(), m["lon"] == "accelerate"), "stay_frame_acc": F.when(F.col("sample_class") == "stay", found_class == "stay"),
        "cap_hit_rate": F.when(finish.isNotNull() | F.col("hit_cap").isNotNull() | (F.col("n_tokens").isNotNull() & F.col("max_tokens").isNotNull()), sure(finish == "length") | sure(F.col("hit_cap")) | sure(F.col("n_tokens") >= F.col("max_tokens"))),
        "traj_unclosed_rate": (a["traj_n_points"] > 0) & ~a["traj_closed"], "unclosed_obj_rate": a["n_unclosed_obj"] > 0,
        "text_repeat_rate": repeated, "traj_arith_rate": arith, "traj_flat_rate": motion.is_flat(a["traj"]), "obj_dup_rate": dup, "degenerate_rate": repeated | arith | dup,
    }
    implied = {"_objects": F.size(a["objects"]), "_unexplained": F.size(F.filter(a["objects"], lambda o: ~said(o["implication"])))}
    out = rows.withColumns({f"_c_{k}": c.cast("double") for k, c in flags.items()}).withColumns(implied).withColumn("_found_class", found_class)
    return out.withColumnRenamed("_read", "plan_read").withColumnRenamed("_gt_read", "gt_plan_read").drop("_plan", "_n", "_t", "_lon", "_lat", "_label", "_p_end", "_p_start", "_g_end", "_g_start")


def chain_report(flags: DataFrame, slices: list[str]) -> DataFrame:
    """Every chain rate of chain_flags()'s rows, over all and by slice; missing_rate is the mean of three."""
    rates = [c[3:] for c in flags.columns if c.startswith("_c_")]
    found = by_slice(flags, slices, F.count("*").alias("n_frames"), *[F.avg(f"_c_{c}").alias(c) for c in rates], rate(F.sum("_unexplained"), F.sum("_objects")).alias("implication_missing_rate"), F.count("_c_start_frame_acc").alias("n_start_frames"), F.count("_c_stay_frame_acc").alias("n_stay_frames"))
    mean = weighted_mean([(F.col(c), 1.0) for c in ("reason_missing_rate", "plan_missing_rate", "implication_missing_rate")])
    wrong = {f"plan_traj_inconsistency_rate{s}": 1.0 - F.col(f"plan_traj_consistency{s}") for s in ("", "_strict")}
    return found.withColumns({"missing_rate": mean, **wrong})


def counts_of(rows: DataFrame, pairs: dict[str, tuple[Column, Column]], where: dict[str, Column] | None = None, missing: str = "none") -> DataFrame:
    """(kind, truth, found, n) of several confusions in one pass over the rows; NULL becomes a name of its own."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(missing))
    cells = [F.when((where or {}).get(k, F.lit(True)), F.struct(F.lit(k).alias("kind"), name(t).alias("truth"), name(f).alias("found"))) for k, (t, f) in pairs.items()]
    return rows.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").groupBy("c.kind", "c.truth", "c.found").agg(F.count("*").alias("n"))


def chain_confusions(flags: DataFrame) -> DataFrame:
    """Confusions of ego state, motion, and the motion class of frames that start or stay."""
    pairs = {"ego_state_lon": (F.col("ego.lon_class"), F.col("answer.ego_state.lon_class")), "motion_lon": (F.col("motion.lon"), F.col("answer.motion.lon")), "sample_class": (F.col("sample_class"), F.col("_found_class"))}
    return counts_of(flags, pairs, {"sample_class": F.col("sample_class").isin("start", "stay")})


def plan_taxonomy_report(flags: DataFrame) -> DataFrame:
    """One row: accuracies of the closed plan vocabulary, lateral, longitudinal and joint, over plans with a truth.

    A truth that names no speed, or no known lateral class, is left out of its side, and counted.
    """
    rows = flags.where(said(F.col("gt_plan")))
    rows = rows.withColumn("_t", plans.taxonomy(F.col("gt_plan_read"))).withColumn("_f", F.when(said(F.col("answer.final_plan")), plans.taxonomy(F.col("plan_read"))))
    lat = F.when(F.col("_t.lateral") != "other", sure(F.col("_f.lateral") == F.col("_t.lateral")))
    lon = F.when(~F.col("_t.longitudinal").isin("unspecified", "unmatched"), sure(F.col("_f.longitudinal") == F.col("_t.longitudinal")))
    return rows.agg(
        F.count("*").alias("n_with_gt"), rate(F.count("_f"), F.count("*")).alias("pred_rate"), F.count_if(lon.isNull()).alias("lon_excluded"), F.count_if(lat.isNull()).alias("lat_other"),
        accuracy(lat).alias("lat_acc"), accuracy(lon).alias("lon_acc"), accuracy(F.when(lat.isNotNull() & lon.isNotNull(), lat & lon)).alias("joint_acc"),
    )


#: What counts as the majority behaviour in attribute texts.
MAJORITY = "cruising"


def object_report(matches: DataFrame, slices: list[str]) -> DataFrame:
    """Rates over annotated objects with what they matched (NULLs where nothing): recall by rank and class, place, rank, attributes.

    matches: type, impact_rank, rank, location, intention, state, content, implication, w, h, hit,
    coarse_hit, d (distance), in_image, and pred_ columns of type, rank, location, intention, state,
    content, implication.
    """
    hit = sure(F.col("hit"))
    on = lambda ok: F.when(hit, ok)
    slot, found = text.location_slots(F.col("location")), text.location_slots(F.col("pred_location"))
    stated = lambda c: motion.present(c).isNotNull()
    loose = lambda c: on(F.when(stated(c), text.loosely_equal(F.col(f"pred_{c}"), F.col(c))))
    rows = matches.withColumn("_ts", slot).withColumn("_fs", found)
    side = on(F.when(F.col("_ts.direction").isNotNull(), sure(F.col("_ts.direction") == F.col("_fs.direction"))))
    lane = on(F.when(F.col("_ts.lane").isNotNull(), sure(F.col("_ts.lane") == F.col("_fs.lane"))))
    rank = F.col("impact_rank")
    flags = {
        "obj_recall": hit, "obj_recall_rank1": F.when(rank == 1, hit), "obj_recall_rank2": F.when(rank == 2, hit), "obj_recall_rank3": F.when(rank >= 3, hit),
        "coarse_recall": sure(F.col("coarse_hit")), "type_error_rate": sure(F.col("coarse_hit")) & ~hit,
        "loc_hit_relaxed": on((F.col("d") <= location_gate(F.col("w"), F.col("h"))) & F.col("in_image")), "loc_hit_strict": on(F.col("d") == 0),
        "rank_acc": on(sure(F.col("pred_rank") == F.col("rank"))), "rank_acc_pm1": on(sure(F.abs(F.col("pred_rank") - F.col("rank")) <= 1)),
        "attr_location_acc": loose("location"), "attr_intention_acc": loose("intention"), "attr_state_acc": loose("state"), "attr_content_acc": loose("content"),
        "attr_location_direction_acc": side, "attr_location_lane_acc": lane, "attr_location_slot_acc": F.when(side.isNotNull() | lane.isNotNull(), F.coalesce(side, F.lit(True)) & F.coalesce(lane, F.lit(True))),
        "implication_missing_rate": on(F.when(stated("implication"), ~said(F.col("pred_implication")))), "implication": on(F.when(stated("implication"), sure(text.word_overlap(F.col("implication"), F.col("pred_implication")) > 0.15))),
    }
    for c in ("intention", "state"):
        own, pred = text.canonical(F.col(c)), sure(text.canonical(F.col(f"pred_{c}")).contains(MAJORITY))
        judged = hit & stated(c)
        flags |= {f"attr_{c}_pred_cruising_rate": F.when(judged, pred), f"attr_{c}_to_cruising_rate": F.when(judged & (own != MAJORITY), pred), f"attr_{c}_minority_acc": F.when(judged & ~own.isin(*vocab.MAJORITY), text.loosely_equal(F.col(f"pred_{c}"), F.col(c)))}
    rows = rows.withColumns({f"_c_{k}": c.cast("double") for k, c in flags.items()})
    counts = [F.sum("_c_attr_intention_to_cruising_rate").cast("long").alias("attr_intention_to_cruising"), F.sum("_c_attr_state_to_cruising_rate").cast("long").alias("attr_state_to_cruising")]
    pooled = rate(F.sum("_c_attr_intention_acc") + F.sum("_c_attr_state_acc"), F.count("_c_attr_intention_acc") + F.count("_c_attr_state_acc")).alias("attr_intention_state_pooled_acc")
    out = by_slice(rows, slices, F.count("*").alias("n_objects"), *[F.avg(f"_c_{k}").alias(k) for k in flags], *counts, pooled)
    macro = weighted_mean([(F.col(f"attr_{c}_acc"), 1.0) for c in ("location", "intention", "state", "content")])
    return out.withColumns({"attr_macro_acc": macro, "attr_slot_macro_acc": weighted_mean([(F.col(f"attr_{c}_acc"), 1.0) for c in ("intention", "state", "location")])})


def frame_report(frames: DataFrame, slices: list[str]) -> DataFrame:
    """Rates over frames: context, events, presence, counts, ranks.

    frames: context (struct), events (array), n_objects (truth), pred_context (map), pred_events,
    pred_n (said number), pred_has, pred_ranks (of emitted objects, in order).
    """
    key = lambda k: F.when(F.col(f"context.{k}").isNotNull(), text.loosely_equal(F.try_element_at("pred_context", F.lit(k)), F.col(f"context.{k}")))
    emitted, ranks = F.size("pred_ranks"), F.col("pred_ranks")
    rising = F.forall(F.zip_with(F.slice(ranks, 2, F.greatest(emitted - 1, F.lit(0))), F.slice(ranks, 1, F.greatest(emitted - 1, F.lit(0))), lambda b, a: sure(b > a)), lambda ok: ok)
    flags = {f"ctx_{k}_acc": key(k) for k in vocab.CONTEXT_KEYS} | {
        "presence_f1": sure(F.col("pred_has")) == (F.col("n_objects") > 0), "count_consistency": F.col("pred_n") == emitted, "count_vs_gt": F.col("pred_n") == F.col("n_objects"), "count_mae": F.abs(F.col("pred_n") - emitted),
        "count_under_rate": emitted < F.col("n_objects"), "count_over_rate": emitted > F.col("n_objects"), "count_exact_rate": emitted == F.col("n_objects"), "rank_monotonic_rate": F.when(emitted >= 2, rising & F.forall(ranks, lambda r: r.isNotNull())),
    }
    t, f = F.array_distinct("events"), F.array_distinct("pred_events")
    sizes = {"_tp": F.size(F.array_intersect(t, f)), "_fp": F.size(F.array_except(f, t)), "_fn": F.size(F.array_except(t, f)), "_e": emitted, "_unranked": F.size(F.filter(ranks, lambda r: r.isNull()))}
    rows = frames.withColumns({**{f"_c_{k}": c.cast("double") for k, c in flags.items()}, **sizes})
    sums = prf(*[F.sum(c) for c in ("_tp", "_fp", "_fn")])
    out = by_slice(rows, slices, F.count("*").alias("n_frames"), *[F.avg(f"_c_{k}").alias(k) for k in flags], sums[2].alias("events_f1"), F.avg("_e").alias("mean_emitted_obj"), F.avg("n_objects").alias("mean_gt_obj"), rate(F.sum("_unranked"), F.sum("_e")).alias("rank_missing_rate"))
    return out.withColumn("ctx_macro_acc", weighted_mean([(F.col(f"ctx_{k}_acc"), 1.0) for k in vocab.CONTEXT_KEYS]))


def capped_pairs(df: DataFrame, truth: str, found: str, cap: int = 4) -> DataFrame:
    """(truth, found, n) of counts, each up to a cap."""
    return df.groupBy(F.least(F.col(truth), F.lit(cap)).alias("truth"), F.least(F.col(found), F.lit(cap)).alias("found")).agg(F.count("*").alias("n"))


def presence(frames: DataFrame, truth: Column, found: Column) -> DataFrame:
    """One row: the four counts, accuracy, precision, recall and f1 of presence, and what always saying yes would score."""
    t, f = sure(truth), sure(found)
    cells = frames.agg(F.count("*").alias("n_frames"), F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & ~f).alias("tn"))
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(F.col("n_frames") > 0, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return cells.select("*", rate(F.col("tp") + F.col("tn"), F.col("n_frames")).alias("accuracy"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), rate(F.col("tp") + F.col("fn"), F.col("n_frames")).alias("always_yes"))


def match_confusion(truth: DataFrame, found: DataFrame, matches: DataFrame, frame: str, t_class: str = "class", f_class: str = "pclass") -> DataFrame:
    """(truth, found, n) of matched objects, with ``missed`` for annotated ones without a match and ``false_positive`` for predictions without."""
    t = truth.join(matches.select(frame, "g", "p"), [frame, "g"], "left").join(found.select(frame, "p", F.col(f_class).alias("_f")), [frame, "p"], "left")
    hits = t.select(F.coalesce(F.col(t_class), F.lit("<missing>")).alias("truth"), F.when(F.col("p").isNull(), "missed").otherwise(F.coalesce("_f", F.lit("<missing>"))).alias("found"))
    free = found.join(matches.select(frame, "p"), [frame, "p"], "left_anti").select(F.lit("false_positive").alias("truth"), F.coalesce(F.col(f_class), F.lit("<missing>")).alias("found"))
    return hits.unionByName(free).groupBy("truth", "found").agg(F.count("*").alias("n"))


def signals_swapped(matches: DataFrame) -> DataFrame:
    """One row: red read as green, green read as red, of all red and green signals; columns content, pred_content."""
    t, f = text.content(F.col("content")), text.content(F.col("pred_content"))
    rows = matches.where(motion.present("content").isNotNull()).select(t.alias("t"), f.alias("f"))
    n = rows.agg(F.count_if(F.col("t").isin("red", "green")).alias("n_signal"), F.count_if((F.col("t") == "red") & (F.col("f") == "green")).alias("red_as_green"), F.count_if((F.col("t") == "green") & (F.col("f") == "red")).alias("green_as_red"))
    return n.withColumn("rate", rate(F.col("red_as_green") + F.col("green_as_red"), F.col("n_signal")))


def collapsed_to_moving(matches: DataFrame) -> DataFrame:
    """(label, n): coarse behaviours other than moving that were read as moving; columns state, pred_state."""
    coarse = lambda c: text.coarse_behaviour(text.behaviour(F.col(c)))
    # texts are read once for each pair of them, not for each match; a filter on the classes would move below the first count
    pairs = matches.where(motion.present("state").isNotNull()).groupBy("state", "pred_state").agg(F.count("*").alias("n"))
    rows = pairs.select(coarse("state").alias("label"), coarse("pred_state").alias("found"), "n")
    wrong = (F.col("found") == "moving") & (F.col("label") != "moving")
    return rows.groupBy("label").agg(F.sum(F.when(wrong, F.col("n"))).alias("n")).where("n IS NOT NULL")


def side_agrees(location: Column, x: Column, width: float) -> Column:
    """Whether the side that a location text names is the one of its pixel; NULL where it names none."""
    named = text.location_slots(location)["direction"]
    return F.when(named.isNotNull() & x.isNotNull(), direction(x, width) == named)


def location_errors(matches: DataFrame) -> DataFrame:
    """One row over matched objects (d, w, h, typed): share inside, share near, median and 90th percentile of the distance, plain and by gate; and of the rightly typed."""
    near, gate = F.col("d") <= location_gate(F.col("w"), F.col("h")), F.greatest(F.hypot("w", "h") * 0.5, F.lit(1e-6))
    typed = lambda c: F.when(F.col("typed"), c)
    rates = matches.agg(
        accuracy(F.col("d") == 0).alias("in_mask_rate"), accuracy(near).alias("near_rate"), mean_valid(F.col("d")).alias("px_mean"), accuracy(typed(F.col("d") == 0)).alias("in_mask_rate_typed"), accuracy(typed(near)).alias("near_rate_typed"),
    )
    kinds = {"px": F.col("d"), "norm": F.col("d") / gate, "px_typed": typed(F.col("d"))}
    long = matches.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("double").alias("v")) for k, c in kinds.items()])).alias("x")).select("x.*")
    q = quantiles(long, ["kind"], "v", [0.5, 0.9])
    at = lambda kind, i: F.max(F.when(F.col("kind") == kind, F.col("q")[i]))
    wide = q.agg(at("px", 0).alias("px_median"), at("px", 1).alias("px_p90"), at("norm", 0).alias("norm_median"), at("norm", 1).alias("norm_p90"), at("px_typed", 0).alias("px_median_typed"))
    return rates.join(F.broadcast(wide), F.lit(True))
