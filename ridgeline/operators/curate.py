"""Index, caches and profiles of a frame collection, and the summaries over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geometry, motion, text, vocab
from ridgeline.operators.aggregate import accuracy, class_report, confusion, rate
from ridgeline.operators.select import few_enough, hint, seeded


def complete_frames(*scans: DataFrame, key: str = "frame_key") -> DataFrame:
    """Frames of the first scan that every other scan has too, in order of scene and number."""
    rows = reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), scans[1:], scans[0])
    return rows.orderBy("scene_id", "frame_no")


def is_rated(preferences: Column) -> Column:
    """Whether any preference entry has positions."""
    return F.coalesce(F.exists(preferences, lambda p: F.size(p["pos_x"]) > 0), F.lit(False))


def rated_trajectories(preferences: Column) -> Column:
    """Entries with a real score (not -1) and positions, as paths with their score."""
    real = F.filter(preferences, lambda p: (p["preference_score"] != -1) & p["pos_x"].isNotNull())
    return F.transform(real, lambda p: F.struct(motion.points(p["pos_x"], p["pos_y"]).alias("path"), p["preference_score"].alias("score")))


def valid_frames(df: DataFrame, past: str = "past_states", future: str = "future_states") -> DataFrame:
    """Frames with 16 past samples in four series and 20 future ones."""
    enough = [F.size(F.col(f"{past}.{c}")) >= motion.PAST for c in ("pos_x", "pos_y", "vel_x", "vel_y")] + [F.size(F.col(f"{future}.{c}")) >= motion.FUTURE for c in ("pos_x", "pos_y")]
    return df.where(reduce(lambda a, b: a & b, enough))


def truth_grid(pts: Column, padded: bool = False) -> Column:
    """20 samples, or NULL if there are fewer; padded: the last one is held."""
    held = lambda p: F.slice(F.concat(p, F.array_repeat(F.try_element_at(p, F.lit(-1)), motion.FUTURE)), 1, motion.FUTURE)
    return F.when(F.size(pts) > 0, text.let(pts, held)) if padded else F.when(F.size(pts) >= motion.FUTURE, F.slice(pts, 1, motion.FUTURE))


def current_speed(vel_x: Column, vel_y: Column, pos_x: Column, pos_y: Column, fallback: str = "positions") -> Column:
    """Speed now, in m/s. Without velocities: from positions as the labels do, by the last difference ("difference"), or zero ("zero").

    "x only" takes a missing lateral velocity as zero, and needs a forward one.
    """
    if fallback == "x only":
        return F.coalesce(F.hypot(F.try_element_at(vel_x, F.lit(-1)), F.coalesce(F.try_element_at(vel_y, F.lit(-1)), F.lit(0.0))), F.lit(0.0))
    v = F.hypot(F.try_element_at(vel_x, F.lit(-1)), F.try_element_at(vel_y, F.lit(-1)))
    if fallback == "zero":
        return F.coalesce(v, F.lit(0.0))
    d = F.hypot(F.try_element_at(pos_x, F.lit(-1)) - F.try_element_at(pos_x, F.lit(-2)), F.try_element_at(pos_y, F.lit(-1)) - F.try_element_at(pos_y, F.lit(-2))) / motion.STEP_S
    if fallback == "difference":
        return F.coalesce(v, d, F.lit(0.0))
    return F.coalesce(F.try_element_at(motion.past_speeds(vel_x, vel_y, pos_x, pos_y), F.lit(-1)), F.lit(0.0))


def kmh(speed: Column) -> Column:
    return speed * 3.6


def path_speeds(path: str, measured: str | None = None) -> Column:
    """Speeds of a path: measured ones where there are any, else its steps'."""
    steps = motion.future_speeds(F.col(path))
    return F.coalesce(F.col(measured), steps) if measured else steps


def label_path(df: DataFrame, path: str, v0: str, intent: str | None = None, speeds: str | None = None) -> DataFrame:
    """df with label (sample, lon, lat) of a path by the rules for frames; without a path it keeps.

    Without an intent the lateral class is that of the heading change alone. speeds: the path's measured
    speeds, which decide where there are any; steps of rounded positions are off by some 1e-9, which
    tells wrong classes for a change that equals its bound.
    """
    speeds = path_speeds(path, speeds)
    # as columns, since the rules ask for them again and again
    rows = df.withColumns({"_h": geometry.heading(F.col(path)), "_v_end": motion.end_speed(speeds), "_v_max": F.array_max(speeds)})
    v_end, v_max = F.col("_v_end"), F.col("_v_max")
    lat = motion.lat_class(F.col("_h.theta"), F.col("_h.residual"), F.col(intent)) if intent else motion.heading_class(F.col("_h.theta"))
    return rows.withColumn("label", F.struct(motion.sample_class(F.col(v0), v_end, v_max, "keep").alias("sample"), motion.lon_class(F.col(v0), v_end, v_max).alias("lon"), lat.alias("lat"))).drop("_h", "_v_end", "_v_max")


def with_errors(caches: DataFrame, frames: DataFrame, unreadable: DataFrame | None = None, key: str = "frame_key") -> DataFrame:
    """Cached rows with ``error``: what was wrong with a frame that has defaults only. unreadable: key, error, several per key give one."""
    known = frames.select(key).distinct().withColumn("_known", F.lit(True))
    rows = caches.join(known, key, "left")
    said = F.lit(None).cast("string")
    if unreadable is not None:
        rows, said = rows.join(unreadable.groupBy(key).agg(F.min("error").alias("_error")), key, "left"), F.col("_error")
    return rows.withColumn("error", F.coalesce(said, F.when(F.col("_known").isNull(), "no frame document"))).drop("_known", "_error")


def build_caches(index: DataFrame, frames: DataFrame, ann: DataFrame, key: str = "frame_key") -> DataFrame:
    """One keyed row per indexed frame: intent, context, event, objects, motion, flags. Unreadable frames keep defaults.

    frames: key, intent, intent_corrected, v0, future (path), and speeds (the future's, as measured) if there are any. ann: key, context, events, objects (type, intention, state, implication), reason, final_plan.
    """
    rows = index.select(key).join(frames, key, "left").join(ann, key, "left")
    c = vocab.norm_context(F.col("context"))
    none = F.coalesce(F.size("objects"), F.lit(0))
    rows = rows.withColumn("intent", motion.effective_intent("intent_corrected", "intent"))
    rows = label_path(rows.withColumn("v0", F.coalesce("v0", F.lit(0.0))), "future", "v0", "intent", "speeds" if "speeds" in frames.columns else None)
    said = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    complete = said(F.col("reason")) & said(F.col("final_plan")) & F.coalesce(F.forall("objects", lambda o: said(o["implication"])), F.lit(True))
    return rows.select(
        key, "intent", F.greatest(none, F.lit(0)).alias("n_objects"), F.coalesce(c["weather"], F.lit("Unknown")).alias("weather"), F.coalesce(c["visibility"], F.lit("Unknown")).alias("visibility"),
        F.coalesce(vocab.has_event(F.col("events")), F.lit(False)).alias("event"), F.col("label.lon").alias("motion_lon"), F.coalesce("label.lat", F.lit("straight")).alias("motion_lat"), F.col("label.sample").alias("sample_class"), "v0",
        F.coalesce(F.exists("objects", lambda o: vocab.minority(o["intention"], o["state"])), F.lit(False)).alias("has_minority_attr"), complete.alias("chain_complete"),
    )


def norm_index_row(row: Column) -> Column:
    """struct(intent, n_objects) of a cached row in VARIANT: a list [intent, n], or an object with its names of old and new."""
    get = lambda path, kind: F.try_variant_get(row, path, kind)
    text_ = lambda *paths: F.coalesce(*[F.nullif(get(p, "string"), F.lit("")) for p in paths], F.lit("GO_STRAIGHT"))
    number = lambda *paths: F.coalesce(*[get(p, "int") for p in paths], F.lit(0))
    listed = F.schema_of_variant(row).startswith("ARRAY")
    return F.when(listed, F.struct(text_("$[0]").alias("intent"), number("$[1]").alias("n_objects"))).otherwise(F.struct(text_("$.intent_corrected", "$.intent").alias("intent"), number("$.n_objects", "$.n_obj").alias("n_objects")))


def norm_context_row(row: Column) -> Column:
    """struct(weather, visibility, event) of a cached row in VARIANT, a list or an object."""
    get = lambda path, kind: F.try_variant_get(row, path, kind)
    known = lambda p: F.coalesce(F.nullif(get(p, "string"), F.lit("")), F.lit("Unknown"))
    listed = F.schema_of_variant(row).startswith("ARRAY")
    of_list = F.struct(known("$[0]").alias("weather"), known("$[1]").alias("visibility"), F.coalesce(get("$[2]", "int"), F.lit(0)).alias("event"))
    return F.when(listed, of_list).otherwise(F.struct(known("$.weather").alias("weather"), known("$.visibility").alias("visibility"), F.coalesce(get("$.has_interesting_event", "int"), get("$.interesting", "int"), F.lit(0)).alias("event")))


def derive_missing(index: DataFrame, cache: DataFrame, frames: DataFrame, ann: DataFrame, key: str = "frame_key") -> DataFrame:
    """Cached rows of the index, and rows derived from frames and annotations where the cache has none."""
    lacks = index.select(key).join(cache.select(key), key, "left_anti")
    have = cache.join(index.select(key), key, "left_semi")
    return have.unionByName(build_caches(lacks, frames, ann, key).select(have.columns))


def richest_frame(ann: DataFrame, key: str = "frame_key", least: int = 3) -> DataFrame:
    """The frame with the most explained objects (10 each) and both reason and plan (5), of those with three objects; of equals the first by key."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    explained = F.size(F.filter("objects", lambda o: said(o["implication"])))
    score = explained * 10 + F.when(said(F.col("reason")) & said(F.col("final_plan")), 5).otherwise(0)
    return ann.where(F.size("objects") >= least).withColumn("score", score).orderBy(F.desc("score"), key).limit(1)


def chain_pool(caches: DataFrame, partitions: list[str]) -> DataFrame:
    """Rows of the partitions whose chain is complete; an empty pool is an error."""
    pool = caches.where(F.col("partition").isin(partitions) & F.col("chain_complete"))
    if pool.isEmpty():
        raise ValueError("no complete chains in these partitions")
    return pool


def index_stats(df: DataFrame, kept: Column, negative: Column, by: str) -> DataFrame:
    """Per partition: scenes, frames scanned, kept, kept positives and negatives."""
    rows = df.withColumn("_k", kept).withColumn("_n", negative)
    return rows.groupBy(by).agg(F.countDistinct("scene_id").alias("scenes"), F.count("*").alias("scanned"), F.count_if("_k").alias("kept"), F.count_if(F.col("_k") & ~F.col("_n")).alias("pos"), F.count_if(F.col("_k") & F.col("_n")).alias("neg"))


def kept_by(df: DataFrame, kept: Column, *by: Column) -> DataFrame:
    """Kept frames by several properties, as by intent and whether they are empty."""
    return df.where(kept).groupBy(*by).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, by: str, kind: str, values: list[str], prefix: str = "sc_") -> DataFrame:
    """Counts of each class per group as columns."""
    found = df.groupBy(by).pivot(kind, values).count().na.fill(0)
    return found.select(by, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def scene_profile(df: DataFrame, order: str, intent: str, kind: str) -> DataFrame:
    """Per scene: frames, counts of start, stop, left and right, and the stratum of its majority intent and class (first of equals)."""
    from ridgeline.operators.aggregate import majority

    counts = df.groupBy("scene_id").agg(F.count("*").alias("n_frames"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in ("start", "stop")], F.count_if(F.col(intent) == "GO_LEFT").alias("n_left"), F.count_if(F.col(intent) == "GO_RIGHT").alias("n_right"))
    a, b = (majority(df, "scene_id", c, order).drop("n") for c in (intent, kind))
    return counts.join(a, "scene_id").join(b, "scene_id").withColumn("stratum", F.concat_ws("|", intent, kind)).drop(intent, kind)


def verify_sample(ann: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """One row over a seeded sample: checked, share with every value in its vocabulary, share with a corrected intent."""
    rows = ann.orderBy(seeded(seed, key), key).limit(n)
    ok = vocab.enum_ok(F.col("context"), F.col("events"))
    return rows.agg(F.count("*").alias("checked"), accuracy(ok).alias("enum_ok"), accuracy(motion.present("intent_corrected").isNotNull()).alias("corrected"))


def resolve_frames(preds: DataFrame, *trees: DataFrame, key: str = "frame_key", path: str = "path") -> DataFrame:
    """Each prediction with its frame's path in the first tree that has it, and which one: flat, marked, partitioned…"""
    rows = preds
    for i, t in enumerate(trees):
        rows = rows.join(t.groupBy(F.col(key)).agg(F.min(path).alias(f"_p{i}")), key, "left")
    found = F.coalesce(*[F.col(f"_p{i}") for i in range(len(trees))])
    which = F.coalesce(*[F.when(F.col(f"_p{i}").isNotNull(), F.lit(i)) for i in range(len(trees))])
    return rows.withColumn(path, found).withColumn("tree", which).drop(*[f"_p{i}" for i in range(len(trees))])


def with_frequency(df: DataFrame, value: str, freq: DataFrame) -> DataFrame:
    """df with the count of its value, exact or else without regard to case and outer blanks; freq: value, n (a vocabulary)."""
    norm = lambda c: F.lower(F.trim(c))
    exact = hint(freq.select(F.col("value").alias("_v"), F.col("n").alias("_n")))
    loose = hint(freq.groupBy(norm(F.col("value")).alias("_lv")).agg(F.max("n").alias("_ln")))
    return df.join(exact, F.col(value) == F.col("_v"), "left").join(loose, norm(F.col(value)) == F.col("_lv"), "left").withColumn("n", F.coalesce("_n", "_ln")).drop("_v", "_n", "_lv", "_ln")


def object_items(ann: DataFrame, frame: str) -> DataFrame:
    """(frame, object_pos, type, x, y) of every object with a stable point: one question each."""
    o = ann.select(frame, F.posexplode("objects").alias("object_pos", "o")).where("o.point IS NOT NULL")
    return o.select(frame, "object_pos", vocab.norm_type(F.col("o.type")).alias("type"), "o.point.x", "o.point.y")


def behaviour_metrics(matches: DataFrame, field: str = "state", collapse: bool = False) -> DataFrame:
    """Report per canonical behaviour of matched objects: columns <field> and pred_<field>; objects without a truth don't count."""
    canon = lambda c: text.coarse_behaviour(text.behaviour(c)) if collapse else text.behaviour(c)
    rows = matches.where(motion.present(field).isNotNull()).select(canon(F.col(field)).alias("truth"), canon(F.col(f"pred_{field}")).alias("found"))
    return class_report(confusion(rows, "truth", "found"))


def variant_summary(rows: DataFrame, variant: str, key: str, measure: str, base: str) -> DataFrame:
    """Per variant: rows, mean of the measure, and its mean difference from the base variant on common keys."""
    b = rows.where(F.col(variant) == base).select(key, F.col(measure).alias("_b"))
    return rows.join(b, key, "left").groupBy(variant).agg(F.count("*").alias("n"), F.avg(measure).alias("mean"), F.avg(F.col(measure) - F.col("_b")).alias("diff"), F.count("_b").alias("paired"))


def prep_summary(ready: DataFrame, skipped: DataFrame, intent: str = "intent") -> DataFrame:
    """Mean error per intent, and the numbers skipped by reason: (kind, name, n, ade5)."""
    a = ready.groupBy(intent).agg(F.count("*").alias("n"), F.avg("ade5").alias("ade5")).select(F.lit("intent").alias("kind"), F.col(intent).alias("name"), "n", "ade5")
    return a.unionByName(skipped.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("skipped").alias("kind"), F.col("reason").alias("name"), "n", F.lit(None).cast("double").alias("ade5")))


def pool_stats(caches: DataFrame, overlay: DataFrame, key: str = "frame_key") -> DataFrame:
    """One row: pool size, rows that an overlay patches, and the mix of sample classes as a map."""
    hit = caches.join(overlay.select(key).distinct().withColumn("_o", F.lit(True)), key, "left")
    mix = caches.groupBy("sample_class").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample_class", "n")))).alias("mix"))
    return hit.agg(F.count("*").alias("pool"), F.count("_o").alias("patched"), rate(F.count("_o"), F.count("*")).alias("share")).join(F.broadcast(mix), F.lit(True))


def project_points(points: DataFrame, cameras: DataFrame, key: str) -> DataFrame:
    """Ego points (key, x, y, z) as panorama pixels: per point the camera whose strip centre is nearest.

    cameras (a short table): camera, m (12 values, ego to camera by rows), fx, fy, cx, cy, offset, width.
    """
    if not few_enough(cameras, 1000):
        raise ValueError("more than 1000 cameras: every point would meet each of them")
    c = F.broadcast(cameras)
    rows = points.join(c, F.lit(True))
    row = lambda i: F.col("m")[4 * i] * F.col("x") + F.col("m")[4 * i + 1] * F.col("y") + F.col("m")[4 * i + 2] * F.col("z") + F.col("m")[4 * i + 3]
    rows = rows.select(key, "camera", "offset", "width", "fx", "fy", "cx", "cy", row(0).alias("_x"), row(1).alias("_y"), row(2).alias("_z")).where("_z > 0.1")
    u, v = F.col("fx") * F.col("_x") / F.col("_z") + F.col("cx"), F.col("fy") * F.col("_y") / F.col("_z") + F.col("cy")
    seen = rows.select(key, "camera", (u + F.col("offset")).alias("u"), v.alias("v"), F.abs(u - F.col("width") / 2).alias("_d"))
    return seen.groupBy(key).agg(F.min_by(F.struct("u", "v", "camera"), F.struct("_d", "camera")).alias("p")).select(key, "p.*")
