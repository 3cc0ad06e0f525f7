"""Evaluation of answers: records, wide metric aggregates, long tables, interventions, score preparation.

A record is one row per frame that joins answer and truth. Each metric family is one wide aggregation
of flag columns, over all rows and by slice in the same pass (grouping sets).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geometry, motion, text
from ridgeline.operators.aggregate import accuracy, by_slice, mean_valid, rate
from ridgeline.operators.match import match_multiset
from ridgeline.operators.order_stats import quantiles


def trajectory_summary(rows: DataFrame, slices: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """Rows need pred and truth (paths); within: columns that part the rows before the slices. Errors are means over rows with a prediction, the score over all rows."""
    e = rows.withColumn("_e", motion.displacement(F.col("pred"), F.col("truth")))
    one, three, five = (motion.average_error(F.col("_e"), n) for n in (4, 12, 20))
    scored = e.withColumns({"_1": one, "_3": three, "_5": five, "_f": motion.final_error(F.col("_e"))})
    return by_slice(
        scored, slices, F.count("*").alias("n"), rate(F.count("_e"), F.count("*")).alias("pred_rate"), mean_valid("_1").alias("ade1"), mean_valid("_3").alias("ade3"),
        mean_valid("_5").alias("ade5"), mean_valid("_f").alias("fde"), F.avg(motion.trajectory_score(F.col("_5"))).alias("traj_score"), within=within,
    )


def missing_flags(answer: Column) -> Column:
    """Which parts an answer lacks; implications count as missing if any object has none."""
    objects = answer["objects"]
    return F.struct(
        F.coalesce(answer["reason"] == "", F.lit(True)).alias("reason"),
        F.coalesce(answer["final_plan"] == "", F.lit(True)).alias("final_plan"),
        answer["motion"].isNull().alias("motion"),
        answer["traj"].isNull().alias("traj"),
        F.exists(objects, lambda o: F.coalesce(o["implication"] == "", F.lit(True))).alias("implication"),
    )


def chain_complete(reason: Column, plan: Column, implications: Column) -> Column:
    """Reason and plan are there and every object has an implication; true without objects."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return said(reason) & said(plan) & F.coalesce(F.forall(implications, said), F.lit(True))


def duplicate_objects(objects: Column) -> Column:
    """Whether a type and point stands twice in one answer."""
    keys = F.transform(F.filter(objects, lambda o: o["point"].isNotNull()), lambda o: F.struct(F.lower(o["type"]), o["point"]["x"], o["point"]["y"]))
    return F.size(F.array_distinct(keys)) < F.size(keys)


def object_metrics(truth: DataFrame, found: DataFrame, matches: DataFrame, frame: str) -> DataFrame:
    """One row: recall, precision, type accuracy among matched, mean distance, share within the location gate, rank-1 recall.

    truth: g, rank, class, w, h. found: p, pclass. matches: g, p, d.
    """
    from ridgeline.operators.match import location_gate

    hit = truth.join(matches, [frame, "g"], "left").join(found.select(frame, "p", "pclass"), [frame, "p"], "left").withColumn("_in", F.col("p").isNotNull())
    predicted = found.agg(F.count("*").alias("predicted"))
    per = hit.agg(
        F.count("*").alias("objects"), F.count_if("_in").alias("matched"), accuracy(F.col("_in")).alias("recall"), accuracy(F.when(F.col("rank") == 1, F.col("_in"))).alias("recall_rank1"),
        accuracy(F.when(F.col("_in"), F.col("class") == F.col("pclass"))).alias("type_acc"), mean_valid("d").alias("mean_distance"), accuracy(F.when(F.col("_in"), F.col("d") <= location_gate(F.col("w"), F.col("h")))).alias("loc_hit"),
    )
    return per.join(F.broadcast(predicted), F.lit(True)).withColumn("precision", rate(F.col("matched"), F.col("predicted")))


def typeonly_metrics(truth: DataFrame, found: DataFrame, frame: str, kind: str) -> DataFrame:
    """Recall, precision and f1 of class counts per frame, without geometry."""
    from ridgeline.operators.aggregate import prf

    sums = match_multiset(truth, found, frame, kind).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "missed", "extra")])
    return sums.select("*", *prf(F.col("tp"), F.col("extra"), F.col("missed")))


def long_metrics(wide: DataFrame, *keys: str) -> DataFrame:
    """(keys…, metric, value) of a wide metric table."""
    values = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double") for c in values]).unpivot(list(keys), values, "metric", "value")


def length_summary(answers: DataFrame, by: str | None = None, guards: tuple[str, ...] = ()) -> DataFrame:
    """Longest, mean and 99th percentile of new tokens, how many hit the cap, and sums of guard counters (columns that a NULL leaves as they are)."""
    keys = [by] if by else []
    sums = [F.coalesce(F.sum(F.col(g)), F.lit(0)).cast("long").alias(g.rpartition(".")[2]) for g in guards]
    found = answers.groupBy(*keys).agg(F.max("n_new_tokens").alias("longest"), F.avg("n_new_tokens").alias("mean"), F.count_if("hit_cap").alias("hit_cap"), *sums, F.count("*").alias("n"))
    p = quantiles(answers, keys, "n_new_tokens", [0.99]).select(*[F.col(k).alias("_k") for k in keys], F.col("q")[0].alias("p99"))
    return found.join(p, F.col(by).eqNullSafe(F.col("_k")) if by else F.lit(True), "left").drop("_k")


def judge_items(rows: DataFrame, frame: str) -> DataFrame:
    """(frame, object_pos, reference, prediction) of matched objects' implications, the frame's object texts as context."""
    context = F.array_join(F.transform("objects", lambda o: F.concat_ws(": ", o["type"], o["location"])), "; ")
    items = rows.select(frame, context.alias("context"), F.posexplode("objects").alias("object_pos", "o"))
    return items.select(frame, "object_pos", "context", F.col("o.reference").alias("reference"), F.coalesce("o.prediction", F.lit("")).alias("prediction"))


def judged(items: DataFrame, judge: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], frame: str) -> DataFrame:
    """Verdicts of a pluggable judge; an empty prediction is zero without asking, a failed reply is NULL."""
    empty = items.where(F.trim("prediction") == "").select(frame, "object_pos", F.lit(0).alias("cause"), F.lit(0).alias("effect"))
    kind = dict(items.dtypes)
    asked = items.where(F.trim("prediction") != "").mapInPandas(judge, f"{frame} {kind[frame]}, object_pos int, reply string")
    v = text.verdict(F.col("reply"))
    return empty.unionByName(asked.select(frame, "object_pos", v["cause"].alias("cause"), v["effect"].alias("effect")))


#: The plan sentence that stands for each motion in a counterfactual.
COUNTERFACTUAL = {"stop": "decelerate to a stop", "decelerate": "decelerate", "keep": "keep lane and cruise", "accelerate": "accelerate"}


def intervention_prefixes(base: DataFrame, answer: str, lon: str, one: bool = False) -> DataFrame:
    """base with ``target`` and ``prefix``: the answer up to its plan, with the plan of every other motion (or the first) in its place.

    An answer without a plan gives no row.
    """
    targets = F.filter(F.array(*[F.lit(k) for k in COUNTERFACTUAL]), lambda t: t != F.col(lon))
    rows = base.where(F.col(answer).contains("<final_plan>")).withColumn("target", F.explode(F.slice(targets, 1, 1) if one else targets))
    sentence = F.element_at(F.create_map(*[F.lit(v) for kv in COUNTERFACTUAL.items() for v in kv]), F.col("target"))
    head = F.substring_index(answer, "<final_plan>", 1)
    return rows.withColumn("prefix", F.concat(head, F.lit("<final_plan>"), sentence, F.lit("</final_plan>")))


def intervention_metrics(rows: DataFrame, slices: list[str]) -> DataFrame:
    """Rows: kind (self or swap), target_lon, base_derived_lon, derived_lon. Follow and change rates, self-follow apart."""
    swap, follow = F.col("kind") == "swap", F.col("derived_lon") == F.col("target_lon")
    return by_slice(rows, slices, F.count("*").alias("n"), accuracy(F.when(swap, follow)).alias("follow_rate"), accuracy(F.when(swap, F.col("derived_lon") != F.col("base_derived_lon"))).alias("change_rate"), accuracy(F.when(~swap, follow)).alias("self_follow_rate"), *([F.avg(F.when(~swap, F.col("ade_vs_base"))).alias("reproduction_ade")] if "ade_vs_base" in rows.columns else []))


def with_base(rows: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Intervention rows with their frame's base row: base_derived_lon, base_ade5, whether the motion changed, and the mean distance of the paths."""
    b = base.select(key, F.col("derived_lon").alias("base_derived_lon"), F.col("ade5").alias("base_ade5"), F.col("pred").alias("_base"))
    both = rows.join(b, key)
    changed = F.col("derived_lon") != F.col("base_derived_lon")
    apart = motion.array_mean(motion.displacement(F.col("pred"), F.col("_base")))
    return both.withColumn("changed_vs_base", changed).withColumn("ade_vs_base", F.when(F.size("pred") == F.size("_base"), apart)).drop("_base")


def with_scores(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Rows with their score, NULL where there is none."""
    return rows.join(scores.groupBy(key).agg(F.max("score").alias("score")), key, "left")


def coalesce_aliases(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Record fields under their canonical names: the first of the names that is there and not NULL."""
    have = set(rows.columns)
    found = {name: [c for c in names if c in have] for name, names in aliases.items()}
    out = rows.withColumns({f"_a_{n}": F.coalesce(*[F.col(c) for c in cs]) if cs else F.lit(None) for n, cs in found.items()})
    rest = [c for c in rows.columns if c not in {c for cs in found.values() for c in cs}]
    return out.select(*rest, *[F.col(f"_a_{n}").alias(n) for n in aliases])


def history_clause(frame: dict[str, str], steps: int = 6) -> Column:
    """``(t-3.0s) [x, y], Acceleration…, Velocity…`` every half second up to now, relative to it, of the six series named in frame."""
    at = lambda name, i: F.get(F.col(frame[name]), i)
    n = F.size(F.col(frame["pos_x"]))

    def item(k: Column) -> Column:
        i, last = n - 1 - 2 * k, n - 1
        place = [at(c, i) - at(c, last) for c in ("pos_x", "pos_y")]
        speed = F.hypot(at("vel_x", i), at("vel_y", i))
        return F.format_string("(t-%.1fs) [%.2f, %.2f], Acceleration: X %.2f, Y %.2f m/s^2, Velocity: %.2f m/s", k * 0.5, *place, at("accel_x", i), at("accel_y", i), speed)

    back = F.filter(F.sequence(F.lit(steps), F.lit(0), F.lit(-1)), lambda k: n - 1 - 2 * k >= 0)
    return F.array_join(F.transform(back, item), ", ")


def planning_pairs(answer: Column) -> Column:
    """Bracket pairs of <PLANNING>, or of the whole text without it; NULL without any."""
    body = F.when(answer.contains("<PLANNING>"), F.regexp_extract(answer, r"(?s)<PLANNING>(.*?)(?:</PLANNING>|$)", 1)).otherwise(answer)
    return text.let(text.bracket_pairs(body), lambda p: F.when(F.size(p) > 0, p))


def prepare_scores(preds: DataFrame, frames: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ready, skipped): predictions resampled to 20 samples with their error; those without a frame or a full truth, with the reason.

    preds: key, pred (path), seconds (between points). frames: key, truth (path), v0, raters.
    """
    both = preds.join(frames, key, "left").withColumn("reason", F.when(F.col("truth").isNull(), "no frame").when(F.size("truth") < 20, "short future").when(F.col("pred").isNull() | (F.size("pred") == 0), "no prediction"))
    ready = both.where("reason IS NULL").withColumn("pred", motion.resample(F.col("pred"), F.col("seconds")))
    errors = motion.displacement(F.col("pred"), F.slice("truth", 1, 20))
    return ready.withColumn("ade5", motion.average_error(errors, 20)).drop("reason"), both.where("reason IS NOT NULL").select(key, "reason")


def score_with(ready: DataFrame, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rater scores by a pluggable batch function (the official formula is not part of this library)."""
    return ready.mapInPandas(score, schema)


def nearest_rater_score(key: str) -> tuple[Callable, str]:
    """An example function for score_with, not an official formula: the score of the rater path whose end is nearest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pred, raters in zip(batch["pred"], batch["raters"], strict=True):
                end = pred[-1]
                near = min(raters, key=lambda r: (r["x"] - end["x"]) ** 2 + (r["y"] - end["y"]) ** 2, default=None) if raters is not None and len(raters) else None
                out.append(None if near is None else near["score"])
            yield pd.DataFrame({key: batch[key], "score": out})

    return run, f"{key} string, score double"


def reference_predictions(frames: DataFrame, key: str, keep: tuple[str, ...] = (), kinds: tuple[str, ...] = ("gt", "cv", "static", "ceiling")) -> DataFrame:
    """(key, kept columns, kind, pred): the truth, constant velocity, standing still, and the truth through the answer format.

    One pass over the frames, which give a row for each kind; keep: what the caller needs beside it.
    """
    zero = F.array_repeat(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), 20)
    preds = {"gt": lambda: F.col("truth"), "cv": lambda: motion.constant_velocity(F.col("vx"), F.col("vy")), "static": lambda: zero, "ceiling": lambda: geometry.upsample(motion.points_1hz(F.col("truth")))}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), preds[k]().alias("pred")) for k in kinds])
    return frames.select(key, *keep, F.explode(each).alias("_each")).select(key, *keep, "_each.kind", "_each.pred")


def trajectory_profile(paths: DataFrame, path: str, speeds: str | None = None) -> DataFrame:
    """One row: mean and largest extent ahead and aside, speed and its change, curvature by the end point, and how many end left, right or neither (half a metre).

    speeds: past speeds, for the speed and its change; without them the speed is the path's.
    """
    pts = F.col(path)
    x, y = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: F.abs(p["y"]))
    end, ahead = F.try_element_at(pts, F.lit(-1))["y"], F.array_max(x)
    past = F.col(speeds) if speeds else motion.future_speeds(pts)
    rows = paths.select(ahead.alias("ahead"), F.array_max(y).alias("aside"), motion.array_mean(past).alias("speed"), F.when(F.size(past) > 1, F.try_element_at(past, F.lit(-1)) - F.get(past, F.lit(0))).alias("change"), F.when(ahead > 0.1, F.abs(end) / ahead).alias("curve"), end.alias("end"))
    return rows.agg(
        F.avg("ahead").alias("ahead"), F.avg("aside").alias("aside"), F.max("aside").alias("aside_max"), F.avg("speed").alias("speed"), F.stddev_pop("speed").alias("speed_sd"), F.avg("change").alias("speed_change"), F.avg("curve").alias("curvature"),
        F.count_if(F.col("end") > 0.5).alias("left"), F.count_if(F.col("end") < -0.5).alias("right"), F.count_if(F.abs("end") <= 0.5).alias("neither"),
    )
