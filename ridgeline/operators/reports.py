"""Reports at width from confusion counts: one pass makes a long table (kind, truth, found, n), and every rate of a report is read off it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import motion, text, vocab
from ridgeline.operators import plans
from ridgeline.operators.aggregate import accuracy, by_slice, rate
from ridgeline.operators.match import match_multiset
from ridgeline.operators.metrics import counts_of, said, side_agrees, sure

MISSED, FALSE_POSITIVE = "missed", "false_positive"
#: Labels of the coarse table of signal contents; classes whose behaviour counts; the gate of interventions.
CONTENT_MAIN = ("red", "green", "yellow", "stop", "other")
BEHAVING, SIGNALLING = ("vehicle", "vulnerable user"), "traffic control"
FOLLOW_GATE = 0.70


def class_rows(matrix: DataFrame) -> DataFrame:
    """(kind, label, n, recall, precision, missed) of every truth label; what was found without a truth counts against precision."""
    own = F.col("truth") == F.col("found")
    t = matrix.where(F.col("truth") != FALSE_POSITIVE).groupBy("kind", F.col("truth").alias("label")).agg(F.sum("n").alias("n"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("found") == MISSED, F.col("n")).otherwise(0)).alias("missed"))
    p = matrix.groupBy("kind", F.col("found").alias("label")).agg(F.sum("n").alias("as"))
    both = t.join(p, ["kind", "label"], "left")
    return both.select("kind", "label", "n", rate(F.col("tp"), F.col("n")).alias("recall"), rate(F.col("tp"), F.col("as")).alias("precision"), "missed")


def kind_rows(matrix: DataFrame, least: int = 10) -> DataFrame:
    """(kind, n, acc, macro_recall, macro_recall_min, majority_class, majority_baseline): mean recall over all labels, and over those with enough support."""
    per = class_rows(matrix)
    total = F.sum("n")
    return per.groupBy("kind").agg(
        total.alias("n"), rate(F.sum(F.col("recall") * F.col("n")), total).alias("acc"), F.avg("recall").alias("macro_recall"), F.avg(F.when(F.col("n") >= least, F.col("recall"))).alias("macro_recall_min"),
        F.max_by("label", F.struct("n", "label")).alias("majority_class"), rate(F.max("n"), total).alias("majority_baseline"),
    )


def plan_confusions(flags: DataFrame) -> DataFrame:
    """Confusions of the closed plan vocabulary, lat and lon, of chain_flags()'s rows. Truths that name no speed, or no known lateral class, are left out."""
    rows = flags.where(said(F.col("gt_plan"))).withColumn("_t", plans.taxonomy(F.col("gt_plan_read"))).withColumn("_f", F.when(said(F.col("answer.final_plan")), plans.taxonomy(F.col("plan_read"))))
    known = {"lat": F.col("_t.lateral") != "other", "lon": ~F.col("_t.longitudinal").isin("unspecified", "unmatched")}
    return counts_of(rows, {"lat": (F.col("_t.lateral"), F.col("_f.lateral")), "lon": (F.col("_t.longitudinal"), F.col("_f.longitudinal"))}, known, missing="<missing>")


def behaviour_confusions(matches: DataFrame) -> DataFrame:
    """Confusions of what found objects do and signals show, fine and coarse: state, intention, content. matches: type, state, intention, content, hit and pred_ columns.

    Behaviours count for vehicles and vulnerable users, contents for traffic controls, where the truth states one.
    """
    kind = text.let(text.canonical(F.col("type")), vocab.dataset_class)
    behaves, signals = kind.isin(*BEHAVING), kind == SIGNALLING
    cells = [F.when(ok & said(F.col(c)), F.struct(F.lit(c).alias("field"), F.col(c).alias("t"), F.col(f"pred_{c}").alias("f"))) for c, ok in (("state", behaves), ("intention", behaves), ("content", signals))]
    # wordings are few: they are counted first, and the rules read each pair once
    words = matches.where(sure(F.col("hit"))).select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").groupBy("c.field", "c.t", "c.f").agg(F.count("*").alias("n"))
    doing, shown = words.where("field <> 'content'"), words.where("field = 'content'")
    doing = doing.withColumns({"t": text.behaviour(F.col("t")), "f": text.behaviour(F.col("f"))}).groupBy("field", "t", "f").agg(F.sum("n").alias("n"))
    shown = shown.withColumns({"t": text.content(F.col("t")), "f": text.content(F.col("f"))}).groupBy("field", "t", "f").agg(F.sum("n").alias("n"))
    main = lambda c: F.when(c.isin(*CONTENT_MAIN), c).otherwise("other")
    out = []
    for rows, rough, name in ((doing, text.coarse_behaviour, "coarse"), (shown, main, "main")):
        both = F.array(F.struct(F.lit("fine").alias("k"), F.col("t").alias("t"), F.col("f").alias("f")), F.struct(F.lit(name).alias("k"), rough(F.col("t")).alias("t"), rough(F.col("f")).alias("f")))
        one = rows.select("field", "n", F.explode(both).alias("x"))
        out.append(one.groupBy(F.concat_ws("_", "field", "x.k").alias("kind"), F.col("x.t").alias("truth"), F.col("x.f").alias("found")).agg(F.sum("n").cast("long").alias("n")))
    return out[0].unionByName(out[1])


def behaviour_summary(matches: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: how many truths state a behaviour or content and how many of these were found, what was read as moving, and red and green swapped."""
    rows = matches.withColumn("_class", text.let(text.canonical(F.col("type")), vocab.dataset_class)).withColumn("_hit", sure(F.col("hit")))
    state, content = F.col("_class").isin(*BEHAVING) & said(F.col("state")), (F.col("_class") == SIGNALLING) & said(F.col("content"))
    coverage = rows.agg(F.count_if(state).alias("state_gt"), F.count_if(state & F.col("_hit")).alias("state_scored"), F.count_if(content).alias("content_gt"), F.count_if(content & F.col("_hit")).alias("content_scored"))
    n = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("long")
    kind, t, f = F.col("kind"), F.col("truth"), F.col("found")
    light = kind == "content_fine"
    counts = matrix.agg(
        n((kind == "state_coarse") & (f == "moving") & (t != "moving")).alias("collapsed_to_moving"), n(light & t.isin("red", "green")).alias("n_signal"),
        n(light & (t == "red") & (f == "green")).alias("red_as_green"), n(light & (t == "green") & (f == "red")).alias("green_as_red"),
    )
    both = coverage.join(F.broadcast(counts), F.lit(True))
    return both.withColumn("swapped_rate", rate(F.col("red_as_green") + F.col("green_as_red"), F.col("n_signal")))


def attribute_confusions(matches: DataFrame) -> DataFrame:
    """(kind, truth, found, n) of attributes that a found object got wrong: direction, lane, intention and state."""
    rows = matches.where(sure(F.col("hit"))).withColumn("_t", text.location_slots(F.col("location"))).withColumn("_f", text.location_slots(F.col("pred_location")))
    pairs, where = {}, {}
    for slot in ("direction", "lane"):
        t, f = F.col(f"_t.{slot}"), F.col(f"_f.{slot}")
        pairs[slot], where[slot] = (t, f), t.isNotNull() & ~sure(t == f)
    for field in ("intention", "state"):
        t, f = text.canonical(F.col(field)), text.canonical(F.col(f"pred_{field}"))
        pairs[field], where[field] = (t, f), motion.present(field).isNotNull() & ~sure(text.loosely_equal(F.col(f"pred_{field}"), F.col(field)))
    return counts_of(rows, pairs, where)


def prediction_rates(found: DataFrame, truth: DataFrame, width: float, slices: list[str]) -> DataFrame:
    """(slice, value, n_pred_objects, n_fp_objects, obj_precision, direction_pixel_consistency, gt_direction_pixel_consistency).

    found: location, x (pixel), matched, and the slice columns. truth: location, x (centre of the box),
    and the slice columns. Consistency is judged where a location names a side; a missing pixel is not judged.
    """
    sides = [c for c in slices]
    one = found.select(*sides, F.lit(True).alias("_p"), sure(F.col("matched")).alias("_m"), side_agrees(F.col("location"), F.col("x"), width).alias("_a"))
    two = truth.select(*sides, F.lit(False).alias("_p"), F.lit(None).cast("boolean").alias("_m"), side_agrees(F.col("location"), F.col("x"), width).alias("_a"))
    p = F.col("_p")
    out = by_slice(one.unionByName(two), slices, F.count_if(p).alias("n_pred_objects"), F.count_if(p & ~F.col("_m")).alias("n_fp_objects"), accuracy(F.when(p, F.col("_m"))).alias("obj_precision"), accuracy(F.when(p, F.col("_a"))).alias("direction_pixel_consistency"), accuracy(F.when(~p, F.col("_a"))).alias("gt_direction_pixel_consistency"))
    return out


def typeonly_report(frames: DataFrame, truth: DataFrame, found: DataFrame, frame: str) -> tuple[DataFrame, DataFrame]:
    """(one row of all rates, one row per class) of types without points, by counts per frame: an upper bound on what places would give.

    frames: frame, says (has_objects, may be NULL). truth: frame, class, fine, rank. found: frame, class, fine.
    A frame says that there are objects if it names one or says so. A rank-1 object is found if its class is named at all.
    """
    some = lambda df, name: df.select(frame).distinct().withColumn(name, F.lit(True))
    f = frames.select(frame, "says").join(some(truth, "_t"), frame, "left").join(some(found, "_f"), frame, "left")
    t, p = sure(F.col("_t")), sure(F.col("_f")) | sure(F.col("says"))
    presence = f.agg(F.count("*").alias("n_frames"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    presence = presence.select("*", rate(F.col("tp") + F.col("tn"), F.col("n_frames")).alias("presence_acc"), rate(F.col("tp") + F.col("fn"), F.col("n_frames")).alias("presence_always_yes"))
    classes = match_multiset(truth, found, frame, "class").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "missed", "extra")])
    per = classes.select("class", (F.col("tp") + F.col("missed")).alias("n"), rate(F.col("tp"), F.col("tp") + F.col("missed")).alias("recall"), rate(F.col("tp"), F.col("tp") + F.col("extra")).alias("precision"), "missed", F.col("extra").alias("false_positive"))
    total = classes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in ("tp", "missed", "extra")])
    fine = match_multiset(truth, found, frame, "fine").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("_fine"))
    named = found.select(frame, "class").distinct().withColumn("_named", F.lit(True))
    first = truth.where("rank = 1").join(named, [frame, "class"], "left").agg(accuracy(sure(F.col("_named"))).alias("det_recall_rank1"))
    n_gt, n_pred = F.col("_tp") + F.col("_missed"), F.col("_tp") + F.col("_extra")
    rates = {"n_gt_objects": n_gt, "n_pred_objects": n_pred, "det_recall": rate(F.col("_tp"), n_gt), "det_precision": rate(F.col("_tp"), n_pred), "fine_type_recall": rate(F.col("_fine"), n_gt), "n_false_positive": F.col("_extra")}
    one = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [presence, total, fine, first])
    return one.withColumns(rates).drop("_tp", "_missed", "_extra", "_fine"), per


def intervention_report(rows: DataFrame) -> DataFrame:
    """Rows: kind (intervene or control), target_lon, derived_lon, base_derived_lon, sample_class, ade5 and ade_vs_base (NULL without a path).

    (slice, value, …) over all rows, by target and by class: what follows its target, where no path
    follows nothing; what changed against the base; paths at all; the error of intervened paths; the
    control's own following and reproduction; and whether the follow rate passes its gate.
    """
    inter = F.col("kind") == "intervene"
    follow = sure(F.col("derived_lon") == F.col("target_lon"))
    changed = F.col("derived_lon") != F.col("base_derived_lon")
    when = lambda c: F.when(inter, c)
    found = by_slice(
        rows, ["target_lon", "sample_class"], F.count_if(inter).alias("n_intervened"), F.count_if(~inter).alias("n_control"), accuracy(when(follow)).alias("follow_rate"), accuracy(when(changed)).alias("changed_vs_base_rate"),
        accuracy(when(F.col("derived_lon").isNotNull())).alias("pred_rate"), F.avg(F.nanvl(when(F.col("ade5")), F.lit(None).cast("double"))).alias("intervened_ade5"), accuracy(F.when(~inter, follow)).alias("self_follow_rate"), F.avg(F.when(~inter, F.col("ade_vs_base"))).alias("reproduction_ade"),
    )
    return found.withColumn("passed", F.col("follow_rate") >= FOLLOW_GATE)


def attribute_values(objects: DataFrame, *fields: str) -> DataFrame:
    """(field, value, n): values of attributes over objects whose type owns the field, blank ones left out; most frequent first, ties by value. objects: type and the fields."""
    owns = vocab.type_fields(vocab.norm_type(F.col("type")))
    cells = [F.when(F.array_contains(owns, f) & said(F.col(f)), F.struct(F.lit(f).alias("field"), F.trim(f).alias("value"))) for f in fields]
    rows = objects.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL")
    return rows.groupBy("c.field", "c.value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value", "field")


def with_prefix(rows: DataFrame, rule, out: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """(rows with the prefix that a rule gives each frame, rows that it skips). rule: a function of rows to a column, NULL where a frame is skipped."""
    marked = rows.withColumn(out, rule(rows))
    return marked.where(F.col(out).isNotNull()), marked.where(F.col(out).isNull()).drop(out)


def same_type(found: Column, truth: Column) -> Column:
    """Loose equality of types, as typed matching takes it: equal or one held in the other, once canonical."""
    return sure(text.loosely_equal(found, truth))
