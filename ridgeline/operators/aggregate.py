"""Metric kernel: rates, confusion, reports, slices, comparisons, gates.

No support is NULL, never zero. Everything is partial aggregation over rows or over exploded rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.select import hint


def rate(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def mean_valid(c: Column | str) -> Column:
    """Mean that skips NULL and NaN."""
    return F.avg(F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None).cast("double")))


def accuracy(ok: Column) -> Column:
    """Share of true among judged rows; NULL is not judged."""
    return F.avg(ok.cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 of summed counts; NULL without any count, zero where only the denominator lacks."""
    some = (tp + fp + fn) > 0
    p, r = F.coalesce(rate(tp, tp + fp), F.lit(0.0)), F.coalesce(rate(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.when(some, x).alias(name) for x, name in ((p, "precision"), (r, "recall"), (f, "f1"))]


def set_f1(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Micro precision, recall and f1 of sets per row."""
    t, f = F.array_distinct(truth), F.array_distinct(found)
    sizes = df.select(F.size(F.array_intersect(t, f)).alias("tp"), F.size(F.array_except(f, t)).alias("fp"), F.size(F.array_except(t, f)).alias("fn"))
    sums = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def marginals(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) of several columns in one pass by grouping sets."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sets = rows.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    k = len(columns)
    field = reduce(lambda out, i: F.when(F.col("_g") == (1 << k) - 1 - (1 << (k - 1 - i)), columns[i]).otherwise(out), range(k), F.lit(None).cast("string"))
    value = reduce(lambda out, i: F.when(F.col("field") == columns[i], F.col(columns[i])).otherwise(out), range(k), F.lit(None).cast("string"))
    return sets.withColumn("field", field).select("field", value.alias("value"), "n")


def by_slice(df: DataFrame, slices: list[str], *measures: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """(slice, value, measures…) over all rows (slice ``all``) and by each slice column, in one pass; within: columns that part the rows first."""
    rows = df.withColumns({f"_s_{c}": F.col(c).cast("string") for c in slices})
    keys = [f"_s_{c}" for c in slices]
    found = rows.groupingSets([[*within], *[[*within, k] for k in keys]], *within, *keys).agg(F.grouping_id().alias("_g"), *measures)
    n = len(slices)
    name = reduce(lambda out, i: F.when(F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i)), slices[i]).otherwise(out), range(n), F.lit("all"))
    names = [c for c in found.columns if c not in (*within, *keys, "_g")]
    return found.select(*within, name.alias("slice"), F.coalesce(*keys).alias("value"), *names)


def capped_histogram(df: DataFrame, column: str, cap: int = 8) -> DataFrame:
    return df.groupBy(F.least(F.col(column), F.lit(cap)).alias("bucket")).agg(F.count("*").alias("n"))


def frequency(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of values, most frequent first, ties by value."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    return frequency(df, column).limit(k)


def examples(df: DataFrame, order: str, k: int, *unique: str) -> DataFrame:
    """The first row of each distinct key in order, at most k keys."""
    first = df.groupBy(*unique).agg(F.min_by(F.struct(*[c for c in df.columns if c not in unique]), order).alias("_r"))
    return first.select(*unique, "_r.*").select(df.columns).orderBy(order).limit(k)


def majority(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value per group; of equals the one that appears first."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("m")).select(group, f"m.{value}", "m.n")


def confusion(df: DataFrame, truth: str, found: str, missing: str = "<missing>") -> DataFrame:
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(missing))
    return df.groupBy(name(truth).alias("truth"), name(found).alias("found")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(label, support, found, tp, recall, precision) from confusion counts."""
    t = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("found"), F.col("n"))), F.lit(0)).alias("tp"))
    p = matrix.groupBy(F.col("found").alias("label")).agg(F.sum("n").alias("found"))
    both = t.join(p, "label", "full_outer").na.fill(0, ["support", "tp", "found"])
    both = both.where(F.col("label").isin(labels)) if labels else both
    return both.select("label", "support", "found", "tp", rate(F.col("tp"), F.col("support")).alias("recall"), rate(F.col("tp"), F.col("found")).alias("precision"))


def macro_recall(report: DataFrame, least: int = 10) -> DataFrame:
    """Mean recall over labels with enough support, accuracy, and the majority class with its share."""
    total = F.sum("support")
    return report.agg(
        F.avg(F.when(F.col("support") >= least, F.col("recall"))).alias("macro_recall"),
        rate(F.sum("tp"), total).alias("accuracy"),
        F.max_by("label", F.struct(F.col("support"), F.col("label"))).alias("majority_class"),
        rate(F.max("support"), total).alias("majority_share"),
    )


def leaderboard(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """One row: the mean over clusters of their means (without Unknown), the mean over rows, and the clusters."""
    per = df.groupBy(F.coalesce(cluster, F.lit("Unknown")).alias("c")).agg(mean_valid(score).alias("m"), F.count(score).alias("n"), F.sum(score).alias("s"))
    known = F.col("c") != "Unknown"
    return per.agg(F.avg(F.when(known, F.col("m"))).alias("cluster_mean"), F.try_divide(F.sum("s"), F.sum("n")).alias("row_mean"), F.count_if(known).alias("clusters"))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not NULL."""
    have = [F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts]
    value = [F.coalesce(v.cast("double"), F.lit(0.0)) * w for v, w in parts]
    return F.try_divide(reduce(lambda a, b: a + b, value), reduce(lambda a, b: a + b, have))


#: Terms and weights of the two composites.
UNDERSTANDING_WEIGHTS = {"ctx_macro_acc": 0.15, "events_f1": 0.15, "presence_f1": 0.10, "obj_recall_rank1": 0.20, "loc_hit_relaxed": 0.20, "attr_slot_macro_acc": 0.10, "rank_acc": 0.10}
DECISION_WEIGHTS = {"traj": 0.35, "decision": 0.25, "understanding": 0.25, "chain": 0.15}


def composite(metrics: DataFrame, stage: int) -> Column:
    """Composite of a wide metric row; a term's column may be absent. Stage 1: understanding. Stage 2: four terms with fallbacks."""
    get = lambda c: F.col(c).cast("double") if c in metrics.columns else F.lit(None).cast("double")

    def mean(*names: str) -> Column:
        return weighted_mean([(get(n), 1.0) for n in names])

    attr = F.coalesce(get("attr_slot_macro_acc"), mean("attr_intention_acc", "attr_state_acc", "attr_location_acc"))
    first = weighted_mean([(attr if k == "attr_slot_macro_acc" else get(k), w) for k, w in UNDERSTANDING_WEIGHTS.items()])
    if stage == 1:
        return first
    missing = F.coalesce(get("missing_rate"), mean("reason_missing_rate", "plan_missing_rate", "implication_missing_rate"))
    terms = {
        "traj": F.coalesce(get("traj_score"), F.exp(-get("ade_5s") / 2)),
        "decision": weighted_mean([(get("start_frame_acc"), 0.5), (1.0 - missing, 0.5)]),
        "understanding": F.coalesce(get("s1_composite"), first),
        "chain": weighted_mean([(get("motion_traj_consistency"), 0.5), (get("ego_state_acc"), 0.5)]),
    }
    return weighted_mean([(terms[k], w) for k, w in DECISION_WEIGHTS.items()])


def best_runs(history: DataFrame, stage: str = "stage", score: str = "composite", step: str = "step") -> DataFrame:
    """Per stage the entry of the highest score, the earliest of equals."""
    rest = [c for c in history.columns if c != stage]
    best = history.where(F.col(score).isNotNull()).groupBy(stage).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(step))).alias("b"))
    return best.select(stage, "b.*")


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, op, threshold, passed): passed is NULL without a value. thresholds: metric, op (>= or <=), threshold."""
    both = hint(thresholds, 10_000).join(metrics.select("metric", "value"), "metric", "left")
    passed = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).when(F.col("op") == "<=", F.col("value") <= F.col("threshold"))
    return both.select("metric", "value", "op", "threshold", passed.alias("passed"))


def mask_metrics(metrics: DataFrame, capabilities: DataFrame, needs: dict[str, str]) -> DataFrame:
    """Long metrics (model, metric, value) with NULL where the model lacks what a metric needs. capabilities: model, capability, able."""
    need = reduce(lambda out, kv: F.when(F.col("metric") == kv[0], kv[1]).otherwise(out), needs.items(), F.lit(None).cast("string"))
    rows = metrics.withColumn("capability", need).join(hint(capabilities, 100_000), ["model", "capability"], "left")
    return rows.select("model", "metric", F.when(F.col("capability").isNull() | F.coalesce("able", F.lit(False)), F.col("value")).alias("value"))


def merge_judged(old: DataFrame, new: DataFrame, key: str = "metric") -> DataFrame:
    """Per metric (value, scored, missing_rate) the old block where it scored more and missed no more, else the new one."""
    o, n = (d.select(key, F.struct("value", "scored", "missing_rate").alias(s)) for d, s in ((old, "o"), (new, "n")))
    both = o.join(n, key, "full_outer")
    keep = F.col("n").isNull() | (F.col("o").isNotNull() & (F.col("o.scored") > F.col("n.scored")) & (F.col("o.missing_rate") <= F.col("n.missing_rate")))
    return both.select(key, F.when(keep, F.col("o")).otherwise(F.col("n")).alias("b"), F.when(keep, "old").otherwise("new").alias("origin")).select(key, "b.*", "origin")


def judge_metrics(verdicts: DataFrame, item: str = "kind", most_dropped: float = 0.20) -> DataFrame:
    """Per kind: mean cause and effect over judged items, the share dropped; withheld (NULL) where more than a fifth is."""
    dropped = rate(F.count_if(F.col("cause").isNull()), F.count("*"))
    keep = lambda c: F.when(dropped <= most_dropped, F.avg(F.col(c).cast("double")))
    return verdicts.groupBy(item).agg(F.count("*").alias("items"), dropped.alias("dropped"), keep("cause").alias("cause"), keep("effect").alias("effect"))


def bag_except(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Multiset difference as counts, positive ones only."""
    x, y = (d.groupBy(*columns).agg(F.count("*").alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    return x.join(y, list(columns), "left").select(*columns, (F.col("_a") - F.coalesce("_b", F.lit(0))).alias("n")).where("n > 0")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of values, the most frequent first, ties by value."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.join(F.broadcast(total), F.lit(True)).select(column, "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent")).orderBy(F.desc("n"), column)
