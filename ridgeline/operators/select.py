"""Selection: strides, caps, seeded orders, quotas, splits and their repair.

Seeded choices order rows by an md5 of seed and key, so that they repeat on any cluster and in any
SQL engine. Exact counts of them need no task that holds a stratum: the leading digits of the md5 are
buckets, whose counts tell which buckets are taken whole and in which one rows are ranked.
"""

from __future__ import annotations

import collections
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int | str, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def shuffle(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in a seeded order; the order is range-partitioned, no task holds the table."""
    return df.orderBy(seeded(seed, *keys), *keys)


def sample_n(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """A seeded sample of n rows, in key order."""
    return df.orderBy(seeded(seed, *keys), *keys).limit(n).orderBy(*keys)


def stride_select(df: DataFrame, scene: str, order: str, kind: Column, strides: dict[str, int]) -> DataFrame:
    """Per scene and kind every stride-th row in order, the first one always. Kinds without a stride are dropped."""
    within = Window.partitionBy(scene, "_kind").orderBy(order)
    stride = reduce(lambda out, kv: F.when(F.col("_kind") == kv[0], kv[1]).otherwise(out), strides.items(), F.lit(None).cast("int"))
    rows = df.withColumn("_kind", kind).where(F.col("_kind").isin(*strides)).withColumn("_n", F.row_number().over(within))
    return rows.where((F.col("_n") - 1) % stride == 0).drop("_n", "_kind")


def few_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def hint(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a table of narrow rows if it is that short (counted), else leave the join to Spark."""
    return F.broadcast(df) if few_enough(df, rows) else df


def least_seeds(df: DataFrame, quotas: DataFrame, stratum: str, seed: int | str, *keys: str, digits: int = 4) -> DataFrame:
    """Per stratum the ``quota`` rows of the least seeds, exactly; quotas: stratum, quota. A NULL stratum has none.

    Buckets are the first hexadecimal digits of the seed, 16 ** digits per stratum: one aggregation
    counts them, running sums over them find each bucket's room, and rows are ranked within buckets.
    """
    h = seeded(seed, *keys)
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = counts.withColumn("_before", before).join(quotas.select(stratum, "quota"), stratum).select(stratum, "_b", (F.col("quota") - F.col("_before")).alias("_room")).where("_room > 0")
    # the table itself must not become the broadcast side, however small its files are
    few = few_enough(room, 100_000)
    ranked = rows.join(F.broadcast(room) if few else room.hint("merge"), [stratum, "_b"]).withColumn("_n", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", *keys)))
    return ranked.where("_n <= _room").select(df.columns)


def cap_ratio(df: DataFrame, negative: Column, share: float, seed: int, *keys: str) -> DataFrame:
    """All positives, and a seeded sample of the negatives so that they are at most ``share`` of the result."""
    marked = df.withColumn("_neg", negative)
    most = marked.where("NOT _neg").agg(F.floor(F.lit(share / (1 - share)) * F.count("*")).alias("quota")).select(F.lit(True).alias("_neg"), "quota")
    kept = least_seeds(marked.where("_neg"), most, "_neg", seed, *keys)
    return marked.where("NOT _neg").unionByName(kept).drop("_neg")


def frame_window(df: DataFrame, frame_no: str, low: int = 140, high: int = 160) -> DataFrame:
    """Frames whose number lies in a window, both ends included."""
    return df.where(F.col(frame_no).between(low, high))


def natural_key(name: Column) -> Column:
    """A key that orders names by their numbers as numbers: runs of digits padded to twenty places."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d+$")), F.lpad(p, 20, "0")).otherwise(p)), "")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; to be applied before any stride or cap."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def quota(strata: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """Largest-remainder shares of n over strata: (stratum, size, quota), never more than a stratum has.

    Remainders go round by (remainder, size, name); what a full stratum cannot take goes on to the
    next in that order. There is one row per stratum, so the ranking window is small.
    """
    total = strata.agg(F.sum(size)).first()[0] or 0
    n = min(n, total)
    exact = F.col(size) * F.lit(n) / F.lit(max(total, 1))
    rows = strata.select(stratum, size).withColumn("base", F.floor(exact).cast("long")).withColumn("rest", F.round(exact - F.floor(exact), 9))
    missing = n - (rows.agg(F.sum("base")).first()[0] or 0)
    turn = Window.orderBy(F.desc("rest"), F.desc(size), F.asc(stratum))
    # the k-th extra of a stratum stands in round k; extras are taken in order of round and rank
    ranked = rows.withColumn("rank", F.row_number().over(turn)).withColumn("spare", F.col(size) - F.col("base"))
    rounds = max(missing, 0)
    extra = ranked.where("spare > 0").withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.least("spare", F.lit(max(rounds, 1)).cast("long")))))
    extra = extra.orderBy("round", "rank").limit(rounds).groupBy(stratum).agg(F.count("*").alias("extra"))
    return rows.join(extra, stratum, "left").select(stratum, size, (F.col("base") + F.coalesce("extra", F.lit(0))).alias("quota"))


def stratified_draw(df: DataFrame, quotas: DataFrame, stratum: str, seed: int, *keys: str) -> DataFrame:
    """Per stratum a seeded draw of its quota."""
    return least_seeds(df, quotas, stratum, seed, *keys)


def group_by_appearance(df: DataFrame, group: str, position: str, per: int = 100, parts: int = 200) -> DataFrame:
    """Groups numbered by first appearance, and in batches of ``per``: columns ordinal and batch. Positions are numbers.

    The groups are cut at approximate quantiles of their first positions; counts of the parts before
    give each part's offset, so that groups are ranked within parts only, and exactly.
    """
    first = df.groupBy(group).agg(F.min(position).alias("_first"))
    cuts = first.agg(F.percentile_approx("_first", [k / parts for k in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("_first"))) if cuts else F.lit(0)
    rows = first.withColumn("_part", part)
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_c"))  # no more rows than parts
    offsets = offsets.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("_first", group))).join(F.broadcast(offsets), "_part")
    ranked = ranked.select(group, (F.col("_n") + F.col("_before")).cast("int").alias("ordinal"))
    return df.join(ranked.withColumn("batch", F.floor((F.col("ordinal") - 1) / per).cast("long") + 1), group)


def shortfall(selected: DataFrame, minima: dict[str, float]) -> DataFrame:
    """One row: the total of each column of a selection, what it lacks, and the sum lacking."""
    totals = selected.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in minima])
    lacks = {f"lack_{c}": F.greatest(F.lit(0.0), F.lit(float(m)) - F.col(c)) for c, m in minima.items()}
    return totals.withColumns(lacks).withColumn("shortfall", sum((F.col(c) for c in list(lacks)[1:]), F.col(next(iter(lacks)))))


def deviation(selected: DataFrame, quotas: DataFrame, stratum: str) -> DataFrame:
    """One row: the sum over strata of the distance between rows selected and quota."""
    n = selected.groupBy(stratum).agg(F.count("*").alias("_n"))
    both = quotas.select(stratum, "quota").join(n, stratum, "full_outer")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("quota", F.lit(0)) - F.coalesce("_n", F.lit(0)))), F.lit(0)).alias("deviation"))


def repair_selection(pool: DataFrame, selected: DataFrame, key: str, stratum: str, quotas: DataFrame, minima: dict[str, float], candidates: int = 40, rounds: int = 400, seed: int = 0) -> DataFrame:
    """Swap rows in and out while that lowers (shortfall, deviation); returns the selection.

    Each round takes the constraint that lacks most and tries the ``candidates`` outside rows that
    bring most of it against every selected row. Rows that may ever be tried are gathered once: per
    constraint the n + candidates rows that bring most, as n rows at most are inside. These, the
    selection and the quotas are short lists, bounded by arguments; the pool is never gathered.
    """
    columns = [key, stratum, *minima]
    inside = [tuple(r) for r in selected.select(*columns).collect()]
    of = {r[0]: r[1] for r in quotas.select(stratum, "quota").collect()}
    most = len(inside) + candidates
    ranked = {c: [tuple(r) for r in pool.select(*columns).orderBy(F.desc(c), seeded(seed, key)).limit(most).collect()] for c in minima}
    need = np.array(list(minima.values()), float)
    value = lambda rows: np.array([[x or 0 for x in r[2:]] for r in rows], float).reshape(len(rows), len(need))

    def apart(rows: list[tuple]) -> dict:
        n = collections.Counter(r[1] for r in rows)
        return {s: (of.get(s, 0), n.get(s, 0)) for s in {*of, *n}}

    shift = lambda at, s, by: abs(at.get(s, (0, 0))[0] - at.get(s, (0, 0))[1] - by) - abs(at.get(s, (0, 0))[0] - at.get(s, (0, 0))[1])
    for _ in range(rounds):
        have = value(inside)
        lack = need - have.sum(axis=0)
        now = np.maximum(lack, 0).sum(), sum(abs(q - n) for q, n in apart(inside).values())
        if not now[0] or not inside:
            break
        worst = max(range(len(need)), key=lambda i: (lack[i] / max(need[i], 1e-9), columns[2 + i]))
        names = {r[0] for r in inside}
        more = [r for r in ranked[columns[2 + worst]] if r[0] not in names][:candidates]
        if not more:
            break
        short = np.maximum(lack + have[:, None, :] - value(more)[None, :, :], 0).sum(axis=2)
        at = apart(inside)
        change = np.array([[0 if a[1] == b[1] else shift(at, a[1], -1) + shift(at, b[1], 1) for b in more] for a in inside])
        k, j = divmod(int(np.lexsort((change.ravel(), short.ravel()))[0]), len(more))
        if (short[k, j], now[1] + change[k, j]) >= now:
            break
        inside[k] = more[j]
    return pool.sparkSession.createDataFrame(inside, selected.select(*columns).schema)


def select_scenes(pool: DataFrame, key: str, stratum: str, n: int, minima: dict[str, float], seed: int = 0, restarts: int = 3) -> DataFrame:
    """The best of several seeded stratified draws after repair, by (shortfall, deviation)."""
    strata = pool.groupBy(stratum).agg(F.count("*").alias("size"))
    quotas = quota(strata, stratum, "size", n)
    best, found = None, None
    for k in range(restarts):
        drawn = repair_selection(pool, stratified_draw(pool, quotas, stratum, seed + k, key), key, stratum, quotas, minima, seed=seed + k)
        score = (shortfall(drawn, minima).first()["shortfall"], deviation(drawn, quotas, stratum).first()["deviation"])
        if best is None or score < best:
            best, found = score, drawn
        if score == (0, 0):
            break
    return found
