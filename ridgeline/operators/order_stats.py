"""Order statistics and ordinals of tables of any size: no task holds a group, no window spans a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.select import few_enough, hint
from ridgeline.sources.tables import staged

#: Rows of a group, or of a bracket around a wanted rank, from which they are narrowed down before they meet.
FEW = 100_000
#: Centroids of a quantile sketch, which is what a task sends for each bracket.
SKETCH = 10_000
#: Places of a sketch at which a bracket may be cut.
GRID = 1000


def ordinal(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a number from 1 for each row's place in an order of the whole table; equal keys in any order, but each its own number.

    Range partitions are sorted and written with each row's place in its partition; the counts of the
    partitions before it give the offset, one row per partition. Ties are spread over partitions by a
    random number, so that one key with very many rows is no single task.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.withColumns({n: k for n, k in zip(names, keys, strict=True)}).withColumn("_tie", F.rand(1))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    dealt = rows.repartitionByRange(parts, *names, "_tie").sortWithinPartitions(*names, "_tie").drop(*names, "_tie")
    kept = staged(dealt.withColumn("_place", place), "ordinal").withColumn("_part", F.shiftright("_place", 33))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_c"))  # no more rows than partitions
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(offsets, "_part").withColumn(name, within + F.col("_before") + 1).drop("_part", "_place", "_before")


def _interpolated(found: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(groups, n, q) of rows (groups, n, rank, value), one for each rank that a share needs."""
    per = found.groupBy(*groups, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))

    def share(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        return F.when(low == high, a).otherwise(a + (place - low) * (b - a))

    return per.select(*groups, "n", F.array(*[share(p) for p in shares]).alias("q"))


def quantiles(df: DataFrame, groups: list[str], value: Column | str, shares: list[float], few: int = FEW) -> DataFrame:
    """(groups, n, q): exact quantiles with linear interpolation of the values that are neither NULL nor NaN; a group without any has no row.

    Small groups are sorted. In a larger one each wanted rank has a bracket of values, at first the
    whole group. A mergeable sketch of the bracket's values names two values close around the rank, and
    one aggregation counts the rows below, on, between and above them; the part with the rank is the
    next bracket, some three hundred times smaller, until its rows are few or all equal. Counts decide,
    so that an error of the sketch costs a round and no more. Groups may be NULL; their number is not
    bounded.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    sizes = staged(sizes.where("n > 0"), "sizes")
    large = sizes.where(F.col("n") > few)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys], F.lit(True))

    def of(table: DataFrame, *columns: str) -> DataFrame:
        return hint(table.select(*[F.col(k).alias(f"s_{k}") for k in keys], *columns))

    names = [f"s_{k}" for k in keys]
    whole = few_enough(large, 0)
    small = rows if whole else rows.join(of(large), same, "left_anti") if keys else rows.where("false")
    percentile = F.percentile("v", F.array(*[F.lit(p) for p in shares]))
    done = small.groupBy(*keys).agg(F.count("*").alias("n"), percentile.alias("q")).where("n > 0")
    if not whole:
        done = done.unionByName(_selected(rows, large, keys, names, same, shares, few))
    return done.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], "n", "q")


def _selected(rows: DataFrame, large: DataFrame, keys: list[str], names: list[str], same: Column, shares: list[float], few: int) -> DataFrame:
    places = [F.lit(p) * (F.col("n") - 1) for p in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places]))).cast("array<long>")
    todo = large.select(*[F.col(k).alias(s) for k, s in zip(keys, names, strict=True)], "n", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    todo, found = staged(todo, "brackets"), None
    grid = f"percentile_approx(v, array({', '.join(f'{k / GRID}D' for k in range(GRID + 1))}), {SKETCH})"
    v, bracket = F.col("v"), [*names, "low", "high"]
    inside = v.between(F.col("low"), F.col("high"))

    def per_bracket(table: DataFrame, columns: list[str], *measures: Column) -> DataFrame:
        """Measures of the rows within each distinct bracket; ranks that share one share the work."""
        return rows.join(hint(table.select(*columns).distinct()), same & inside).groupBy(*columns).agg(*measures)

    def matched(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
        other = b.withColumnsRenamed({c: f"t_{c}" for c in columns})
        return a.join(hint(other), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in columns])).drop(*[f"t_{c}" for c in columns])

    while True:
        ready = todo.where((F.col("inside") <= few) | (F.col("low") == F.col("high")))
        found = ready if found is None else found.unionByName(ready)
        todo = todo.where((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if few_enough(todo, 0):
            break
        # of a sketch of each bracket: two values around the wanted rank, some ranks apart
        sketch = per_bracket(todo, bracket, F.expr(grid).alias("c"))
        near = F.floor((F.col("rank") - F.col("before")) / F.col("inside") * GRID).cast("int")
        cut = matched(todo, sketch, bracket).withColumn("a", F.get("c", F.greatest(near - 1, F.lit(0)))).withColumn("b", F.get("c", F.least(near + 2, F.lit(GRID)))).drop("c")
        cut = staged(cut, "cuts")
        a, b = F.col("a"), F.col("b")
        between = (v > a) & (v < b)
        counts = per_bracket(
            cut, [*bracket, "a", "b"], F.count_if(v < a).alias("n0"), F.count_if(v == a).alias("n1"), F.count_if(between).alias("n2"), F.count_if((v == b) & (a < b)).alias("n3"), F.count_if(v > b).alias("n4"),
            F.max(F.when(v < a, v)).alias("high0"), F.min(F.when(between, v)).alias("low2"), F.max(F.when(between, v)).alias("high2"), F.min(F.when(v > b, v)).alias("low4"),
        )
        both = matched(cut, counts, [*bracket, "a", "b"]).withColumn("k", F.col("rank") - F.col("before"))
        # the rank lies below a, on it, between, on b or above: the part is the next bracket, and smaller whatever the sketch said
        upto, parts = F.lit(0), []
        for i, (low, high) in enumerate([("low", "high0"), ("a", "a"), ("low2", "high2"), ("b", "b"), ("low4", "high")]):
            parts.append((F.col("k") < upto + F.col(f"n{i}"), F.struct(F.col(low).alias("low"), F.col(high).alias("high"), (F.col("before") + upto).alias("before"), F.col(f"n{i}").alias("inside"))))
            upto = upto + F.col(f"n{i}")
        part = reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), parts[::-1], F.lit(None))
        todo = staged(both.select(*names, "n", "rank", part.alias("p")).select(*names, "n", "rank", "p.*"), "brackets")
    found = staged(found, "found")
    equal = found.where("low = high").select(*names, "n", "rank", F.col("low").alias("value"))
    open_ = found.where("low < high")
    held = per_bracket(open_, bracket, F.sort_array(F.collect_list("v")).alias("c"))  # no more than ``few`` each
    value = matched(open_, held, bracket).select(*names, "n", "rank", F.get("c", (F.col("rank") - F.col("before")).cast("int")).alias("value"))
    out = _interpolated(equal.unionByName(value), names, shares)
    return out.select(*[F.col(s).alias(k) for k, s in zip(keys, names, strict=True)], "n", "q")


def median(df: DataFrame, value: Column | str) -> DataFrame:
    """One row, column ``median``; none without values."""
    return quantiles(df, [], value, [0.5]).select(F.col("q")[0].alias("median"))
