"""What a model's own answers show that it can do, found in one pass; and a registry of model profiles.

A field is scored for a model only if enough of its answers carry it and these differ. Every answer
gives one narrow row per field (model, field, digest of the field's normal form); one partial
aggregation counts answers, answers with content and explicit answers of "none". The number of distinct
texts is a count at any size; a caller may ask for a mergeable sketch's estimate beyond some size, which
is counted all the same where it lies near the bound. Texts never meet in a shuffle, only their digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.aggregate import rate
from ridgeline.operators.select import few_enough, hint


@dataclass(frozen=True)
class Field:
    """text: what an answer says of it, NULL or blank if nothing. structured: of a small vocabulary. of_objects: an explicit "none" answers it. needs: another field without which it means nothing."""

    name: str
    text: Column
    structured: bool = False
    of_objects: bool = False
    needs: str | None = None


@dataclass(frozen=True)
class Bounds:
    """Least share of answers with the field, of distinct texts among them (plain and structured), of answers with objects."""

    coverage: float = 0.20
    distinct: float = 0.05
    distinct_structured: float = 0.01
    content: float = 0.05


def answer_fields(objects: str = "objects", reason: str = "reason", plan: str = "final_plan", path: str = "traj") -> list[Field]:
    """The seven fields of an answer: columns of objects (type, point, state, intention, content, implication), texts, and a path."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    each = lambda f: F.to_json(F.filter(F.transform(objects, f), lambda x: x.isNotNull()))
    some = lambda f: F.coalesce(F.exists(objects, f), F.lit(False))
    behaviour = lambda o: F.struct(o["state"].alias("s"), o["intention"].alias("i"), o["content"].alias("c"))
    behaves = lambda o: F.coalesce(said(o["state"]), said(o["intention"]), said(o["content"])).isNotNull()
    return [
        Field("points", F.when(some(lambda o: o["point"].isNotNull()), F.to_json(F.transform(objects, lambda o: o["point"]))), True, True),
        Field("types", F.when(F.size(objects) > 0, F.to_json(F.array_sort(F.transform(objects, lambda o: F.coalesce(o["type"], F.lit("")))))), True, True),
        Field("behaviour", F.when(some(behaves), F.to_json(F.transform(objects, behaviour))), False, True, "types"),
        Field("implication", F.when(some(lambda o: said(o["implication"]).isNotNull()), each(lambda o: said(o["implication"]))), False, True),
        Field("reason", F.col(reason)), Field("plan", F.col(plan)), Field("trajectory", F.to_json(F.col(path)), True),
    ]


def _normal(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))


def detect_capabilities(answers: DataFrame, model: str, fields: list[Field], none: Column | None = None, bounds: Bounds = Bounds(), exact: int | None = None) -> DataFrame:
    """(model, capability, n, n_frames, n_explicit_none, coverage, n_distinct, distinct_ratio, able, rule) of every model and field.

    none: whether an answer says outright that there are no objects, which answers all fields of
    objects that it does not carry. rule names what decided: absent, coverage, objects, degenerate,
    ``needs <field>``, or able. n_distinct is a count. With ``exact`` it is one only up to so many answers
    with content, or near the bound; beyond that a sketch's estimate, within some two per cent.
    """
    says_none = F.coalesce(none, F.lit(False)) if none is not None else F.lit(False)
    cells = [F.struct(F.lit(f.name).alias("capability"), F.lit(f.of_objects).alias("of_objects"), F.xxhash64(_normal(f.text)).alias("h"), _normal(f.text).isNotNull().alias("has")) for f in fields]
    rows = answers.select(F.col(model).alias("model"), says_none.alias("none"), F.explode(F.array(*cells)).alias("c")).select("model", "none", "c.*").withColumn("h", F.when(F.col("has"), F.col("h")))
    found = rows.groupBy("model", "capability").agg(
        F.count("*").alias("n"), F.count("h").alias("n_frames"), F.count_if(F.col("none") & F.col("of_objects") & ~F.col("has")).alias("n_explicit_none"),
        (F.lit(None).cast("long") if exact is None else F.hll_sketch_estimate(F.hll_sketch_agg("h", F.lit(14)))).alias("_about"),
    )
    least = F.lit(bounds.distinct)
    for f in fields:
        least = F.when((F.col("capability") == f.name) & F.lit(f.structured), bounds.distinct_structured).otherwise(least)
    found = found.withColumn("_least", least)
    counted = rows.where("has")
    if exact is not None:  # where a count decides, it is made: by (model, capability), the digests alone
        near = F.abs(F.coalesce(rate(F.col("_about"), F.col("n_frames")), F.lit(0.0)) / F.col("_least") - 1) < 0.1
        wanted = found.where((F.col("n_frames") <= exact) | near).select(F.col("model").alias("_m"), F.col("capability").alias("_c"))
        counted = counted.join(hint(wanted), F.col("model").eqNullSafe(F.col("_m")) & (F.col("capability") == F.col("_c")), "left_semi")
    counted = counted.groupBy("model", "capability", "h").agg(F.lit(1).alias("one")).groupBy("model", "capability").agg(F.count("*").alias("_exact"))
    counted = counted.select(F.col("model").alias("_m"), F.col("capability").alias("_c"), "_exact")
    both = found.join(counted, F.col("model").eqNullSafe(F.col("_m")) & (F.col("capability") == F.col("_c")), "left").drop("_m", "_c")
    both = both.withColumn("n_distinct", F.coalesce("_exact", F.when(F.col("n_frames") == 0, 0).otherwise(F.col("_about"))).cast("long"))
    both = both.withColumn("coverage", rate(F.col("n_frames") + F.col("n_explicit_none"), F.col("n"))).withColumn("distinct_ratio", F.coalesce(rate(F.col("n_distinct"), F.col("n_frames")), F.lit(0.0)))
    objects = F.col("capability").isin([f.name for f in fields if f.of_objects])
    rule = (
        F.when(F.col("n_frames") == 0, "absent").when(F.col("coverage") < bounds.coverage, "coverage").when(objects & (rate(F.col("n_frames"), F.col("n")) < bounds.content), "objects")
        .when(F.col("distinct_ratio") < F.col("_least"), "degenerate").otherwise("able")
    )
    both = both.withColumn("rule", rule)
    needs = F.lit(None).cast("string")
    for f in fields:
        needs = F.when(F.col("capability") == f.name, F.lit(f.needs)).otherwise(needs)
    able = F.collect_set(F.when(F.col("rule") == "able", F.col("capability"))).over(Window.partitionBy("model"))  # one row per field
    both = both.withColumn("_needs", needs).withColumn("_able", able)
    lacks = (F.col("rule") == "able") & F.col("_needs").isNotNull() & ~F.array_contains("_able", F.col("_needs"))
    both = both.withColumn("rule", F.when(lacks, F.concat(F.lit("needs "), "_needs")).otherwise(F.col("rule")))
    return both.select("model", "capability", "n", "n_frames", "n_explicit_none", "coverage", "n_distinct", "distinct_ratio", (F.col("rule") == "able").alias("able"), "rule")


#: A profile's columns besides its capabilities, each of which is native ("yes"), read from free text ("text") or lacking ("no").
PROFILE = "name string, display string, source string, point_mode string, capabilities map<string,string>"


class Profiles:
    """Registry of model profiles and of other names for them: short tables that every job may look a model up in."""

    def __init__(self, profiles: DataFrame, aliases: DataFrame | None = None):
        names = profiles.groupBy("name").count().where("count > 1")
        if not names.isEmpty():
            raise ValueError(f"profile {names.first()['name']!r} stands there twice")
        self.profiles = profiles
        self.aliases = aliases if aliases is not None else profiles.sparkSession.createDataFrame([], "alias string, name string")

    def of(self, rows: DataFrame, model: str, unknown: str = "raise") -> DataFrame:
        """rows with ``profile``, by name or alias. A model without one raises, or with ``unknown="null"`` gets NULL."""
        a = hint(self.aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_alias_name")).dropDuplicates(["_alias"]))
        p = hint(self.profiles.select(F.col("name").alias("_name"), F.struct(*self.profiles.columns).alias("profile")))
        named = rows.join(a, F.col(model) == F.col("_alias"), "left").withColumn("_key", F.coalesce("_alias_name", model))
        out = named.join(p, F.col("_key") == F.col("_name"), "left").drop("_alias", "_alias_name", "_key", "_name")
        if unknown == "raise":
            lost = out.where(F.col("profile").isNull()).select(model)
            if not few_enough(lost, 0):
                raise KeyError(f"no profile for {lost.first()[0]!r}")
        return out

    def expected(self) -> DataFrame:
        """(name, capability, how) of all profiles, to hold beside what detect_capabilities finds; it never decides."""
        return self.profiles.select("name", F.explode("capabilities").alias("capability", "how"))
