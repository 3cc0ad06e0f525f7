"""Plan sentences: classification, taxonomy, consistency with motion, rewriting.

Few sentences are distinct, so a worker keeps what it read and looks equal plans up; nothing is
shuffled for it.
"""

from __future__ import annotations

import functools
import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import plan_words as words
from ridgeline.functions.motion import STOPPED
from ridgeline.functions.text import STEP_BREAK, each_once, norm_plan, plan_first

LON = ("accelerate", "decelerate", "keep", "stop")
_TABLES = [(name, [(label, re.compile(p)) for label, p in table]) for name, table in (("strong", words.STRONG), ("weak", words.WEAK), ("fallback", words.FALLBACK))]
_TURN = re.compile(words.TURN)
_BLANKS, _STEP = re.compile(r"\s+", re.ASCII), re.compile(STEP_BREAK, re.ASCII)
_OBJECT_MASKS, _CLAUSE_MASKS = ([re.compile(p, re.ASCII) for p in patterns] for patterns in (words.OBJECT_MASKS, words.CLAUSE_MASKS))
_NOTES = [(label, re.compile(p)) for label, p in words.NOTES]
#: One ordered alternation: the leftmost phrase, and of several at one place the first of the list.
_PHRASE = re.compile("(?i)" + "|".join(f"(?P<p{i}>{p}{words.OBJECTS[more]})" for i, (p, _, more) in enumerate(words.PHRASES)))
#: Words that join two actions.
_JOIN = r"(?:and|to|then|while)"


def spans(table: list[tuple[str, re.Pattern]], text: str) -> list[tuple[int, int, str]]:
    """(start, end, label) from left to right: at each place the longest match, each one after the end of that before."""
    longest: dict[int, tuple[int, str]] = {}
    for label, pattern in table:
        for m in pattern.finditer(text):
            if m.end() > longest.get(m.start(), (m.start(), ""))[0]:
                longest[m.start()] = m.end(), label
    out, free = [], 0
    while (start := min((k for k in longest if k >= free), default=None)) is not None:
        free, label = longest[start]
        out.append((start, free, label))
    return out


def phrase_of(text: str) -> tuple[str, str, str] | None:
    """(table, label, phrase) that decides a masked step: the last one of the first table that has any."""
    return next(((name, found[-1][2], text[found[-1][0] : found[-1][1]]) for name, table in _TABLES if (found := spans(table, text))), None)


_READ = "struct<lon:string,lat:string,notes:array<string>,matched_by:string,side:string>"
_ROW = pa.struct([(c, pa.list_(pa.string()) if c == "notes" else pa.string()) for c in ("lon", "lat", "notes", "matched_by", "side")])


#: How a speed is named where it decided a word's class.
UNKNOWN, MOVING, STILL = "v0=?", "v0>=0.5", "v0<0.5"


def read_step(own: str, rest: str, speed: str) -> tuple[str, str | None, list[str], str, str | None]:
    """(lon, lat, notes, matched_by, side) of a step without object nouns (own), and without clauses, too (rest)."""
    turn, sides = _TURN.search(own), re.findall(r"\b(left|right)\b", own)
    lat = None if not turn else "right_turn" if "right" in (turn["a"], turn["b"], turn["c"]) else "left_turn"
    notes, side = [label for label, p in _NOTES if p.search(own)], next(iter(sides), None)
    if (found := phrase_of(rest)) is not None:
        name, label, phrase = found
        lon = label if label != "split" else "accelerate" if speed == STILL else "keep"
        return lon, lat, notes, f"{'fallback' if name == 'fallback' else 'table'}:{phrase}{f'@{speed}' if label == 'split' else ''}", side
    if lat or notes:
        return "unspecified", lat, notes, "unspecified:lateral_only", side
    return "unmatched", lat, notes, "unmatched" if own else "empty_plan", side


def first_step(plan: str | None) -> str:
    """The first step of a plan that is not empty, in normal form; the whole plan if none is. The column function plan_first() is its equal."""
    text = _BLANKS.sub(" ", (plan or "").lower().replace("_", " ").replace("\n", " ")).strip(" .")
    return next((p for p in (x.strip(" ,;") for x in _STEP.split(text)) if p), text)


@functools.lru_cache(maxsize=20_000)
def read_plan(plan: str | None, speed: str) -> tuple[str, str | None, list[str], str, str | None]:
    """read_step() of a plan's first step, masked. Equal plans are read once by a worker."""
    mask = lambda text, patterns: _BLANKS.sub(" ", reduce(lambda t, p: p.sub(" ", t), patterns, text)).strip(" ")
    own = mask(first_step(plan), _OBJECT_MASKS)
    return read_step(own, mask(own, _CLAUSE_MASKS), speed)


def classify_plans(df: DataFrame, plan: str, v0: str, out: str = "plan_read") -> DataFrame:
    """df with ``plan_read``: lon, lat, notes, matched_by and side of the plan's first step. An unknown speed counts as moving.

    Row by row, as a worker knows the plans that it read: df is read once, and nothing is joined.
    """

    @F.arrow_udf(_READ)
    def read(plan: pa.Array, speed: pa.Array) -> pa.Array:
        return each_once(lambda p, s: dict(zip(_ROW.names, read_plan(p, s), strict=True)), plan, _ROW, speed)

    speed = F.when(F.col(v0) >= STOPPED, MOVING).when(F.col(v0) < STOPPED, STILL).otherwise(UNKNOWN)
    return df.withColumn(out, read(F.col(plan).cast("string"), speed))


def taxonomy(read: Column) -> Column:
    """(lateral, longitudinal) of the plan vocabulary: turns first, then notes in order of priority."""
    note = lambda *names: F.arrays_overlap(read["notes"], F.array(*[F.lit(n) for n in names]))
    side = F.coalesce(read["side"], F.lit("left"))
    lateral = (
        F.when(read["lat"] == "left_turn", "turn left")
        .when(read["lat"] == "right_turn", "turn right")
        .when(note("lane_change"), F.concat(F.lit("lane change "), side))
        .when(note("nudge"), F.concat(F.lit("nudge "), side))
        .when(note("pull_out"), "pull out")
        .when(note("pull_over"), "pull over")
        .when(note("borrow"), "bypass/overtake")
        .when(note("keep_lane", "keep_side", "straight") | read["lon"].isin(*LON), "keep lane")
        .otherwise("other")
    )
    return F.struct(lateral.alias("lateral"), F.when(read["lon"] == "keep", "cruise").otherwise(read["lon"]).alias("longitudinal"))


def compatible(plan: Column, motion: Column, v0: Column, v_end: Column, start_t: Column) -> Column:
    """Whether a plan class does not contradict a motion class; an unknown quantity that is needed is a contradiction."""
    change = F.abs(v_end - v0) <= F.greatest(F.lit(3.0), v0 * 0.5)
    keep = motion.isin("accelerate", "decelerate") & (v0 >= STOPPED) & change
    slow = (motion == "stop") | ((motion == "keep") & (v_end < v0))
    faster = (motion == "keep") & (v_end >= v0 - 0.5)
    stop = (motion == "decelerate") | ((motion == "accelerate") & (v0 < STOPPED) & (start_t >= 2.0)) | ((motion == "keep") & (v_end < 1.5))
    rule = F.when(plan == motion, True).when(plan == "keep", keep).when(plan == "decelerate", slow).when(plan == "accelerate", faster).when(plan == "stop", stop)
    return plan.isin(*LON) & motion.isin(*LON) & F.coalesce(rule, F.lit(False))


def consistent(read: Column, m_lon: Column, m_lat: Column, v0: Column, v_end: Column, start_t: Column, strict: bool = False) -> Column:
    """Plan against motion: NULL if the plan has no class; a named turn, or straight, must not contradict the lateral motion."""
    lon = (read["lon"] == m_lon) if strict else compatible(read["lon"], m_lon, v0, v_end, start_t)
    turns = read["lat"].isNotNull() & (m_lat != read["lat"])
    straight = read["lat"].isNull() & F.array_contains(read["notes"], "straight") & (m_lat != "straight")
    lateral = m_lat.isNull() | ~(turns | straight)
    return F.when(read["lon"].isin(*LON), lon & F.coalesce(lateral, F.lit(True)))


def target_verb(motion: Column, v0: Column) -> Column:
    still = v0 < STOPPED
    return F.when(motion == "keep", "cruise").when(motion == "accelerate", F.when(still, "proceed").otherwise("accelerate")).when(motion == "decelerate", "decelerate").when(motion == "stop", F.when(still, "remain stopped").otherwise("stop and wait"))


def tidy(text: Column) -> Column:
    """Without doubled blanks and commas, blanks before commas, and joining words or commas at either end."""
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*,(?:\s*,)*", ",")
    ends = rf"^(?:[\s,]*\b{_JOIN}\b)*[\s,]+(?=\S)|^(?:{_JOIN}\b[\s,]*)+|(?:[\s,]+{_JOIN}\b)*[\s,]*$"
    return F.trim(F.regexp_replace(text, ends, ""))


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the phrases of a plan from left to right, each with the object that belongs to it."""
    return [(m.start(), m.end(), words.PHRASES[int(m.lastgroup[1:])][1]) for m in _PHRASE.finditer(text)]


def reworded(text: str, verb: str) -> str | None:
    """The step with the verb in the place of its first longitudinal phrase and without the others, each gone with the word that joins it."""
    found = [x for x in scan(text) if x[2] in (*LON, "v0")]
    if not found:
        return None
    joined = [re.search(rf"[\s,]*(?:\b{_JOIN}\b)?[\s,]*$", text[:start]).start() for start, _, _ in found]
    edits = [(found[0][0], found[0][1], verb), *((max(j, before), end, " ") for j, (_, end, _), (_, before, _) in zip(joined[1:], found[1:], found, strict=False))]
    at = [0, *(end for _, end, _ in edits)]
    return "".join(text[a:start] + by for a, (start, _, by) in zip(at, edits, strict=False)) + text[at[-1] :]


def repair_plans(df: DataFrame, plan: str, m_lon: str, m_lat: str, v0: str, v_end: str, start_t: str) -> DataFrame:
    """Contradicting plans with ``new_plan`` (NULL if no rewrite reads as the motion) and ``reason_weight`` 0.5 where rewritten.

    Judges every row, rewrites contradictions only, and leaves the source as it is: an overlay. A
    rewrite counts if the classifier then reads it as the motion, and the plan starts with the step.
    """

    @F.pandas_udf("string")
    def reword(first: pd.Series, verb: pd.Series) -> pd.Series:
        return pd.Series([reworded(*row) for row in zip(first, verb, strict=True)], dtype=object)

    read = classify_plans(df, plan, v0)
    ok = consistent(F.col("plan_read"), F.col(m_lon), F.col(m_lat), F.col(v0), F.col(v_end), F.col(start_t))
    bad = read.where(~ok).withColumn("_text", norm_plan(F.col(plan))).withColumn("_step", plan_first(F.col(plan))).withColumn("_verb", target_verb(F.col(m_lon), F.col(v0)))
    steps = bad.select("_step", "_verb").distinct().withColumn("_new", reword("_step", "_verb"))
    steps = steps.withColumn("_new", F.when(F.col("_new").isNotNull(), F.coalesce(F.nullif(tidy(F.col("_new")), F.lit("")), F.col("_verb"))))
    bad = classify_plans(bad.join(steps, ["_step", "_verb"]), "_new", v0, "_again")
    fits = (F.col("_again.lon") == F.col(m_lon)) & F.startswith("_text", "_step") & F.col("_new").isNotNull()
    new = F.when(fits, F.concat("_new", F.substring(F.col("_text"), F.length("_step") + 1, F.length("_text"))))
    return bad.withColumn("new_plan", new).withColumn("reason_weight", F.when(F.col("new_plan").isNotNull(), 0.5).otherwise(1.0)).drop("_text", "_step", "_verb", "_new", "_again")


def judge_plans(df: DataFrame, plan: str, m_lon: str, m_lat: str, v0: str, v_end: str, start_t: str) -> DataFrame:
    """df with the plan's class against the motion: plan_lon, ``verdict`` and, for contradictions, new_plan and reason_weight.

    verdict: missing, unmatched, unspecified, equal, tolerated, rewritten or failed; only the lateral
    side differs where ``lateral_conflict``. Judged on the longitudinal side, as rewrites are.
    """
    none = F.lit(None).cast("string")
    rows = classify_plans(df, plan, v0)
    given = [F.col(v0), F.col(v_end), F.col(start_t)]
    ok, whole = consistent(F.col("plan_read"), F.col(m_lon), none, *given), consistent(F.col("plan_read"), F.col(m_lon), F.col(m_lat), *given)
    lon = F.col("plan_read.lon")
    said = F.coalesce(F.trim(F.col(plan)) != "", F.lit(False))
    verdict = F.when(~said, "missing").when(~lon.isin(*LON), lon).when(lon == F.col(m_lon), "equal").when(ok, "tolerated")
    rows = rows.withColumns({"plan_lon": lon, "verdict": verdict, "lateral_conflict": F.coalesce(ok & ~whole, F.lit(False))}).drop("plan_read")
    good, bad = rows.where("verdict IS NOT NULL"), rows.where("verdict IS NULL").withColumn("_lat", none)
    fixed = repair_plans(bad, plan, m_lon, "_lat", v0, v_end, start_t).drop("plan_read", "_lat")
    fixed = fixed.withColumn("verdict", F.when(F.col("new_plan").isNotNull(), "rewritten").otherwise("failed"))
    blank = {"new_plan": F.lit(None).cast("string"), "reason_weight": F.lit(1.0)}
    return good.withColumns(blank).unionByName(fixed.select(*good.columns, *blank))


def repair_overlay(judged: DataFrame, key: str, plan: str) -> DataFrame:
    """The overlay of judge_plans()'s rows: key, final_plan, reason_weight, orig_plan, plan_lon of the rewritten ones."""
    return judged.where("verdict = 'rewritten'").select(key, F.col("new_plan").alias("final_plan"), "reason_weight", F.col(plan).alias("orig_plan"), "plan_lon")


def repair_counts(judged: DataFrame, m_lon: str, by: str) -> DataFrame:
    """(kind, name, n): verdicts in all and by group, classes against motions, and the transitions tolerated and rewritten."""
    pair = F.concat_ws("->", "plan_lon", m_lon)
    cell = lambda kind, name, when: F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    v = F.col("verdict")
    cells = [
        cell("verdict", v, F.lit(True)), cell("group", F.concat_ws(":", by, v), F.lit(True)), cell("confusion", pair, v != "missing"), cell("tolerated", pair, v == "tolerated"),
        cell("rewritten", pair, v == "rewritten"), cell("lateral conflict", F.lit("any"), F.col("lateral_conflict")),
    ]
    return judged.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").groupBy("c.kind", "c.name").agg(F.count("*").alias("n"))


def repair_report(df: DataFrame, read: str, m_lon: str, m_lat: str, v0: str, v_end: str, start_t: str, by: str) -> DataFrame:
    """Per group: judged, inconsistent strictly and tolerantly, and tolerated plans."""
    args = (F.col(read), F.col(m_lon), F.col(m_lat), F.col(v0), F.col(v_end), F.col(start_t))
    rows = df.withColumn("_t", consistent(*args)).withColumn("_s", consistent(*args, strict=True))
    return rows.groupBy(by).agg(F.count("_t").alias("judged"), F.count_if(~F.col("_s")).alias("strict"), F.count_if(~F.col("_t")).alias("tolerant"), F.count_if(F.col("_t") & ~F.col("_s")).alias("tolerated"))
