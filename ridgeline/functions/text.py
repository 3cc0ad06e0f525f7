"""Column functions over free text: canonical forms, answer parsing, prompts, digests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each_once(read: Callable, texts: pa.Array, kind: pa.DataType, *more: pa.Array) -> pa.Array:
    """read() of every text, and of what more columns say beside it: equal ones of a batch are read once and take that result."""
    code = np.zeros(len(texts), np.int64)
    for c in (texts, *more):
        found = c.dictionary_encode(null_encoding="encode")
        code = code * max(1, len(found.dictionary)) + found.indices.to_numpy()
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    different = [c.take(pa.array(first)).to_pylist() for c in (texts, *more)]
    return pa.array([read(*row) for row in zip(*different, strict=True)], kind).take(pa.array(place))


def norm_plan(plan: Column) -> Column:
    """Lower case, underscores and line ends as blanks, blanks collapsed, outer blanks and dots gone."""
    text = F.lower(F.coalesce(plan, F.lit("")))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[_\n]", " "), r"\s+", " "), F.lit(" ."))


#: Fixed pattern: what parts the steps of a plan.
STEP_BREAK = (
    r"\s*[,;]?\s*\b(?:and\s+)?then\b|\s*[,;]?\s*\bfollowed\s+by\b|\s*[,;]?\s*\bafter\s+(?:that|which)\b|\s*[,;]?\s*\bafterwards?\b"
    r"|\s*[,;]?\s*\bsubsequently\b|\s*[,;]?\s*\b(?:and\s+)?finally\b|\s*[,;]?\s*\bbefore\s+[a-z]+ing\b"
)


def plan_first(plan: Column) -> Column:
    """The first step of a plan that is not empty; the whole plan if none is."""
    text = norm_plan(plan)
    parts = F.filter(F.transform(F.split(text, STEP_BREAK), lambda p: F.btrim(p, F.lit(" ,;"))), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), text)


def tag(text: Column, name: str) -> Column:
    """Trimmed content of the first <name>…</name>, NULL without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)<{name}>\s*(.*?)\s*</{name}>"), F.lit(1)), F.lit(1)))


def key_values(text: Column, separator: str = r"\|") -> Column:
    """map of ``k=v`` entries: keys lowered and trimmed, entries without ``=`` ignored, the last of equal keys wins."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda p: p.contains("="))
    none = F.create_map().cast("map<string,string>")

    def put(found: Column, part: Column) -> Column:
        key, value = F.lower(F.trim(F.substring_index(part, "=", 1))), F.trim(F.substring(part, F.instr(part, "=") + 1, F.length(part)))
        return F.map_concat(F.map_filter(found, lambda k, v: k != key), F.create_map(key, value))

    return F.aggregate(parts, none, put)


def motion_lon(word: Column) -> Column:
    w = F.lower(F.trim(word))
    return F.when(w.startswith("acc"), "accelerate").when(w.startswith("dec"), "decelerate").when(w.startswith("keep") | w.startswith("maintain") | w.startswith("cruis"), "keep").when(w.startswith("stop"), "stop")


def motion_lat(word: Column) -> Column:
    w = F.lower(F.trim(word))
    return F.when(w.startswith("straight"), "straight").when(w.startswith("left"), "left_turn").when(w.startswith("right"), "right_turn")


def ego_word(lon: Column) -> Column:
    """Class of an ego-state text by its first four letters."""
    w = F.substring(F.lower(F.trim(lon)), 1, 4)
    return F.when(w == "stop", "stopped").when(w == "acce", "accelerating").when(w == "dece", "decelerating").when(w == "crui", "cruising")


NUMBER = r"[-+]?\d+(?:\.\d+)?"
PAIR = rf"\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]"


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def ego_numbers(lon: Column) -> Column:
    """Stopped time, speeds from and to, and whether the time is open-ended."""
    n, word = numbers(lon), ego_word(lon)
    first, second = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
    change = word.isin("accelerating", "decelerating")
    return F.struct(
        word.alias("cls"),
        F.when(word == "stopped", first).alias("seconds"),
        F.coalesce((word == "stopped") & lon.contains("+"), F.lit(False)).alias("plus"),
        F.when(change & second.isNotNull(), first).alias("v_from"),
        F.when(change, F.coalesce(second, first)).alias("v_to"),
        F.when(word == "cruising", first).alias("v"),
    )


def bracket_pairs(text: Column) -> Column:
    """array<struct<x, y>> of ``[x, y]`` pairs."""
    xs, ys = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(g)) for g in (1, 2))
    return F.zip_with(xs, ys, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))


def trajectory_text(text: Column) -> Column:
    """What stands in <traj>; an unclosed one goes on to the end."""
    return F.when(text.contains("<traj>"), F.regexp_extract(text, r"(?s)<traj>(.*?)(?:</traj>|$)", 1))


def parse_trajectory(text: Column, n: int = 5) -> Column:
    """The first n bracket pairs of <traj>, NULL if there are fewer."""
    pairs = bracket_pairs(trajectory_text(text))
    return F.when(F.size(pairs) >= n, F.slice(pairs, 1, n))


def parse_trajectory_tolerant(text: Column, n: int = 5) -> Column:
    """Bracket pairs, else bare numbers of <traj> two by two."""
    bare = numbers(trajectory_text(text))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(bare) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(bare, i * 2).alias("x"), F.get(bare, i * 2 + 1).alias("y")))
    return F.coalesce(parse_trajectory(text, n), F.when(F.size(bare) >= 2 * n, F.slice(pairs, 1, n)))


OBJECT = r"(?s)<obj\s+type=[\"']?(.*?)[\"']?\s*>(.*?)</obj>"
POINT = rf"<point>\s*\(?\s*({NUMBER})\s*,\s*({NUMBER})\s*\)?\s*</point>"


def parse_objects(text: Column) -> Column:
    """Closed <obj> blocks in order: type, point, rank and attribute fields."""
    types, bodies = (F.regexp_extract_all(text, F.lit(OBJECT), F.lit(g)) for g in (1, 2))

    def one(kind: Column, body: Column) -> Column:
        fields = [tag(body, f).alias(f) for f in ("location", "intention", "state", "content", "implication")]
        xy = [F.nullif(F.regexp_extract(body, POINT, g), F.lit("")).cast("double").alias(n) for g, n in ((1, "x"), (2, "y"))]
        point = F.when(xy[0].isNotNull(), F.struct(*xy))
        rank = F.nullif(F.regexp_extract(body, r"<rank>\s*(\d+)\s*</rank>", 1), F.lit("")).cast("int")
        return F.struct(F.trim(kind).alias("type"), point.alias("point"), rank.alias("rank"), *fields)

    return F.zip_with(types, bodies, one)


def parse_answer(text: Column) -> Column:
    """One answer as a struct; absent parts are NULL, absent lists empty. Every part is read once, whatever the text's expression costs."""
    return let(F.coalesce(text, F.lit("")), _read_answer)


def _read_answer(t: Column) -> Column:
    none = F.array().cast("array<string>")
    item = lambda m, k: F.try_element_at(m, F.lit(k))

    def ego(state: Column) -> Column:
        fields = lambda m: F.struct(item(m, "lon").alias("lon"), item(m, "lat").alias("lat"), ego_word(item(m, "lon")).alias("lon_class"))
        return F.when(state.isNotNull(), let(key_values(state), fields))

    def events(said: Column) -> Column:
        listed = F.filter(F.transform(F.split(said, ","), F.trim), lambda e: e != "")
        return F.when(said.isNull() | F.lower(said).isin("", "none"), none).otherwise(listed)

    def motion(said: Column) -> Column:
        both = lambda m: F.struct(F.struct(motion_lon(item(m, "lon")).alias("lon"), motion_lat(item(m, "lat")).alias("lat")).alias("read"), F.struct(item(m, "lon").alias("lon"), item(m, "lat").alias("lat")).alias("raw"))
        return F.when(said.isNotNull(), let(key_values(said), both))

    def assemble(parts: Column) -> Column:
        objects, pairs = parts["objects"], parts["pairs"]
        return F.struct(
            parts["ego"].alias("ego_state"),
            parts["context"].alias("context"),
            parts["events"].alias("events"),
            F.when(parts["has"] == "yes", True).when(parts["has"] == "no", False).alias("has_objects"),
            parts["n"].alias("n_objects"),
            objects.alias("objects"),
            F.greatest(F.lit(0), parts["opened"] - F.size(objects)).alias("n_unclosed_obj"),
            parts["reason"].alias("reason"),
            parts["plan"].alias("final_plan"),
            parts["motion"]["read"].alias("motion"),
            parts["motion"]["raw"].alias("motion_raw"),
            F.when(F.size(pairs) >= 5, F.slice(pairs, 1, 5)).alias("traj"),
            F.coalesce(F.size(pairs), F.lit(0)).alias("traj_n_points"),
            parts["closed"].alias("traj_closed"),
        )

    parts = F.struct(
        let(tag(t, "ego_state"), ego).alias("ego"),
        key_values(tag(t, "context"), ";").alias("context"),
        let(tag(t, "events"), events).alias("events"),
        F.lower(F.regexp_extract(t, r"(?i)<has_objects>\s*(yes|no)", 1)).alias("has"),
        F.nullif(F.regexp_extract(t, r"<n_objects>\s*(\d+)", 1), F.lit("")).cast("int").alias("n"),
        parse_objects(t).alias("objects"),
        F.regexp_count(t, F.lit(r"<obj\s+type=")).alias("opened"),
        tag(t, "reason").alias("reason"),
        tag(t, "final_plan").alias("plan"),
        let(tag(t, "motion"), motion).alias("motion"),
        bracket_pairs(trajectory_text(t)).alias("pairs"),
        (t.contains("<traj>") & t.contains("</traj>")).alias("closed"),
    )
    return let(parts, assemble)


def canonical(value: Column) -> Column:
    """Attribute text for comparison: lower case, runs of blanks as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def loosely_equal(found: Column, truth: Column) -> Column:
    """Equal, or one within the other, by canonical texts; an empty text is within every other. False where either is missing."""
    both = lambda x, y: (x == y) | x.contains(y) | y.contains(x)
    return F.coalesce(let(canonical(found), lambda x: let(canonical(truth), lambda y: both(x, y))) & found.isNotNull() & truth.isNotNull(), F.lit(False))


def loosely_any(found: Column, truths: Column) -> Column:
    """Whether a text is loosely equal to any of a list."""
    return F.coalesce(F.exists(truths, lambda t: loosely_equal(found, t)), F.lit(False))


#: Fixed patterns, first match wins.
BEHAVIOUR = (
    ("turn left", r"\bu[\s-]?turn|\bleft turn\b|\bturn(?:ing|s)? left\b"),
    ("turn right", r"\bright turn\b|\bturn(?:ing|s)? right\b"),
    ("lane change", r"lane[\s-]?chang|\blang change|lane[\s-]?borrow|\bmerg|\bnudge\b|pull[\s-]?out"),
    ("parking", r"\bpark"),
    ("crossing", r"\bcross"),
    ("backing", r"\bbacking\b|\bback(?:ing)? up\b"),
    ("accelerating", r"\bacceler"),
    ("decelerating", r"\bdeceler|\bgive way\b|\byield"),
    ("stopping", r"\bstopp|\bstanding\b|\bstationary\b|\bhalt"),
    ("cruising", r"\bcruis|\bdriv|\bride\b|\briding\b|\bplanning to drive\b|\b(?:walk|walking|walkingn|run|running)\b(?!\s*(?:to|towards|near|aroud|around))"),
)
CONTENT = (
    ("keep left", r"\bkeep left\b"),
    ("keep right", r"\bkeep right\b"),
    ("no turn", r"\bno (?:left |right )?turn"),
    ("speed limit", r"speed limit"),
    ("lane guiding", r"lane guiding|guiding"),
    ("yield", r"\byield\b"),
    ("red", r"\bred\b"),
    ("green", r"\bgreen\b"),
    ("yellow", r"\byellow\b|\bamber\b"),
    ("stop", r"\bstop\b"),
)
#: Fixed values.
COARSE_BEHAVIOUR = {
    "cruising": "moving",
    "accelerating": "moving",
    "decelerating": "slowing/stopped",
    "stopping": "slowing/stopped",
    "parking": "parked",
    "turn left": "turning/merging",
    "turn right": "turning/merging",
    "lane change": "turning/merging",
    "crossing": "crossing",
}


def _first_rule(text: Column, rules: tuple) -> Column:
    out = F.lit("other")
    for label, pattern in reversed(rules):
        out = F.when(F.regexp_like(text, F.lit(pattern)), label).otherwise(out)
    return out


def behaviour(value: Column) -> Column:
    return _first_rule(canonical(value), BEHAVIOUR)


def coarse_behaviour(fine: Column) -> Column:
    """The coarse class, looked up: a rule per class would read the text again for each."""
    coarse = F.create_map(*[F.lit(name) for pair in COARSE_BEHAVIOUR.items() for name in pair])
    return F.coalesce(F.try_element_at(coarse, fine), F.lit("other"))


def content(value: Column) -> Column:
    """Canonical sign or signal content; a legend to stop on red is a stop."""
    text = canonical(value)
    return F.when(text.contains("stop") & text.contains("red"), "stop").otherwise(_first_rule(text, CONTENT))


#: Fixed patterns, first match wins.
LANES = (
    ("adjacent-same-dir", r"adjacent|same[- ]direction|neighbou?r|next lane|parallel lane"),
    ("oncoming", r"oncoming|opposite|opposing|incoming lane"),
    ("cross-street", r"cross[- ]?street|crossing street|perpendicular|intersecting|side street"),
    ("roadside", r"road ?side|side of the road|curb|kerb|sidewalk|shoulder|parking (?:lot|space|lane|area)"),
    ("ego-lane", r"same lane|ego(?:'s)?[- ]lane|in (?:the |my |our |its )?(?:current |own )?lane\b|current lane|own lane|ego path"),
)


def location_slots(value: Column) -> Column:
    """(direction, lane) of a location text; the first side word decides, NULL where nothing is said."""
    text = canonical(value)
    left, right = F.regexp_instr(text, F.lit(r"\bleft\b")), F.regexp_instr(text, F.lit(r"\bright\b"))
    side = F.when((left > 0) & ((right == 0) | (left < right)), "front left").when(right > 0, "front right").when(F.regexp_like(text, F.lit(r"\b(front|ahead)\b")), "front")
    return F.struct(side.alias("direction"), F.nullif(_first_rule(text, LANES), F.lit("other")).alias("lane"))


#: Characters of a chunk that counts as repeated.
CHUNK, LONGEST_CHUNK = 25, 200


def repeats(text: str | None) -> bool:
    """Whether a chunk of 25 to 200 characters stands three times in a row.

    In the first 25 characters of such a run is a place divisible by 25, and the 25 characters from
    there on stand again one chunk later: only those places are looked up. A pattern with a
    back-reference would try each length at each place.
    """
    text = text or ""
    for at in range(0, len(text) - 2 * CHUNK, CHUNK):
        probe, again = text[at : at + CHUNK], at + CHUNK - 1
        while (again := text.find(probe, again + 1, at + LONGEST_CHUNK + CHUNK)) >= 0:
            start, size = at, again - at
            while start > max(0, at - CHUNK + 1) and text[start - 1] == text[start - 1 + size]:
                start -= 1
            if start + 3 * size <= len(text) and text[start : start + 2 * size] == text[start + size : start + 3 * size]:
                return True
    return False


def degenerate(text: Column) -> Column:
    """Whether a chunk of 25 to 200 characters stands three times in a row."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return each_once(repeats, texts, pa.bool_())

    return run(text)


def without_thoughts(text: Column) -> Column:
    """Text without <think> blocks and end markers."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"<\|im_end\|>|<\|endoftext\|>|</s>", ""))


def fingerprint(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def verdict(reply: Column) -> Column:
    """(cause, effect) of a judge's reply: its two binary digits, or NULL."""
    digits = F.regexp_extract_all(reply, F.lit("[01]"), F.lit(0))
    return F.when(F.size(digits) == 2, F.struct(digits[0].cast("int").alias("cause"), digits[1].cast("int").alias("effect")))


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of word sets, NULL if both are empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))
