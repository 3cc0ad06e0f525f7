"""Prompts and training targets as columns: ordered segments of (text, field, factor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geometry, motion, vocab
from ridgeline.functions.text import fingerprint

#: Fields in order of their ids, and their loss weights.
WEIGHTS = {
    "struct": 0.2,
    "context": 1.0,
    "events": 1.0,
    "presence": 1.0,
    "type": 2.0,
    "location": 2.0,
    "intention": 1.5,
    "state": 1.5,
    "content": 2.0,
    "point": 3.0,
    "implication": 1.5,
    "reason": 1.5,
    "final_plan": 1.5,
    "traj": 3.0,
    "count": 2.0,
    "obj_open": 3.0,
    "ego_state": 1.0,
    "rank": 1.5,
    "motion": 2.0,
}
#: Fixed formats of the user turn and the chat scaffold.
HISTORY = "History (past 4 s, 16 waypoints at 4 Hz, ego frame, meters): "
INSTRUCTION = {
    "s1": "Describe the scene per the required format.",
    "s2": "Describe the scene, then reason and plan, then output the trajectory per the required format.",
}
ATTRIBUTE_QUESTION = "Describe the object of type %s located at <point>%d,%d</point> per the required format."
IMAGE_PAD = "<|image_pad|>"
_SEGMENT = "array<struct<text:string,field:string,factor:double>>"


def seg(text: Column | str, field: str = "struct", factor: Column | float = 1.0) -> Column:
    t = text if isinstance(text, Column) else F.lit(text)
    return F.struct(t.alias("text"), F.lit(field).alias("field"), (factor if isinstance(factor, Column) else F.lit(float(factor))).cast("double").alias("factor"))


def tagged(name: str, text: Column, field: str, factor: Column | float = 1.0) -> Column:
    return F.array(seg(f"<{name}>"), seg(text, field, factor), seg(f"</{name}>"))


def optional(name: str, text: Column, field: str, factor: Column | float = 1.0) -> Column:
    """A tagged segment, or nothing if the text is missing or blank."""
    said = F.nullif(F.trim(text), F.lit(""))
    return F.when(said.isNotNull(), tagged(name, said, field, factor)).otherwise(F.array().cast(_SEGMENT))


def object_segments(o: Column, implication: bool) -> Column:
    """One object: type, point (x, y), written rank, the attributes its type owns, and its implication."""
    kind = vocab.norm_type(o["type"])
    owned = vocab.type_fields(kind)
    none = F.array().cast(_SEGMENT)
    point = F.when(o["point"].isNotNull(), tagged("point", F.format_string("%d,%d", o["point"]["x"].cast("long"), o["point"]["y"].cast("long")), "point")).otherwise(none)
    parts = [F.array(seg("<obj type=", "obj_open"), seg(kind, "type"), seg(">")), point, tagged("rank", o["rank"].cast("string"), "rank")]
    for f in ("location", "intention", "state", "content"):
        factor = F.coalesce(o[f"{f}_factor"], F.lit(1.0)) if f in ("intention", "state") else 1.0
        parts.append(F.when(F.array_contains(owned, f), optional(f, o[f], f, factor)).otherwise(none))
    if implication:
        parts.append(optional("implication", o["implication"], "implication"))
    return F.concat(*parts, F.array(seg("</obj>")))


def scene_segments(context: Column, events: Column, objects: Column, implication: bool) -> Column:
    """Context, events, presence, objects in order of rank, and their number as a checksum."""
    c = vocab.norm_context(context)
    line = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), c[k]) for k in vocab.CONTEXT_KEYS])
    names = F.array_join(F.flatten(events), ",")
    some = F.size(objects) > 0
    listed = F.flatten(F.transform(objects, lambda o: object_segments(o, implication)))
    count = F.when(some, tagged("n_objects", F.size(objects).cast("string"), "count")).otherwise(F.array().cast(_SEGMENT))
    return F.concat(tagged("context", line, "context"), tagged("events", F.coalesce(F.nullif(names, F.lit("")), F.lit("none")), "events"), tagged("has_objects", F.when(some, "yes").otherwise("no"), "presence"), listed, count)


def trajectory_segments(points: Column, weights: Column) -> Column:
    """<traj> with one segment per waypoint, its factor a third of the waypoint's weight."""
    texts = F.split(geometry.encode_path(points), r"(?=, \[)")
    ways = F.zip_with(texts, weights, lambda t, w: F.struct(t.alias("text"), F.lit("traj").alias("field"), (w / 3.0).alias("factor")))
    return F.concat(F.array(seg("<traj>")), ways, F.array(seg("</traj>")))


def build_targets(df: DataFrame, task: str) -> DataFrame:
    """df with ``segments`` for task s1, s2 or attrqa.

    attrqa asks for one object: needs ``object`` (a ranked struct), and its attributes are the answer.
    The others need context, events (array<array<string>>) and objects (ranked structs); s2 also ego_text,
    reason, reason_weight (NULL: as it is), plan, motion_text, points (5) and waypoint_weights.
    """
    if task == "attrqa":
        return df.withColumn("segments", object_segments(F.col("object"), False))
    scene = scene_segments(F.col("context"), F.col("events"), F.col("objects"), task == "s2")
    if task == "s1":
        return df.withColumn("segments", scene)
    factor = F.coalesce(F.col("reason_weight") / WEIGHTS["reason"], F.lit(1.0))
    chain = [optional("reason", F.col("reason"), "reason", factor), optional("final_plan", F.col("plan"), "final_plan"), tagged("motion", F.col("motion_text"), "motion"), trajectory_segments(F.col("points"), F.col("waypoint_weights"))]
    return df.withColumn("segments", F.concat(tagged("ego_state", F.col("ego_text"), "ego_state"), scene, *chain))


def attribute_question(kind: Column, x: Column, y: Column) -> Column:
    """The question for one object's attributes, by its type and place."""
    return F.format_string(ATTRIBUTE_QUESTION, vocab.norm_type(kind), x.cast("long"), y.cast("long"))


def segment_columns(df: DataFrame, segments: str = "segments") -> DataFrame:
    """df with target text, weights, field ids and the trajectory mask of its segments."""
    s = F.col(segments)
    table = F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv])
    ids = F.create_map(*[F.lit(v) for i, f in enumerate(WEIGHTS) for v in (f, i)])
    return df.withColumns({
        "target": F.array_join(F.transform(s, lambda x: x["text"]), ""),
        "weights": F.transform(s, lambda x: F.element_at(table, x["field"]) * x["factor"]),
        "field_ids": F.transform(s, lambda x: F.element_at(ids, x["field"])),
        "traj_mask": F.transform(s, lambda x: x["field"] == "traj"),
    })


def truth_prefix(segments: Column, level: str) -> Column:
    """The truth's own text up to where a model goes on: level "understanding" ends before the reason (or, without one, before plan or motion), "chain" with the opened trajectory. NULL where there is no such place."""
    if level not in ("understanding", "chain"):
        raise ValueError(f"no level {level!r}")
    texts = F.transform(segments, lambda s: s["text"])
    place = lambda tag: F.nullif(F.array_position(texts, tag), F.lit(0))
    end = place("<traj>") if level == "chain" else F.coalesce(place("<reason>"), F.least(place("<final_plan>"), place("<motion>"))) - 1
    return F.array_join(F.slice(texts, F.lit(1), end.cast("int")), "")


def user_text(history: Column, corrected: Column, raw: Column, instruction: Column) -> Column:
    """The user turn: history (array<struct<x, y>>, last 16), intent and instruction."""
    return F.concat(F.lit(HISTORY), geometry.encode_path(motion.last_n(history, motion.PAST)), F.lit("\nIntent: "), motion.effective_intent(corrected, raw), F.lit("\n"), instruction)


def render_prompt(system: Column, user: Column, image_tokens: int) -> Column:
    """The whole chat up to the assistant's header, with the image's place-holders."""
    return F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n<|vision_start|>"), F.lit(IMAGE_PAD * image_tokens), F.lit("<|vision_end|>"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def prompt_hash(*parts: Column) -> Column:
    return fingerprint(F.concat_ws("|", *parts))


def ego_text(speeds: Column, lateral: Column) -> Column:
    """``lon=… | lat=…`` of the present behaviour."""
    v0, v1 = F.try_element_at(speeds, F.lit(-1)), motion.back_in_array(speeds, 4)
    seconds = motion.stopped_seconds(speeds)
    still = F.concat(F.lit("stopped "), geometry.one_decimal(seconds), F.when(seconds >= motion.STOPPED_CAP_S, "s+").otherwise("s"))
    kind = motion.ego_class(v0, v1)
    change = F.concat(kind, F.lit(" "), geometry.one_decimal(v1), F.lit("->"), geometry.one_decimal(v0), F.lit(" m/s"))
    lon = F.when(kind == "stopped", still).when(kind == "cruising", F.concat(F.lit("cruising "), geometry.one_decimal(v0), F.lit(" m/s"))).otherwise(change)
    return F.concat(F.lit("lon="), lon, F.lit(" | lat="), F.coalesce(F.nullif(F.trim(lateral), F.lit("")), F.lit("n/a")))
