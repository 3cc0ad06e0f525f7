"""Column functions over ego series: speeds, motion classes, displacement errors, trajectories.

Series are arrays sampled at 4 Hz. A missing value is NULL throughout: NaN is never stored, and a
measure without support is NULL rather than zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.text import let

#: Seconds between samples, samples kept, thresholds in m/s, seconds and degrees.
STEP_S, PAST, FUTURE = 0.25, 16, 20
STOPPED, START_MAX, EGO_CHANGE, STOPPED_CAP_S = 0.5, 1.0, 0.6, 4.0
TURN_DEG, RESIDUAL_DEG = 25.0, 5.0
TURNS = ("GO_LEFT", "GO_RIGHT")
SECONDS = (4, 8, 12, 16, 20)  # samples at 1..5 s, from 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """NULL for an empty string: both count as missing."""
    return F.nullif(_col(c), F.lit(""))


def effective_intent(corrected: Column | str, raw: Column | str) -> Column:
    return F.coalesce(present(corrected), present(raw), F.lit("GO_STRAIGHT"))


def paired_size(*arrays: Column) -> Column:
    sizes = [F.coalesce(F.size(a), F.lit(0)) for a in arrays]
    return F.least(*sizes) if len(sizes) > 1 else sizes[0]


def last_n(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def past_speeds(vel_x: Column, vel_y: Column, pos_x: Column, pos_y: Column) -> Column:
    """Speed per past sample: from velocities where there are any, else from position differences."""
    n, m = paired_size(vel_x, vel_y), paired_size(pos_x, pos_y)
    from_vel = F.zip_with(F.slice(vel_x, 1, n), F.slice(vel_y, 1, n), F.hypot)
    steps = F.transform(F.sequence(F.lit(2), m), lambda i: F.hypot(F.get(pos_x, i - 1) - F.get(pos_x, i - 2), F.get(pos_y, i - 1) - F.get(pos_y, i - 2)) / STEP_S)
    from_pos = F.when(m >= 2, F.concat(F.slice(steps, 1, 1), steps)).otherwise(F.array_repeat(F.lit(0.0), m))
    return last_n(F.when(n > 0, from_vel).otherwise(from_pos), PAST)


def points(x: Column, y: Column, n: int = FUTURE) -> Column:
    """array<struct<x, y>> of at most n samples; the shorter array decides."""
    k = F.least(paired_size(x, y), F.lit(n))
    return F.zip_with(F.slice(x, 1, k), F.slice(y, 1, k), lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def step_lengths(pts: Column) -> Column:
    """Distances between neighbours, the first one from the origin."""
    zero = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    before = F.concat(zero, F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))))
    return F.zip_with(F.when(F.size(pts) > 0, before).otherwise(pts), pts, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def future_speeds(pts: Column) -> Column:
    return F.transform(step_lengths(pts), lambda d: d / STEP_S)


def array_mean(a: Column) -> Column:
    """Mean of the non-null elements; NULL without any."""
    some = F.filter(a, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, x: s + x), F.size(some).cast("double"))


def end_speed(speeds: Column) -> Column:
    """Mean over the last second; NULL if there is no future."""
    return array_mean(last_n(speeds, 4))


def start_time(speeds: Column) -> Column:
    """Seconds to the first step at or above the stopped speed; NULL if there is none."""
    first = F.array_position(F.transform(speeds, lambda s: s >= STOPPED), True)
    return F.when(first > 0, first * STEP_S)


def trailing_run(values: Column, below: float = STOPPED) -> Column:
    """How many values at the end are below a bound."""
    return F.aggregate(values, F.lit(0), lambda n, x: F.when(x < below, n + 1).otherwise(0))


def back_in_array(values: Column, k: int) -> Column:
    """The value k places before the last, the first one if the array is shorter, NULL if empty."""
    return F.coalesce(F.try_element_at(values, F.lit(-1 - k)), F.try_element_at(values, F.lit(1)))


def change_bound(v0: Column) -> Column:
    return F.greatest(F.lit(1.0), v0 * 0.2)


def sample_class(v0: Column, v_end: Column, v_max: Column, moving_without_future: str = "") -> Column:
    """stay, start, stop, decel, accel or keep, in that order of rules. Without a future (NULL v_end):
    stay if stopped else keep; or ``moving_without_future`` in every case, as for predicted paths."""
    bound = change_bound(v0)
    none = F.lit(moving_without_future) if moving_without_future else F.when(v0 < STOPPED, "stay").otherwise("keep")
    return (
        F.when(v_end.isNull(), none)
        .when((v0 < STOPPED) & (v_max < STOPPED), "stay")
        .when((v0 < STOPPED) & (v_max >= START_MAX), "start")
        .when((v0 >= STOPPED) & (v_end < STOPPED), "stop")
        .when(v_end < v0 - bound, "decel")
        .when(v_end > v0 + bound, "accel")
        .otherwise("keep")
    )


def lon_class(v0: Column, v_end: Column, v_max: Column) -> Column:
    """stop, accelerate, decelerate or keep; stop is tried first."""
    bound = change_bound(v0)
    return (
        F.when(v_end.isNull(), F.when(v0 < STOPPED, "stop").otherwise("keep"))
        .when(v_end < STOPPED, "stop")
        .when(((v0 < STOPPED) & (v_max >= START_MAX)) | (v_end - v0 > bound), "accelerate")
        .when(v0 - v_end > bound, "decelerate")
        .otherwise("keep")
    )


def lat_class(theta: Column, residual: Column, intent: Column) -> Column:
    """A large heading change is a turn where it does not fit a smooth curve, or where a turn was meant."""
    turn = (F.abs(theta) >= TURN_DEG) & ((residual >= RESIDUAL_DEG) | intent.isin(*TURNS))
    return F.when(turn, F.when(theta > 0, "left_turn").otherwise("right_turn")).otherwise("straight")


def heading_class(theta: Column) -> Column:
    """A large heading change is a turn, however smooth and whatever was meant."""
    return F.when(F.abs(theta) >= TURN_DEG, F.when(theta > 0, "left_turn").otherwise("right_turn")).otherwise("straight")


def ego_class(v0: Column, v1: Column) -> Column:
    """Present behaviour: stopped, or by the change within the last second."""
    return F.when(v0 < STOPPED, "stopped").when(v0 - v1 > EGO_CHANGE, "accelerating").when(v0 - v1 < -EGO_CHANGE, "decelerating").otherwise("cruising")


def stopped_seconds(speeds: Column) -> Column:
    return F.least(trailing_run(speeds) * STEP_S, F.lit(STOPPED_CAP_S))


#: Names and upper bounds of the speed buckets.
FOUR = (("v0<0.5", 0.5), ("0.5<=v0<3", 3.0), ("3<=v0<8", 8.0), ("v0>=8", float("inf")))
FIVE = (("v0<0.5", 0.5), ("0.5-3", 3.0), ("3-8", 8.0), ("8-15", 15.0), ("15+", float("inf")))


def speed_bucket(v: Column, buckets: tuple = FOUR) -> Column:
    out = F.lit(buckets[-1][0])
    for name, high in reversed(buckets[:-1]):
        out = F.when(v < high, name).otherwise(out)
    return out


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 2, "1-2").otherwise("3+")


def displacement(pred: Column, truth: Column) -> Column:
    """Errors per sample; a short prediction goes on with its last point, a short truth ends it."""


    def errors(p: Column, t: Column) -> Column:
        held = F.array_repeat(F.try_element_at(p, F.lit(-1)), F.greatest(F.size(t) - F.size(p), F.lit(0)))
        steps = F.zip_with(F.slice(F.concat(p, held), F.lit(1), F.size(t)), t, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
        return F.when((F.size(p) > 0) & (F.size(t) > 0), steps)

    return let(pred, lambda p: let(truth, lambda t: errors(p, t)))


def average_error(errors: Column, samples: int) -> Column:
    return array_mean(F.slice(errors, 1, samples))


def final_error(errors: Column) -> Column:
    return F.try_element_at(errors, F.lit(-1))


def trajectory_score(ade5: Column) -> Column:
    """exp(-error / 2); a missing prediction scores zero."""
    return F.coalesce(F.exp(-ade5 / 2), F.lit(0.0))


def points_1hz(pts: Column) -> Column:
    """The samples at 1 to 5 s, NULL if the path is shorter."""
    return F.when(F.size(pts) >= FUTURE, F.transform(F.array(*[F.lit(i) for i in SECONDS]), lambda i: F.element_at(pts, i)))


def constant_velocity(vx: Column, vy: Column, n: int = FUTURE) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((vx * k * STEP_S).alias("x"), (vy * k * STEP_S).alias("y")))


def resample(pts: Column, seconds: Column, n: int = FUTURE) -> Column:
    """A path with one point every ``seconds``, linearly resampled to n samples; the origin is added
    before and the end held; an empty path becomes zeros."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def at(path: Column, place: Column) -> Column:
        """Where a path is after so many of its steps."""
        low = F.least(F.floor(place).cast("int"), F.size(path) - 1)
        a, b = F.get(path, low), F.get(path, F.least(low + 1, F.size(path) - 1))
        part = F.least(place - low, F.lit(1.0))
        return F.struct((a["x"] + (b["x"] - a["x"]) * part).alias("x"), (a["y"] + (b["y"] - a["y"]) * part).alias("y"))

    places = lambda path: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: at(path, k * STEP_S / seconds))
    return let(F.concat(F.array(zero), pts), places)


def running_sums(values: Column) -> Column:
    """Sums of the first one, two, three… values."""
    add = lambda sums, x: F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0)) + x)
    return F.aggregate(values, F.array().cast("array<double>"), add)


def waypoint_weights(pts: Column, reference: Column) -> Column:
    """3 times (1 + distance from the reference path / 2, between 1 and 3)."""
    return F.zip_with(pts, reference, lambda a, b: F.lit(3.0) * F.greatest(F.lit(1.0), F.least(F.lit(3.0), 1 + F.hypot(a["x"] - b["x"], a["y"] - b["y"]) / 2)))


#: Fixed values in metres, and metres a second: equal steps, varying truth, flat speed.
EQUAL_STEP, VARYING_STEP, FLAT_SPEED = 0.05, 0.5, 0.5


def is_progression(pts: Column, within: float = EQUAL_STEP) -> Column:
    """Whether a path goes on by one and the same real step on both axes, from the origin on; two points at least."""
    origin = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    moved = lambda p: F.zip_with(p, F.slice(F.concat(origin, p), F.lit(1), F.size(p)), lambda b, a: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))

    def even(steps: Column) -> Column:
        first = F.get(steps, F.lit(0))
        same = F.forall(steps, lambda s: (F.abs(s["x"] - first["x"]) <= within) & (F.abs(s["y"] - first["y"]) <= within))
        return (F.size(steps) >= 2) & (F.hypot(first["x"], first["y"]) >= within) & same

    return F.coalesce(let(let(pts, moved), even), F.lit(False))


def spread_of_steps(pts: Column) -> Column:
    """Largest less smallest step length, the first one from the origin."""
    return let(step_lengths(pts), lambda d: F.array_max(d) - F.array_min(d))


def varies(truth: Column, more: float = VARYING_STEP) -> Column:
    """Whether the steps of a 4 Hz path between full seconds differ by more than half a metre; false without a full path."""
    return F.coalesce(spread_of_steps(points_1hz(truth)) > more, F.lit(False))


def is_flat(pts: Column, less: float = FLAT_SPEED) -> Column:
    """Whether a path of one point a second keeps its speed, and moves."""
    return F.coalesce(let(step_lengths(pts), lambda d: (F.array_max(d) - F.array_min(d) < less) & (F.array_max(d) >= STOPPED)), F.lit(False))


def smallest_forward_step(pts: Column) -> Column:
    x = F.concat(F.array(F.lit(0.0)), F.transform(pts, lambda p: p["x"]))
    return F.array_min(F.zip_with(F.slice(x, 2, F.size(pts)), F.slice(x, 1, F.size(pts)), lambda b, a: b - a))
