"""Closed vocabularies and the columns that map onto them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object types by the attribute fields that they own.
DYNAMIC = ("Car", "Truck", "Bus", "Motorcyclist", "Construction vehicle", "Pedestrian", "Cyclist", "Scooter rider", "Emergency vehicle", "School bus", "Other")
CONTROL = ("Traffic light", "Sign")
TYPE_ONLY = ("Stop line", "Cross walk", "Bump", "Temporary control")
LOCATION_ONLY = ("Object", "Animal")
TYPES = (*DYNAMIC, *CONTROL, *TYPE_ONLY, *LOCATION_ONLY)
#: Context vocabularies.
CONTEXT = {
    "weather": ("Sunny", "Cloudy", "Rainy", "Fog", "Fair", "Unknown"),
    "daytime": ("Day", "Night"),
    "visibility": ("Clear", "Reduced", "Limited", "Poor"),
    "road": ("Mid-block", "Intersection", "Diverge", "Merge", "Roundabout"),
}
CONTEXT_KEYS = ("weather", "daytime", "visibility", "scenario", "road")
EVENTS = ("Roadside parking", "Construction", "Lane guiding", "Lane closure", "Partially occupied lane", "Road closure", "Accident", "Traffic signal malfunction", "Traffic jam")
#: Spellings to repair.
SCENARIO_MAP = {
    "Suburban, Residential": "Suburban Residential",
    "Urban, Residential": "Urban Residential",
    "Urban, Highway": "Urban Highway",
    "Rural, Highway": "Rural Highway",
    "Suburban, Highway": "Suburban Highway",
    "Parking, Lot": "Parking Lot",
    "Rural, Residential": "Rural Residential",
    "": "Unknown",
}
EVENT_MAP = {
    "left roadside parking": "Roadside parking",
    "Vehicle performing a parallel parking maneuver": "Roadside parking",
    "cone on the road": "Partially occupied lane",
    "cone on the road side": "Partially occupied lane",
    "traffic jam": "Traffic jam",
}
EVENT_DROP = ("pedestrains crossing in groups", "none", "Airport", "Factory", "unpaved parking lot with no marking", "No Lane Lines")
#: Values of intention and state that are common.
MAJORITY = ("cruising", "stopping", "parking", "crossing", "")
#: Dataset classes of fine types. An animal is an obstacle here and a vulnerable user in the coarse classes.
DATASET_CLASS = {
    "vehicle": ("car", "truck", "bus", "emergency vehicle", "construction vehicle", "school bus"),
    "traffic control": ("traffic light", "sign", "stop line", "cross walk", "crosswalk", "temporary control", "bump"),
    "vulnerable user": ("pedestrian", "cyclist", "motorcyclist", "scooter rider"),
    "obstacle": ("object", "animal"),
}


def _map(col: Column, pairs: dict[str, str]) -> Column:
    out = col
    for source, target in reversed(pairs.items()):
        out = F.when(col == source, target).otherwise(out)
    return out


def norm_type(col: Column) -> Column:
    return F.when(col.isin(*TYPES), col).otherwise("Other")


def type_fields(col: Column) -> Column:
    """Attribute fields that a type owns."""
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    none = F.array().cast("array<string>")
    return F.when(col.isin(*DYNAMIC), names("location", "intention", "state")).when(col.isin(*CONTROL), names("content")).when(col.isin(*LOCATION_ONLY), names("location")).otherwise(none)


def norm_context(context: Column) -> Column:
    """The five context keys of a struct, missing and empty ones as Unknown."""
    return F.struct(*[F.coalesce(F.nullif(context[k], F.lit("")), F.lit("Unknown")).alias(k) for k in CONTEXT_KEYS])


def clean_scenario(col: Column) -> Column:
    """Repaired spelling; an empty scenario is Unknown, a missing one stays missing."""
    return _map(col, SCENARIO_MAP)


def clean_weather(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("Fair"))


def clean_event_types(types: Column) -> Column:
    """Types of one event: repaired, those without use dropped, each once and in order."""
    return F.array_distinct(F.transform(F.filter(types, lambda t: ~t.isin(*EVENT_DROP)), lambda t: _map(t, EVENT_MAP)))


def clean_events(events: Column) -> Column:
    """array<array<string>>: every event cleaned, and those with no type left removed."""
    return F.filter(F.transform(events, clean_event_types), lambda e: F.size(e) > 0)


def enum_ok(context: Column, events: Column) -> Column:
    """Whether every present value is in its vocabulary."""
    fine = F.lit(True)
    for key, values in CONTEXT.items():
        fine = fine & (context[key].isNull() | context[key].isin(*values))
    return fine & F.forall(F.flatten(events), lambda e: e.isin(*EVENTS))


def has_event(events: Column) -> Column:
    """Any event type but roadside parking."""
    return F.exists(F.flatten(events), lambda e: e != "Roadside parking")


def minority(intention: Column, state: Column) -> Column:
    common = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*MAJORITY)
    return ~common(intention) | ~common(state)


def dataset_class(canonical: Column) -> Column:
    """Dataset class of a canonical type text: exact, else by containment either way, else unknown."""
    exact, loose = F.lit(None).cast("string"), F.lit("unknown")
    for name, types in reversed(DATASET_CLASS.items()):
        for t in reversed(types):
            loose = F.when(canonical.contains(t) | ((F.length(canonical) > 3) & F.lit(t).contains(canonical)), name).otherwise(loose)
        exact = F.when(canonical.isin(*types), name).otherwise(exact)
    return F.coalesce(exact, loose)
