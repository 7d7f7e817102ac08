"""Intermediate times: from slots and labelled segments to ordered ``array<struct<label,time>>``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import of, strip_accents
from paceline.functions.times import format_seconds

#: What the five slots are called in each sport; slots that aren't named are left out.
SLOTS = ("swim", "t1", "bike", "t2", "run")
DEFAULT_KEYS = {"swim": "swim", "t1": "t1", "bike": "bike", "t2": "t2", "run": "run"}
KEYS = {
    "duathlon": {"swim": "course1", "t1": "t1", "bike": "bike", "t2": "t2", "run": "course2"},
    "aquathlon": {"swim": "swim", "t1": "t1", "run": "run"},
    "aquarun": {"swim": "swim", "t1": "t1", "run": "run"},
    "bike-run": {"swim": "segment1", "bike": "bike", "run": "run"},
    "swimrun": {"swim": "swim", "bike": "segment2", "run": "run"},
    "course-a-pied": {"run": "run"},
    "trail": {"run": "run"},
    "cyclisme": {"bike": "bike"},
    "swim-bike": {"swim": "swim", "t1": "t1", "bike": "bike"},
    "raid-multisport": {},
}
#: Sports whose names have a dash of their own.
DASHED = ("bike-run", "course-a-pied", "swim-bike", "cross-triathlon", "raid-multisport")
SPLITS = "array<struct<label:string,time:string>>"
#: The legs that are shown of each sport, with their titles; what words in a source's own label tell its kind, the first that is found.
SHOWN = {
    "duathlon": (("course1", "Course 1", "run"), ("t1", "T1", "transition"), ("bike", "Vélo", "bike"), ("t2", "T2", "transition"), ("course2", "Course 2", "run")),
    "bike-run": (("bike", "Vélo", "bike"), ("run", "Course", "run")),
    "aquathlon": (("swim", "Natation", "swim"), ("run", "Course", "run")),
    "aquarun": (("swim", "Natation", "swim"), ("t1", "T1", "transition"), ("run", "Course", "run")),
    "triathlon": (("swim", "Natation", "swim"), ("t1", "T1", "transition"), ("bike", "Vélo", "bike"), ("t2", "T2", "transition"), ("run", "Course", "run")),
}
LABEL_WORDS = (
    ("transition", r"^t\d+$|transition"),
    ("swim", "nat|swim"),
    ("bike", "velo|bike|cycl"),
    ("run", "course|run|pied|cap"),
)
SHOWN_TYPE = "array<struct<key:string,label:string,kind:string>>"


def sport_of_slug(c: Column | str) -> Column:
    text = F.lower(F.coalesce(of(c), F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for sport in DASHED:
        out = out.when(text.startswith(sport), F.lit(sport))
    return out.otherwise(F.split_part(text, F.lit("-"), F.lit(1)))


def present(splits: Column) -> Column:
    return F.filter(splits, lambda s: F.coalesce(s["time"], F.lit("")) != "")


def slot_splits(slug: Column | str, **times: Column | str) -> Column:
    """Splits of the slots ``swim=..., t1=..., bike=..., t2=..., run=...``, named as the sport has them; empty ones are left out."""
    sport = sport_of_slug(slug)

    def named(keys: dict[str, str]) -> Column:
        made = [F.struct(F.lit(k).alias("label"), of(times[s]).cast("string").alias("time")) for s, k in keys.items() if s in times]
        return F.array(*made).cast(SPLITS) if made else F.array().cast(SPLITS)

    out = F.when(F.lit(False), F.array().cast(SPLITS))
    for name, keys in KEYS.items():
        out = out.when(sport == name, named(keys))
    return present(out.otherwise(named(DEFAULT_KEYS)))


def labelled_splits(segments: Column | str) -> Column:
    """Segments without empty times; the second and further of a label get `` (2)``, `` (3)`` ..., so labels are unique."""
    kept = present(of(segments).cast(SPLITS))

    def add(done: Column, s: Column) -> Column:
        # the smallest number whose label is free, as the labels already there may carry numbers
        taken = F.transform(done, lambda x: x["label"])
        tries = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda k: F.concat(s["label"], F.lit(" ("), k.cast("string"), F.lit(")")))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(taken, t)), F.lit(0))
        label = F.when(F.array_contains(taken, s["label"]), free).otherwise(s["label"])
        return F.concat(done, F.array(F.struct(label.alias("label"), s["time"].alias("time"))).cast(SPLITS))

    return F.aggregate(kept, F.array().cast(SPLITS), add)


def build_splits(segments: Column | str, slug: Column | str, **times: Column | str) -> Column:
    """Labelled segments if there are any, else the slots."""
    some = F.coalesce(F.size(of(segments)), F.lit(0)) > 0
    return F.when(some, labelled_splits(segments)).otherwise(slot_splits(slug, **times))


def as_map(splits: Column | str) -> Column:
    return F.map_from_entries(of(splits))


def label_slots(labels: Column | str, table: dict[str, str]) -> Column:
    """Slots of labels by ``table`` (lower-case label to slot), all or none: one unknown label gives null."""
    lowered = F.transform(of(labels), lambda x: F.lower(F.trim(x)))
    known = F.forall(lowered, lambda x: x.isin(*table))
    mapped = F.transform(lowered, lambda x: reduce(lambda out, kv: out.when(x == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(""))))
    return F.when(known, mapped)


def steps_of_cumulative(points: Column | str) -> Column:
    """``struct(seconds, falling)``: differences of cumulative seconds to the last positive one before.

    A point without a positive value has none and is passed over. If any difference is negative the
    values are kept as they are and ``falling`` is true.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))
    value = lambda x: F.when(x.cast("bigint") > 0, x.cast("bigint"))
    walked = F.aggregate(
        of(points),
        start,
        lambda acc, x: F.struct(
            F.coalesce(value(x), acc["last"]).alias("last"), F.concat(acc["out"], F.array(value(x) - acc["last"])).alias("out")
        ),
        lambda acc: acc["out"],
    )
    falling = F.exists(walked, lambda d: F.coalesce(d < 0, F.lit(False)))
    kept = F.transform(of(points), lambda x: value(x))
    return F.struct(F.when(falling, kept).otherwise(walked).alias("seconds"), falling.alias("falling"))


def looks_cumulative(points: Column | str) -> Column:
    """Two or more positive values, each above the one before."""
    p = F.filter(of(points), lambda x: x > 0)
    rises = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: a < b)
    return (F.size(p) >= 2) & F.forall(rises, lambda x: x)


def nearest_point(points: Column | str, seconds: Column | str) -> Column:
    """The smallest of the values nearest to ``seconds``; null for an empty array."""
    near = F.array_min(F.transform(of(points), lambda p: F.struct(F.abs(p - of(seconds)).alias("gap"), p.alias("value"))))
    return near["value"]


def next_point(points: Column | str, value: Column | str) -> Column:
    return F.array_min(F.filter(of(points), lambda p: p > of(value)))


def readable(splits: Column | str) -> Column:
    """``label=time`` pairs as one text, for reports."""
    return F.array_join(F.transform(of(splits), lambda s: F.concat_ws("=", s["label"], s["time"])), "; ")


def of_seconds(labels: Column, seconds: Column) -> Column:
    """Splits from two arrays; a second that is null or not positive gives no split."""
    return F.filter(
        F.zip_with(labels, seconds, lambda a, b: F.struct(a.alias("label"), F.when(b > 0, format_seconds(b)).alias("time"))),
        lambda s: s["time"].isNotNull(),
    )


def shown_sport(slug: Column | str) -> Column:
    """The sport whose legs are shown: any duathlon, a sport that is named exactly, else triathlon."""
    text = F.coalesce(of(slug), F.lit(""))
    return F.when(text.startswith("duathlon"), "duathlon").when(text.isin("bike-run", "aquathlon", "aquarun"), text).otherwise("triathlon")


def label_kind(label: Column | str) -> Column:
    """The kind that the words of a source's own label tell, else ``other``."""
    text = F.lower(strip_accents(of(label)))
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(kind)) for kind, pattern in LABEL_WORDS), F.lit("other"))


def shown_columns(slug: Column | str, keys: Column | str) -> Column:
    """Legs ``key, label, kind`` that are shown of a course with splits ``keys``: those of its sport, or, if it has none of them, its own labels in their order."""
    keys = of(keys)
    sport = shown_sport(slug)
    template = F.when(F.lit(False), F.array().cast(SHOWN_TYPE))
    for name, legs in SHOWN.items():
        entries = [F.struct(F.lit(k).alias("key"), F.lit(t).alias("label"), F.lit(kind).alias("kind")) for k, t, kind in legs]
        template = template.when(sport == name, F.array(*entries).cast(SHOWN_TYPE))
    expected = F.filter(template, lambda e: F.array_contains(keys, e["key"]))
    own = F.transform(keys, lambda k: F.struct(k.alias("key"), k.alias("label"), label_kind(k).alias("kind")))
    return F.when(F.size(expected) > 0, expected).otherwise(own.cast(SHOWN_TYPE))


def shown_splits(slug: Column | str, splits: Column | str) -> Column:
    """Legs ``key, label, kind, time`` that are shown of a participation; splits without a time aren't."""
    kept = present(of(splits).cast(SPLITS))
    legs = shown_columns(slug, F.transform(kept, lambda s: s["label"]))
    time = lambda e: F.get(F.filter(kept, lambda s: s["label"] == e["key"]), F.lit(0))["time"]
    return F.transform(legs, lambda e: F.struct(e["key"].alias("key"), e["label"].alias("label"), e["kind"].alias("kind"), time(e).alias("time")))
