"""Reclassification of what is stored: types become canonical, bare ones are refined by the name, and courses that thereby become one are merged.

In the order of ids, a course whose type changes gives its participations to the course that then has its identity (name, day, type, kind of starters), or
takes the new type itself if there is none. A canonical type stays as it is, so a course of the new type is never rewritten; hence the keeper of an
identity is its first course that has the type already, or else the first that gets it. This is an aggregate: no order of rewriting has to be kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.disciplines import classify, distance_km, normalize_slug
from paceline.functions.text import of

#: Types that a name may refine; sports whose names have a dash.
BARE = ("triathlon", "duathlon", "swimrun", "cyclisme", "course-a-pied", "trail")
DASHED = ("bike-run", "course-a-pied")


def sport_base(c: Column | str) -> Column:
    whole = reduce(lambda out, s: out.when(of(c).startswith(s), F.lit(s)), DASHED, F.when(F.lit(False), F.lit("")))
    return whole.otherwise(F.split_part(of(c), F.lit("-"), F.lit(1)))


def resolved_type(name: Column | str, event_type: Column | str) -> Column:
    """The canonical type; a bare one takes the size that the name tells, if the name tells the same sport."""
    plain, told = normalize_slug(event_type), classify(name)
    return F.when(plain.isin(*BARE) & ~told.isin(*BARE) & (sport_base(told) == sport_base(plain)), told).otherwise(plain)


def plan(courses: DataFrame) -> DataFrame:
    """``courses`` with ``new_type``, ``keeper`` (the course that it becomes part of, or itself) and ``fills_distance``."""
    key = ["name", "event_date", "is_relay", "new_type"]
    typed = courses.withColumn("new_type", resolved_type("name", "event_type"))
    stays = F.coalesce(F.col("event_type") == F.col("new_type"), F.lit(False))
    # whatever already has the type is there before any rewriting
    kept = typed.groupBy(*key).agg(F.coalesce(F.min(F.when(stays, F.col("id"))), F.min("id")).alias("_keeper"))
    kept = kept.select(*(F.col(k).alias(f"_{k}") for k in key), "_keeper")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    out = typed.join(kept, same, "left").withColumn("keeper", F.when(stays, F.col("id")).otherwise(F.col("_keeper")))
    told = F.col("distance_km").isNull() & distance_km("name").isNotNull()
    return out.withColumn("fills_distance", told).select(*courses.columns, "new_type", "keeper", "fills_distance")


def reclassified(courses: DataFrame) -> DataFrame:
    """Courses after reclassification: those that were merged into another one are gone, missing distances are read from names."""
    km = F.when(F.col("fills_distance"), distance_km("name")).otherwise(F.col("distance_km"))
    out = plan(courses).where("keeper = id").withColumns({"event_type": F.col("new_type"), "distance_km": km})
    return out.select(courses.columns)


def moved_parts(parts: DataFrame, courses: DataFrame) -> DataFrame:
    """Participations with those of merged courses given to the keeper; two bibs that thereby meet stay both."""
    to = plan(courses).where("keeper <> id").select(F.col("id").alias("course_id"), "keeper")
    return parts.join(to, "course_id", "left").withColumn("course_id", F.coalesce("keeper", "course_id")).select(parts.columns)


def changes(courses: DataFrame) -> DataFrame:
    """One row: how many types were rewritten, courses merged, distances filled, and ``changed``, their sum."""
    rewritten = ~F.col("event_type").eqNullSafe(F.col("new_type")) & (F.col("keeper") == F.col("id"))
    out = plan(courses).agg(F.count_if(rewritten).alias("rewritten"), F.count_if(F.col("keeper") != F.col("id")).alias("merged"), F.count_if("fills_distance").alias("distances"))
    return out.withColumn("changed", F.col("rewritten") + F.col("merged") + F.col("distances"))
