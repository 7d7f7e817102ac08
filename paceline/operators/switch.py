"""Writes that touch several tables: changing a course's source, whose ranking is replaced as a whole and never mixed, deleting courses, merging two.

``fresh`` are the participations read from the new source, with the identity that it publishes (``name, event_date, event_type, course_relay``), resolved to ``course_id`` and ``athlete_id``.
The result is all tables anew; `paceline.sources.snapshots.publish` writes them together or not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.upsert import activate_source, without_course

IDENTITY = {"name": "name", "event_date": "event_date", "event_type": "event_type", "is_relay": "course_relay"}


def same_event(courses: DataFrame, fresh: DataFrame, course_id: int) -> DataFrame:
    """One row: ``n_rows`` that were read, and how many of them, ``n_same``, say that they are of this course."""
    mine = courses.where(F.col("id") == course_id).select(*(F.col(c).alias(f"_{c}") for c in IDENTITY))
    met: Column = reduce(lambda a, b: a & b, (F.col(f"_{c}").eqNullSafe(F.col(f)) for c, f in IDENTITY.items()))
    known = fresh.join(mine, met, "left_semi").agg(F.count("*").alias("n_same"))
    return fresh.agg(F.count("*").alias("n_rows")).join(known, F.lit(True))  # two single rows


def refusal(courses: DataFrame, fresh: DataFrame, course_id: int) -> str | None:
    """Why the source can't be switched: it publishes nothing, or another event."""
    seen = same_event(courses, fresh, course_id).first()
    if not seen.n_rows:
        return "the source publishes no result"
    return None if seen.n_same else "the source publishes another event"


def orphans(parts: DataFrame, new_parts: DataFrame, course_id: int) -> DataFrame:
    """``athlete_id`` of people whose only participations were in the course and who have none any more."""
    here = parts.where(F.col("course_id") == course_id).select("athlete_id").where("athlete_id IS NOT NULL").distinct()
    return here.join(new_parts.select("athlete_id"), "athlete_id", "left_anti")


def switched(tables: dict[str, DataFrame], fresh: DataFrame, course_id: int, source_id: int) -> dict[str, DataFrame]:
    """``parts, athletes, sources, log`` after the switch; other tables as they are.

    The course's participations are those of ``fresh`` that say they are of this course; people who thereby have none go; the source is the only active one.
    The log gets the entry of the switch.
    """
    parts, courses, sources = tables["parts"], tables["courses"], tables["sources"]
    mine = courses.where(F.col("id") == course_id).select(*(F.col(c).alias(f"_{c}") for c in IDENTITY))
    met = reduce(lambda a, b: a & b, (F.col(f"_{c}").eqNullSafe(F.col(f)) for c, f in IDENTITY.items()))
    own = fresh.join(mine, met, "left_semi").withColumn("course_id", F.lit(course_id).cast(dict(parts.dtypes)["course_id"]))
    new = without_course(parts, course_id).unionByName(own.select(*(c for c in parts.columns if c in own.columns)), allowMissingColumns=True)
    gone = orphans(parts, new, course_id)
    old_url = sources.where((F.col("course_id") == course_id) & F.col("is_active")).agg(F.min("url").alias("previous_url"))
    new_url = sources.where(F.col("id") == source_id).agg(F.min("url").alias("new_url"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    entry = old_url.join(new_url, F.lit(True)).join(count(parts.where(F.col("course_id") == course_id), "n_deleted"), F.lit(True))
    entry = entry.join(count(own, "n_imported"), F.lit(True)).join(count(gone, "n_purged"), F.lit(True))  # single rows
    entry = entry.select(F.lit("course.source.switch").alias("action"), F.lit(course_id).cast("bigint").alias("entity_id"), "*")
    athletes = tables["athletes"].join(gone.select(F.col("athlete_id").alias("id")), "id", "left_anti")
    out = {"parts": new, "athletes": athletes, "sources": activate_source(sources, source_id), "log": entry}
    if "log" in tables:
        out["log"] = tables["log"].unionByName(entry)
    return tables | out


def deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """``courses, parts, sources, athletes, log`` without the courses ``id``: with them go their participations and sources, and the people who have no other participation.

    The log gets one entry per course that was there: its identity, its participations, and the people that were in no course but deleted ones and in this one.
    People without any participation stay, as do ids that aren't stored.
    """
    gone = tables["courses"].join(ids.select("id").distinct(), "id", "left_semi")
    of = gone.select(F.col("id").alias("course_id"))
    parts = tables["parts"]
    lost, kept = parts.join(of, "course_id", "left_semi"), parts.join(of, "course_id", "left_anti")
    purged = lost.where("athlete_id IS NOT NULL").select("course_id", "athlete_id").distinct().join(kept.select("athlete_id"), "athlete_id", "left_anti")
    n_parts, n_people = lost.groupBy("course_id").agg(F.count("*").alias("n_deleted")), purged.groupBy("course_id").agg(F.count("*").alias("n_purged"))
    entry = gone.join(n_parts, F.col("id") == n_parts["course_id"], "left").drop("course_id").join(n_people, F.col("id") == n_people["course_id"], "left")
    entry = entry.select(
        F.lit("course.delete").alias("action"), F.col("id").cast("bigint").alias("entity_id"), *IDENTITY, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_deleted", "n_purged"))
    )
    out = {
        "courses": tables["courses"].join(ids.select("id"), "id", "left_anti"),
        "parts": kept,
        "sources": tables["sources"].join(of, "course_id", "left_anti"),
        "athletes": tables["athletes"].join(purged.select(F.col("athlete_id").alias("id")), "id", "left_anti"),
        "log": tables["log"].unionByName(entry, allowMissingColumns=True) if "log" in tables else entry,
    }
    return tables | out


def merged(tables: dict[str, DataFrame], course_id: int, absorbed_id: int) -> dict[str, DataFrame]:
    """The course ``absorbed_id`` becomes part of ``course_id``: its active source moves there as a passive one, everything else of it goes.

    The other course keeps its identity, its active source and its ranking. An address that it has already isn't added again, and passive sources of the absorbed
    course go with it. People who were only there go. Merging a course with itself is an error before anything is read. If either course isn't there nothing changes.
    """
    if course_id == absorbed_id:
        raise ValueError("a course can't be merged with itself")
    courses, sources = tables["courses"], tables["sources"]
    both = courses.where(F.col("id").isin(course_id, absorbed_id)).agg(F.count_distinct("id").alias("n")).where("n = 2").select(F.lit(absorbed_id).alias("id"))
    gone = courses.where(F.col("id") == absorbed_id).select("id").join(both, "id", "left_semi")
    after = deleted({k: v for k, v in tables.items() if k != "log"}, gone)
    own = sources.where(F.col("course_id") == course_id).select("url")
    active = sources.where((F.col("course_id") == absorbed_id) & F.col("is_active") & (F.coalesce("url", F.lit("")) != ""))
    moved = active.join(gone.select(F.col("id").alias("course_id")), "course_id", "left_semi").join(own, "url", "left_anti")
    moved = moved.withColumns({"course_id": F.lit(course_id).cast(dict(sources.dtypes)["course_id"]), "is_active": F.lit(False)}).select(sources.columns)
    absorbed = after["log"].select(*(F.col(c).alias(f"absorbed_{c}") for c in IDENTITY), "n_deleted", "n_purged", F.lit(absorbed_id).cast("bigint").alias("absorbed_id"))
    entry = absorbed.join(moved.agg((F.count("*") > 0).alias("source_added"), F.min("url").alias("source_url")), F.lit(True))  # single rows
    entry = entry.select(F.lit("course.merge").alias("action"), F.lit(course_id).cast("bigint").alias("entity_id"), "*")
    log = tables["log"].unionByName(entry, allowMissingColumns=True) if "log" in tables else entry
    return after | {"sources": after["sources"].unionByName(moved), "log": log}
