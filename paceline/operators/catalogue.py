"""Listings: filters, joins to dimensions, event catalogue, orders, pages.

Tables have these columns (others are carried or ignored):
participations ``id, athlete_id, course_id, club, category, bib_number, rank_overall, rank_category, rank_gender,
total_time, status, is_relay, is_pending, is_rejected, created_at``;
athletes ``id, last_name, first_name, gender, club``;
courses ``id, name, event_date, event_type, is_relay, is_reliable_computed, reliability_override, scraped_at``;
sources ``id, course_id, url, provider, is_active, created_at``.
Joins are plain equi-joins: whether a dimension is small enough to broadcast is Spark's decision, from its size.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import dates, disciplines, status, text, times

EVENT = ["course_id", "course_name", "course_date", "course_type", "course_relay", "course_km"]


@dataclass(frozen=True)
class Filters:
    """Every part is optional. ``labels`` are a club's labels in comparable form; ``seasons`` their first years."""

    name: str | None = None
    event_type: str | None = None
    event_name: str | None = None
    labels: Sequence[str] = ()
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    course_id: int | None = None
    seasons: Sequence[int] = ()
    federal_only: bool = False
    include_pending: bool = False


def athlete_columns(athletes: DataFrame) -> DataFrame:
    return athletes.select(
        F.col("id").alias("athlete_id"), F.col("last_name").alias("athlete_last"), F.col("first_name").alias("athlete_first"),
        F.col("gender").alias("athlete_gender"), F.col("club").alias("athlete_club"),
    )


def course_columns(courses: DataFrame) -> DataFrame:
    km = F.col("distance_km") if "distance_km" in courses.columns else F.lit(None).cast("double")
    return courses.select(
        F.col("id").alias("course_id"), F.col("name").alias("course_name"), F.col("event_date").alias("course_date"),
        F.col("event_type").alias("course_type"), F.col("is_relay").alias("course_relay"), km.alias("course_km"),
    )


def validated() -> Column:
    """Pending rows are left out; a null flag counts as pending."""
    return F.col("is_pending").eqNullSafe(F.lit(False))


def joined(parts: DataFrame, athletes: DataFrame, courses: DataFrame) -> DataFrame:
    return parts.join(course_columns(courses), "course_id").join(athlete_columns(athletes), "athlete_id")


def filtered(parts: DataFrame, athletes: DataFrame, courses: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Participations with their athlete and course that meet ``f``; Catalyst moves each part below the joins."""
    out = joined(parts, athletes, courses)
    if not f.include_pending:
        out = out.where(validated())
    if f.name is not None:
        out = out.where(text.name_matches(f.name, "athlete_last", "athlete_first"))
    if f.event_type:
        out = out.where(F.col("course_type") == f.event_type)
    if f.event_name:
        out = out.where(text.fuzzy_matches("course_name", f.event_name))
    if f.labels:
        out = out.where(text.has_label("club", f.labels))
    if f.date_from:
        out = out.where(F.col("course_date") >= F.lit(f.date_from))
    if f.date_to:
        out = out.where(F.col("course_date") <= F.lit(f.date_to))
    if f.course_id is not None:
        out = out.where(F.col("course_id") == f.course_id)
    if f.seasons:
        out = out.where(dates.in_seasons("course_date", f.seasons))
    if f.federal_only:
        out = out.where(disciplines.is_federal("course_type"))
    return out


def event_catalogue(rows: DataFrame, labels: Iterable[str]) -> DataFrame:
    """One row per event of filtered rows: ``total`` participations and how many are the club's."""
    club = text.has_label("club", labels)
    return rows.groupBy(*EVENT).agg(F.count("*").alias("total"), F.count_if(club).alias("club_count"))


def event_totals(rows: DataFrame) -> DataFrame:
    """Events and participations of the same filtered rows, always one row."""
    return rows.agg(F.countDistinct("course_id").alias("events"), F.count("*").alias("participations"))


def event_order(sort: str, term: str | None = None) -> list[Column]:
    """Sort keys of a catalogue; an unknown name is ``date_desc``. With a search term the most similar names come first in ``date_desc``."""
    orders = {
        "date_asc": [F.asc_nulls_last("course_date"), F.asc("course_name")],
        "name": [F.asc("course_name"), F.desc_nulls_last("course_date")],
        "imported_desc": [F.desc_nulls_last("course_scraped_at"), F.asc("course_name")],
        "date_desc": [F.desc_nulls_last("course_date"), F.asc("course_name")],
    }
    keys = orders.get(sort, orders["date_desc"])
    if term and sort not in ("date_asc", "name", "imported_desc"):
        keys = [F.desc(text.similarity("course_name", F.lit(term))), *keys]
    return [*keys, F.asc("course_id")]


def page_size_of(value: str | int | None, most: int = 200) -> int | None:
    """1 to ``most``, or ``all`` (None); anything else raises."""
    if value is None or str(value).lower() == "all":
        return None
    size = int(value)
    if not 1 <= size <= most:
        raise ValueError(f"page size must be 1 to {most}, or all")
    return size


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int | None = 20) -> DataFrame:
    """Page ``number`` (from 1) in ``order``, whose last key should be unique. ``size`` None gives all rows."""
    if number < 1:
        raise ValueError("pages count from 1")
    df = df.orderBy(*order)
    return df if size is None else df.offset((number - 1) * size).limit(size)


def courses_with_club(courses: DataFrame, parts: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Courses that a member of the club took part in, pending rows included."""
    members = parts.where(text.has_label("club", labels)).select("course_id")
    return courses.join(members, courses["id"] == members["course_id"], "left_semi")


def reliable() -> Column:
    """What a person decided, else what was computed; null if neither."""
    return F.coalesce("reliability_override", "is_reliable_computed")


def unreliable_only(courses: DataFrame) -> DataFrame:
    return courses.where(reliable().eqNullSafe(F.lit(False)))


def course_listing(
    courses: DataFrame, parts: DataFrame, name: str | None = None, event_type: str | None = None, labels: Iterable[str] | None = None,
    date_from: dt.date | None = None, date_to: dt.date | None = None, unreliable: bool = False,
) -> DataFrame:
    out = courses
    if name:
        out = out.where(text.contains_text("name", name))
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if date_from:
        out = out.where(F.col("event_date") >= F.lit(date_from))
    if date_to:
        out = out.where(F.col("event_date") <= F.lit(date_to))
    if unreliable:
        out = unreliable_only(out)
    return courses_with_club(out, parts, labels) if labels is not None else out


def course_order() -> list[Column]:
    return [F.desc_nulls_last("event_date"), F.asc("name"), F.asc("id")]


def with_active_source(courses: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_url`` and ``provider`` of each course's active source, empty strings without one."""
    active = sources.where("is_active").select("course_id", F.col("url").alias("_url"), F.col("provider").alias("_provider"))
    out = courses.drop("source_url", "provider").join(active, courses["id"] == active["course_id"], "left").drop("course_id")
    return out.withColumn("source_url", F.coalesce("_url", F.lit(""))).withColumn("provider", F.coalesce("_provider", F.lit(""))).drop("_url", "_provider")


def with_sources(courses: DataFrame, sources: DataFrame) -> DataFrame:
    """All sources of a course as an array: the active one first, then by age and id."""
    of = sources.groupBy("course_id").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("is_active")).alias("passive"), "created_at", "id", "url", "provider"))).alias("sources")
    )
    return courses.join(of, courses["id"] == of["course_id"], "left").drop("course_id")


def identities_with_counts(courses: DataFrame, sources: DataFrame, parts: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Every course with its active source and its numbers of participations, all and the club's."""
    n = parts.groupBy("course_id").agg(F.count("*").alias("total"), F.count_if(text.has_label("club", labels)).alias("club_count"))
    out = with_active_source(courses, sources).join(n.withColumnRenamed("course_id", "_of"), F.col("id") == F.col("_of"), "left").drop("_of")
    return out.fillna(0, ["total", "club_count"])


def left_counts(dimension: DataFrame, facts: DataFrame, key: str, alias: str = "n") -> DataFrame:
    """Every row of ``dimension`` and how many ``facts`` have its ``id`` in ``key``; 0 for none."""
    n = facts.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(alias))
    return dimension.join(n, F.col("id") == F.col("_key"), "left").drop("_key").fillna(0, [alias])


def absent_bibs(parts: DataFrame, course_id: int, other_id: int) -> DataFrame:
    """Participations of a course whose bib the other course doesn't have; those without a bib are among them."""
    bib = F.nullif(F.col("bib_number"), F.lit(""))
    other = parts.where(F.col("course_id") == other_id).select(bib.alias("_bib")).where("_bib IS NOT NULL")
    return parts.where(F.col("course_id") == course_id).join(other, bib == other["_bib"], "left_anti")


def orphans(athletes: DataFrame, parts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Athletes without a participation; ``among`` (ids) narrows who is looked at, None is everyone and an empty table is no one."""
    of = athletes if among is None else athletes.join(among.select("id"), "id", "left_semi")
    return of.join(parts, of["id"] == parts["athlete_id"], "left_anti")


def only_on_course(parts: DataFrame, course_id: int) -> DataFrame:
    """Athletes all of whose participations are on one course."""
    own = parts.groupBy("athlete_id").agg(F.bool_and(F.col("course_id") == course_id).alias("only"))
    return own.where("only").select("athlete_id")


def with_group_sizes(parts: DataFrame) -> DataFrame:
    """Participations with ``finishers``, the ranked finishers of their course, teams and single apart; null where there are none."""
    sizes = finishers_by_group(parts).withColumnsRenamed({"course_id": "_course", "is_relay": "_relay"})
    return parts.join(sizes, (F.col("course_id") == F.col("_course")) & F.col("is_relay").eqNullSafe(F.col("_relay")), "left").drop("_course", "_relay")


def finishers_by_group(parts: DataFrame) -> DataFrame:
    ranked = (F.lower("status") == status.FINISHER) & F.col("rank_overall").isNotNull() & validated()
    return parts.where(ranked).groupBy("course_id", "is_relay").agg(F.count("*").alias("finishers"))


def absent_time() -> Column:
    return F.coalesce("total_time", F.lit("")).isin("", "00:00:00")


def leaderboard_order() -> list[Column]:
    """Status group, unranked last, rank, then those without a time, time, last and first name, id."""
    return [
        status.display_group("status").asc(), F.col("rank_overall").isNull().asc(), F.asc_nulls_last("rank_overall"), absent_time().asc(),
        F.coalesce("total_time", F.lit("")).asc(), F.lower("athlete_last").asc_nulls_last(), F.lower("athlete_first").asc_nulls_last(), F.col("id").asc(),
    ]


def leaderboard(rows: DataFrame, term: str | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """The rows of one or more events that match; ``page`` with ``leaderboard_order`` gives a page."""
    if term is not None:
        rows = rows.where(text.name_matches(term, "athlete_last", "athlete_first"))
    return rows.where(text.has_label("club", labels)) if labels is not None else rows


def pending(parts: DataFrame, rejected: bool = False) -> DataFrame:
    flag = F.coalesce("is_rejected", F.lit(False))
    return parts.where(F.col("is_pending") & (flag if rejected else ~flag))


def stale_courses(courses: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    """Courses last read more than ``days`` days before ``now``; never-read ones aren't among them."""
    return courses.where(F.col("scraped_at") < F.lit(now - dt.timedelta(days=days)))


def athlete_identity(last: Column | str, first: Column | str, born: Column | str) -> Column:
    """Key of a person: names whatever their case and blanks around, day of birth; null dates are equal."""
    fold = lambda c: F.lower(F.trim(F.coalesce(text.of(c), F.lit(""))))
    return F.struct(fold(last).alias("last"), fold(first).alias("first"), F.coalesce(text.of(born).cast("string"), F.lit("")).alias("born"))


def seconds() -> Column:
    return times.to_seconds("total_time", strict=True)
