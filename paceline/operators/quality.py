"""Anomalies of events, suspected duplicates, and what merging two events would do."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import status, text, times, urls
from paceline.operators.catalogue import absent_bibs, only_on_course

CODES = ("duplicate_bib", "unknown_status", "duplicate_rank", "rank_gap", "finisher_without_time", "no_participation")
#: Rules by which two events may be the same, the first one that holds counts; days that their dates may differ.
RULES = ("same_source_url", "shared_event_id", "close_names")
DAYS_APART = 3


def rank_anomalies(parts: DataFrame) -> DataFrame:
    """Repeated and missing ranks of finishers per event; teams and single starters have rankings of their own."""
    ranked = parts.where((status.status_class("status") == status.FINISHER) & (F.coalesce("rank_overall", F.lit(0)) != 0))
    of = ranked.groupBy("course_id", F.coalesce("is_relay", F.lit(False)).alias("relay")).agg(
        F.count("*").alias("n"), F.countDistinct("rank_overall").alias("distinct"), F.max("rank_overall").alias("top")
    )
    return of.groupBy("course_id").agg(
        F.sum(F.col("n") - F.col("distinct")).cast("bigint").alias("duplicate_rank"),
        F.sum(F.greatest(F.col("top") - F.col("distinct"), F.lit(0))).cast("bigint").alias("rank_gap"),
    )


def duplicate_bibs(feed: DataFrame, *by: str) -> DataFrame:
    """Rows of a feed after the first of each bib; rows without a bib aren't counted."""
    n = feed.where(F.coalesce("bib_number", F.lit("")) != "").groupBy(*by, "bib_number").agg((F.count("*") - 1).alias("again"))
    return n.groupBy(*by).agg(F.sum("again").cast("bigint").alias("duplicate_bib"))


def quality_report(courses: DataFrame, parts: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """One row per course: a count for every code, ``quality_issues`` (those above 0) and ``is_reliable_computed``.

    ``repeated`` has ``course_id, duplicate_bib``, known only while a feed is read.
    """
    kind = status.status_class("status")
    counts = parts.groupBy("course_id").agg(
        F.count("*").alias("_n"), F.count_if(kind == "unknown").alias("unknown_status"),
        F.count_if((kind == status.FINISHER) & times.has_no_time("total_time")).alias("finisher_without_time"),
    )
    out = courses.select(F.col("id").alias("course_id")).join(counts, "course_id", "left").join(rank_anomalies(parts), "course_id", "left")
    if repeated is not None:
        out = out.join(repeated, "course_id", "left")
    else:
        out = out.withColumn("duplicate_bib", F.lit(0).cast("bigint"))
    out = out.withColumn("no_participation", F.when(F.col("_n").isNull(), 1).otherwise(0).cast("bigint")).drop("_n").fillna(0, list(CODES))
    issues = F.map_filter(F.create_map(*(x for c in CODES for x in (F.lit(c), F.col(c)))), lambda _, n: n > 0)
    return out.select("course_id", *CODES, issues.alias("quality_issues"), (F.size(issues) == 0).alias("is_reliable_computed"))


def finalized(courses: DataFrame, parts: DataFrame, imported: DataFrame, now: Column, repeated: DataFrame | None = None) -> DataFrame:
    """Courses after an import of ``imported`` (``id``): those were read ``now``, and their quality is judged anew; the others stay as they are.

    Only participations of the imported courses are read. ``repeated`` as in `quality_report`. A column ``quality_issues`` is added if there was none.
    """
    ids = imported.select("id").distinct()
    own = parts.join(ids.select(F.col("id").alias("course_id")), "course_id", "left_semi")
    report = quality_report(courses.join(ids, "id", "left_semi"), own, repeated).select(
        F.col("course_id").alias("_of"), F.col("is_reliable_computed").alias("_reliable"), F.col("quality_issues").alias("_issues")
    )
    out = courses.join(report, F.col("id") == F.col("_of"), "left")
    new = F.col("_of").isNotNull()
    held = F.col("quality_issues") if "quality_issues" in courses.columns else F.lit(None).cast("map<string,bigint>")
    fresh = {"scraped_at": now, "is_reliable_computed": F.col("_reliable"), "quality_issues": F.col("_issues")}
    return out.withColumns({c: F.when(new, v).otherwise(held if c == "quality_issues" else F.col(c)) for c, v in fresh.items()}).drop("_of", "_reliable", "_issues")


def with_anomaly(reports: DataFrame, code: str) -> DataFrame:
    """Reports in which an anomaly was found."""
    return reports.where(F.coalesce(F.try_element_at("quality_issues", F.lit(code)), F.lit(0)) > 0)


def comparable_courses(courses: DataFrame, platforms: Iterable[str]) -> DataFrame:
    """What courses are compared by: address, host, heat, event id and comparable name."""
    return courses.select(
        "id", "name", "event_date", "event_type", F.coalesce("is_relay", F.lit(False)).alias("is_relay"), F.coalesce("source_url", F.lit("")).alias("url"),
        F.coalesce(urls.host_of("source_url"), F.lit("")).alias("host"), urls.heat_slug(F.coalesce("source_url", F.lit(""))).alias("heat"),
        urls.event_id("source_url", "provider", list(platforms)).alias("event"), text.comparable_name("name").alias("plain"),
    )


def duplicate_groups(courses: DataFrame, platforms: Iterable[str], days: int = DAYS_APART) -> DataFrame:
    """``id, reason, representative, n``: courses that may be one, as members of groups instead of pairs, so that a group of any size has one row a member.

    A group is the courses of one address, of one event id on more than one host (with one type and kind of starters), or of one name whose days follow each
    other at ``days`` or less. Its representative is the smallest id.
    """
    of = comparable_courses(courses, platforms)

    def grouped(rows: DataFrame, keys: list[str], reason: str, enough: Column) -> DataFrame:
        size = rows.groupBy(*keys).agg(F.min("id").alias("representative"), F.count("*").alias("n"), F.count_distinct("host").alias("hosts")).where(enough)
        key = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
        return rows.alias("r").join(size.alias("s"), key).select(F.col("r.id").alias("id"), F.lit(reason).alias("reason"), "s.representative", "s.n")

    kind = ["event_type", "is_relay"]
    dated = of.where("event_date IS NOT NULL AND plain <> ''")
    order = Window.partitionBy("plain", *kind).orderBy("event_date", "id")
    apart = F.datediff("event_date", F.lag("event_date").over(order)) > days
    runs = dated.withColumn("run", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(order))
    several = F.col("n") > 1
    found = [
        grouped(of.where("heat <> ''"), ["url"], RULES[0], several),
        grouped(of.where("event <> ''"), ["event", *kind], RULES[1], F.col("hosts") > 1),
        grouped(runs, ["plain", *kind, "run"], RULES[2], several),
    ]
    return reduce(DataFrame.unionByName, found)


def duplicate_candidates(courses: DataFrame, platforms: Iterable[str], days: int = DAYS_APART) -> DataFrame:
    """Pairs ``left_id, right_id, reason`` of courses (``id, name, event_date, event_type, is_relay, source_url, provider``).

    Left is the one that comes first in the catalogue (latest day, name, id). Each rule is an equi-join on its key with a
    guard; names must agree and their dates lie within ``days``: they are joined by name and by week, each date in its
    own week and the two beside, so that editions of a popular name don't all meet.
    """
    of = comparable_courses(courses, platforms)
    a = lambda c: F.col(f"a.{c}")
    b = lambda c: F.col(f"b.{c}")
    date = lambda c: F.coalesce(c, F.lit("0001-01-01").cast("date"))
    first = (date(a("event_date")) > date(b("event_date"))) | (
        (date(a("event_date")) == date(b("event_date"))) & ((a("name") < b("name")) | ((a("name") == b("name")) & (a("id") < b("id"))))
    )

    def pairs(left: DataFrame, right: DataFrame, keys: list[str], guard: Column, rule: int) -> DataFrame:
        same = reduce(lambda x, y: x & y, (a(k).eqNullSafe(b(k)) for k in keys))
        met = left.alias("a").join(right.alias("b"), same & guard & first)
        return met.select(a("id").alias("left_id"), b("id").alias("right_id"), F.lit(rule).alias("rule"))

    heats = of.where("heat <> ''")
    events = of.where("event <> ''")
    width = max(1, days)
    dated = of.where("event_date IS NOT NULL AND plain <> ''").withColumn("slot", F.floor(F.datediff("event_date", F.lit("1970-01-01")) / width))
    near = dated.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    found = [
        pairs(heats, heats, ["url"], F.lit(True), 0),
        pairs(events, events, ["event", "event_type", "is_relay"], a("host") != b("host"), 1),
        pairs(dated, near, ["plain", "event_type", "is_relay", "slot"], F.abs(F.datediff(a("event_date"), b("event_date"))) <= days, 2),
    ]
    best = reduce(DataFrame.unionByName, found).groupBy("left_id", "right_id").agg(F.min("rule").alias("rule"))
    names = F.array(*(F.lit(r) for r in RULES))
    return best.select("left_id", "right_id", F.get(names, F.col("rule")).alias("reason"))


def reconcilable(sources: DataFrame, incoming: DataFrame, platforms: Iterable[str]) -> DataFrame:
    """For each incoming ``url, provider`` the first course (smallest id) whose source has its event id and heat, neither empty."""
    key = lambda df: df.withColumn("_event", urls.event_id("url", "provider", list(platforms))).withColumn("_heat", urls.heat_slug("url")).where("_event <> '' AND _heat <> ''")
    known = key(sources).groupBy("_event", "_heat").agg(F.min("course_id").alias("course_id"))
    return key(incoming.select("url", "provider").distinct()).join(known, ["_event", "_heat"]).select("url", "course_id")


def merge_impact(parts: DataFrame, course_id: int, absorbed_id: int) -> DataFrame:
    """What absorbing one course into another would do, in one row: participations that go, bibs unknown to the other, athletes left without any."""
    if course_id == absorbed_id:
        raise ValueError("a course can't absorb itself")
    gone = parts.where(F.col("course_id") == absorbed_id).agg(F.count("*").alias("participations"))
    lost = absent_bibs(parts, absorbed_id, course_id).agg(F.count("*").alias("unmatched"))
    alone = only_on_course(parts, absorbed_id).agg(F.count("*").alias("orphaned"))
    return gone.crossJoin(lost).crossJoin(alone)  # three single rows


def deletion_impact(parts: DataFrame, course_id: int) -> DataFrame:
    gone = parts.where(F.col("course_id") == course_id).agg(F.count("*").alias("participations"), F.countDistinct("athlete_id").alias("athletes"))
    return gone.crossJoin(only_on_course(parts, course_id).agg(F.count("*").alias("orphaned")))  # two single rows


def changed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of which any of ``fields`` differs, with ``before`` and ``after`` as structs: what an audit log takes in."""
    old = before.select(key, F.struct(*fields).alias("before"))
    new = after.select(key, F.struct(*fields).alias("after"))
    return old.join(new, key).where(~F.col("before").eqNullSafe(F.col("after")))


def untimed_events(parts: DataFrame, share: float = 0.05) -> DataFrame:
    """Events in which at most one row, or ``share`` of them, has a time."""
    timed = F.count_if(F.coalesce("total_time", F.lit("")) != "")
    return parts.groupBy("course_id").agg(F.count("*").alias("n"), timed.alias("timed")).where(
        F.col("timed") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
    )


def feed_profile(feed: DataFrame, by: str) -> DataFrame:
    """Numbers of rows with a name, a time, any split and any rank, per source, and the types met."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    rank = F.coalesce("rank_overall", "rank_category", "rank_gender").isNotNull()
    return feed.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(some("athlete_name")).alias("named"), F.count_if(some("total_time")).alias("timed"),
        F.count_if(F.size("splits") > 0).alias("with_splits"), F.count_if(rank).alias("ranked"), F.array_sort(F.collect_set("event_type")).alias("types"),
    )
