"""Imports as snapshots: a feed and what is stored become the new state, nothing is changed in place.

``stored`` are participations (``id, course_id, athlete_id, bib_number, status, total_time`` and value columns), ``feed`` rows
resolved to ``course_id`` and ``athlete_id``, with ``seq``, their place in the feed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import status
from paceline.functions.text import of
from paceline.operators.catalogue import athlete_identity

#: Never written by a merge.
KEYS = ("id", "course_id", "athlete_id", "bib_number", "status", "created_at")


def is_empty(c: Column | str, kind: str) -> Column:
    """Null and, for text, the empty string; False and 0 are values."""
    return of(c).isNull() | (of(c) == "") if kind == "string" else of(c).isNull()


def merged_value(old: Column | str, new: Column | str, kind: str = "string") -> Column:
    """The new value unless it is empty."""
    return F.when(is_empty(new, kind), of(old)).otherwise(of(new))


def merged_status(old_time: Column | str, new_status: Column | str, new_time: Column | str) -> Column:
    """A status given holds; else it follows from the merged time."""
    return status.status_or_default(new_status, merged_value(old_time, new_time))


def matched(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """Every row of the feed with ``stored_id`` (or null) and ``action``: update, insert, skip or repeat.

    With a bib the first row of a bib is matched to the stored row with that bib; further ones are repeats. Without a
    bib it is the athlete: if the course has exactly one row of the athlete without a bib, the feed's first one
    updates it; if it has more, as many of the feed's rows are skipped; what is left over is inserted.
    """
    bib = F.nullif(F.coalesce("bib_number", F.lit("")), F.lit(""))
    rows = feed.withColumn("_bib", bib)
    with_bib, without = rows.where("_bib IS NOT NULL"), rows.where("_bib IS NULL")
    first = F.row_number().over(Window.partitionBy("course_id", "_bib").orderBy("seq"))
    known = stored.withColumn("_bib", bib).where("_bib IS NOT NULL").select("course_id", "_bib", F.col("id").alias("stored_id"))
    by_bib = with_bib.withColumn("_n", first).join(known, ["course_id", "_bib"], "left")
    by_bib = by_bib.withColumn("action", F.when(F.col("_n") > 1, "repeat").when(F.col("stored_id").isNotNull(), "update").otherwise("insert"))
    by_bib = by_bib.withColumn("stored_id", F.when(F.col("action") == "update", F.col("stored_id")))

    unnumbered = stored.withColumn("_bib", bib).where("_bib IS NULL").groupBy("course_id", "athlete_id").agg(F.count("*").alias("_there"), F.min("id").alias("stored_id"))
    nth = F.row_number().over(Window.partitionBy("course_id", "athlete_id").orderBy("seq"))
    by_athlete = without.withColumn("_n", nth).join(unnumbered, ["course_id", "athlete_id"], "left").withColumn("_there", F.coalesce("_there", F.lit(0)))
    action = F.when((F.col("_there") == 1) & (F.col("_n") == 1), "update").when(F.col("_n") <= F.col("_there"), "skip").otherwise("insert")
    by_athlete = by_athlete.withColumn("action", action).withColumn("stored_id", F.when(F.col("action") == "update", F.col("stored_id")))
    columns = [*feed.columns, "stored_id", "action"]
    return by_bib.select(columns).unionByName(by_athlete.select(columns))


def upsert(stored: DataFrame, feed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The new snapshot: stored rows merged with what was matched to them, then inserted rows, with ``action``.

    ``fields`` are the value columns. ``action`` is ``update`` where a value or the status changed, ``keep`` for
    other stored rows, ``insert`` for new ones (their ``id`` is null, for the sink to give).
    """
    plan = matched(stored, feed)
    kinds = dict(stored.dtypes)
    new = plan.where("action = 'update'").select(F.col("stored_id").alias("id"), *(F.col(f).alias(f"_new_{f}") for f in fields), F.col("status").alias("_new_status"), F.lit(True).alias("_met"))
    both = stored.join(new, "id", "left")
    values = {f: F.when(F.col("_met"), merged_value(f, f"_new_{f}", kinds[f])).otherwise(F.col(f)) for f in fields}
    state = F.when(F.col("_met"), merged_status("total_time", "_new_status", "_new_total_time")).otherwise(F.col("status"))
    differs = ~F.struct(*(values[f].alias(f) for f in fields), state.alias("status")).eqNullSafe(F.struct(*fields, "status"))
    both = both.withColumns({f"_out_{f}": values[f] for f in fields} | {"_out_status": state, "action": F.when(differs, "update").otherwise("keep")})
    keys = ["id", "course_id", "athlete_id", "bib_number"]
    kept = both.select(*keys, *(F.col(f"_out_{f}").alias(f) for f in fields), F.col("_out_status").alias("status"), "action")
    added = plan.where("action = 'insert'").select(
        F.lit(None).cast(kinds["id"]).alias("id"), *keys[1:], *fields, status.status_or_default("status", "total_time").alias("status"), "action"
    )
    return kept.unionByName(added)


def import_counts(plan: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``imported``, ``updated`` and ``skipped`` rows of one import; matched rows without a change are skipped ones."""
    seen = plan.agg(F.count("*").alias("seen"))
    done = snapshot.agg(F.count_if(F.col("action") == "insert").alias("imported"), F.count_if(F.col("action") == "update").alias("updated"))
    return done.crossJoin(seen).select("imported", "updated", (F.col("seen") - F.col("imported") - F.col("updated")).alias("skipped"))  # two single rows


def reassignable(old_first: Column | str, new_first: Column | str) -> Column:
    """A matched row may go to another athlete, unless that would blank a first name."""
    blank = lambda c: F.trim(F.coalesce(of(c), F.lit(""))) == ""
    return ~(blank(new_first) & ~blank(old_first))


def resolve_athletes(feed: DataFrame, athletes: DataFrame) -> DataFrame:
    """Feed rows with ``athlete_id``, null for people not known yet: names in any case and the day of birth must agree."""
    known = athletes.select(athlete_identity("last_name", "first_name", "birth_date").alias("_who"), "id").groupBy("_who").agg(F.min("id").alias("athlete_id"))
    return feed.withColumn("_who", athlete_identity("last_name", "first_name", "birth_date")).join(known, "_who", "left").drop("_who")


def club_updates(athletes: DataFrame, feed: DataFrame) -> DataFrame:
    """Athletes with the club of their last feed row, unless it is empty or the athlete's club is locked."""
    last = feed.where(F.coalesce("club", F.lit("")) != "").groupBy("athlete_id").agg(F.max_by("club", "seq").alias("_club"))
    out = athletes.join(last.withColumnRenamed("athlete_id", "_of"), F.col("id") == F.col("_of"), "left").drop("_of")
    free = ~F.coalesce("club_locked", F.lit(False)) & F.col("_club").isNotNull()
    return out.withColumn("club", F.when(free, F.col("_club")).otherwise(F.col("club"))).drop("_club")


def new_courses(feed: DataFrame, courses: DataFrame) -> DataFrame:
    """Identities ``name, event_date, event_type, is_relay`` of the feed that no course has; null dates are equal."""
    key = ["name", "event_date", "event_type", "is_relay"]
    want = feed.select(*key).distinct().alias("w")
    have = courses.select(*key).alias("h")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}"))
    return want.join(have, same, "left_anti")


def reclassify(feed: DataFrame, courses: DataFrame, sources: DataFrame) -> DataFrame:
    """``course_id, event_type`` of courses whose type a scrape corrects.

    The scrape has exactly one type for an address, name, day and kind of starters, no course has that identity yet,
    and the course holds the address as its active source.
    """
    key = ["name", "event_date", "is_relay"]
    one = feed.groupBy("url", *key).agg(F.min("event_type").alias("event_type"), F.countDistinct("event_type").alias("_types")).where("_types = 1").drop("_types")
    free = new_courses(one, courses)
    same_new = [one[k].eqNullSafe(free[k]) for k in (*key, "event_type")]
    want = one
    join = same_new[0]
    for c in same_new[1:]:
        join = join & c
    want = one.join(free, join, "left_semi").alias("w")
    held = sources.where("is_active").select("course_id", F.col("url").alias("_url"))
    of = courses.join(held, courses["id"] == held["course_id"]).alias("c")
    met = (F.col("w.url") == F.col("c._url")) & (F.col("w.name") == F.col("c.name"))
    met = met & F.col("w.event_date").eqNullSafe(F.col("c.event_date")) & F.col("w.is_relay").eqNullSafe(F.col("c.is_relay"))
    return want.join(of, met & (F.col("w.event_type") != F.col("c.event_type"))).select(F.col("c.course_id"), F.col("w.event_type"))


def richness(fields: Iterable[Column | str], *arrays: Column | str) -> Column:
    """Number of fields that are filled, plus the sizes of ``arrays``."""
    filled = sum((F.coalesce(of(f), F.lit("")) != "").cast("int") for f in fields)
    return sum((F.coalesce(F.size(of(a)), F.lit(0)) for a in arrays), start=filled)


def fuse(feed: DataFrame, by: Sequence[str], fields: Sequence[str], rich: Column) -> DataFrame:
    """One row per key of a feed that lists people several times: a fold over the rows in ``seq`` order.

    A row takes the place of the one held if it is a non-finisher and the one held has no time; not if the one held
    is a non-finisher and the row has no time; else if it has a time and the other hasn't; else if it is richer.
    The rule depends on the order, so it is a fold over a key's few rows and not a maximum.
    """
    row = F.struct(F.col("seq").alias("seq"), rich.cast("int").alias("rich"), F.coalesce("status", F.lit("")).alias("_s"), F.coalesce("total_time", F.lit("")).alias("_t"), F.struct(*fields).alias("row"))
    of_key = feed.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def takes(new: Column, old: Column) -> Column:
        out = lambda x: x["_s"].isin(*status.NON_FINISHERS)
        timed = lambda x: x["_t"] != ""
        return (
            F.when(out(new) & ~timed(old), F.lit(True)).when(out(old) & ~timed(new), F.lit(False)).when(timed(new) != timed(old), timed(new)).otherwise(new["rich"] > old["rich"])
        )

    held = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.get("rows", F.lit(0)), lambda old, new: F.when(takes(new, old), new).otherwise(old))
    return of_key.select(*by, held["row"].alias("row"), F.size("rows").alias("listed")).select(*by, "row.*", "listed")


def fill_gaps(published: DataFrame, hidden: DataFrame, by: str, key: str, fields: Sequence[str]) -> DataFrame:
    """Published rows with empty ``fields`` filled from hidden ones with the same ``key`` (a bib).

    Only where a single published row (over all values of ``by``) has the key and the hidden list has it once, so that no row is filled from another's.
    """
    alone = published.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    unique = hidden.withColumn("_m", F.count("*").over(Window.partitionBy(key))).where("_m = 1")
    unique = unique.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_h_{f}") for f in fields))
    out = alone.join(unique, (F.col(key) == F.col("_key")) & (F.col("_n") == 1), "left")
    return out.withColumns({f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_h_{f}"), F.col(f)) for f in fields}).select(published.columns)


def attach_source(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Sources with those of ``new`` (``course_id, url, provider, created_at``) that a course doesn't have; one becomes active where none is."""
    fresh = new.dropDuplicates(["course_id", "url"]).join(sources, ["course_id", "url"], "left_anti")
    both = sources.unionByName(fresh.withColumn("is_active", F.lit(False)), allowMissingColumns=True)
    of = Window.partitionBy("course_id")
    has = F.coalesce(F.bool_or("is_active").over(of), F.lit(False))
    first = F.row_number().over(of.orderBy("created_at", "url")) == 1
    return both.withColumn("_has", has).withColumn("_first", first).withColumn("is_active", F.col("is_active") | (~F.col("_has") & F.col("_first"))).drop("_has", "_first")


def activate_source(sources: DataFrame, source_id: int) -> DataFrame:
    """The source becomes its course's only active one; other courses stay as they are."""
    own = F.max(F.col("id") == source_id).over(Window.partitionBy("course_id"))
    return sources.withColumn("_own", own).withColumn("is_active", F.when(F.col("_own"), F.col("id") == source_id).otherwise(F.col("is_active"))).drop("_own")


def moved_sources(sources: DataFrame, absorbed_id: int, course_id: int) -> DataFrame:
    """Sources of a course that is absorbed go to the other one, passive; addresses that it has already go."""
    own = sources.where(F.col("course_id") == course_id).select(F.col("url").alias("_url"))
    stay = sources.where(F.col("course_id") != absorbed_id)
    moved = sources.where(F.col("course_id") == absorbed_id).join(own, F.col("url") == F.col("_url"), "left_anti")
    return stay.unionByName(moved.withColumns({"course_id": F.lit(course_id).cast(dict(sources.dtypes)["course_id"]), "is_active": F.lit(False)}))


def without_course(parts: DataFrame, course_id: int) -> DataFrame:
    return parts.where(~F.col("course_id").eqNullSafe(F.lit(course_id)))


def reviewed(parts: DataFrame, ids: Sequence[int], decision: str) -> DataFrame:
    """Pending rows after a decision: ``validate``, ``reject`` or ``unreject``; deciding twice changes nothing."""
    if decision not in ("validate", "reject", "unreject"):
        raise ValueError(f"unknown decision: {decision}")
    mine = F.col("id").isin(*ids)
    if decision == "validate":
        return parts.withColumns({c: F.when(mine, F.lit(False)).otherwise(F.col(c)) for c in ("is_pending", "is_rejected")})
    return parts.withColumn("is_rejected", F.when(mine & F.col("is_pending"), F.lit(decision == "reject")).otherwise(F.col("is_rejected")))
