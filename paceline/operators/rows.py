"""From what a timing service publishes to rows: names, statuses, legs, checkpoints, lists, and writes to what is stored."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.status import DNF, DNS, DSQ, FINISHER
from paceline.functions.text import of, split_name
from paceline.functions.times import clock_seconds, has_no_time, to_seconds

ANONYMOUS = "Anonyme"
#: Marks in the place of a time.
NO_MARK = ("", "—", "--")


def text(c: Column | str) -> Column:
    return F.trim(F.coalesce(of(c), F.lit("")))


def published_status(dsq: Column | str, dnf: Column | str, time: Column | str) -> Column:
    """Disqualified or stopped if so flagged, else finisher with a time other than zero, else not started."""
    on = lambda c: F.upper(text(c)) == "O"
    timed = ~text(time).isin("", "00:00:00")
    return F.when(on(dsq), F.lit(DSQ)).when(on(dnf), F.lit(DNF)).when(timed, F.lit(FINISHER)).otherwise(F.lit(DNS))


def is_unknown_time(c: Column | str) -> Column:
    """A text that gives no time though it is neither one of the spellings of no time nor a gap (``+5:16``)."""
    return ~has_no_time(c) & ~text(c).isin(*NO_MARK) & ~text(c).startswith("+") & clock_seconds(text(c)).isNull()


def name_cell(c: Column | str) -> Column:
    """``struct(last, first, gender, category)`` of a cell such as ``LEVARC NoamH-S3H``: the code at the end is cut off, then the name is split."""
    cell = text(c)
    code = r"([HF])-([A-Z0-9]+)$"
    name = split_name(F.regexp_replace(cell, code, ""))
    return F.struct(name["last"].alias("last"), name["first"].alias("first"), F.regexp_extract(cell, code, 1).alias("gender"), F.regexp_extract(cell, code, 2).alias("category"))


def identity(name: Column | str, hidden: Column | str, bib: Column | str, race: Column | str, relay: Column | str) -> Column:
    """``struct(last, first)``: a hidden runner with a bib is named by race and bib, a team's name stays whole, others are split."""
    number = text(of(bib).cast("string"))
    whole = F.coalesce(of(relay), F.lit(False)) | text(name).contains("/")
    named = lambda last: F.struct(last.alias("last"), F.lit("").alias("first"))
    synthetic = F.concat(F.lit(f"{ANONYMOUS} "), of(race).cast("string"), F.lit("-"), number)
    return F.when(F.coalesce(of(hidden), F.lit(False)) & (number != ""), named(synthetic)).when(whole, named(text(name))).otherwise(split_name(name))


def course_name(event: Column | str, heat: Column | str) -> Column:
    """``<event> - <heat>`` with runs of white space as one space; an empty part is left out."""
    part = lambda c: F.nullif(F.trim(F.regexp_replace(text(c), r"\s+", " ")), F.lit(""))
    return F.concat_ws(" - ", part(event), part(heat))


def with_checkpoints(rows: DataFrame, points: DataFrame, by: list[str], slots: Iterable[str]) -> DataFrame:
    """``rows`` with a column ``<slot>_time`` for each slot of ``points`` (``by``, slot, seq, time); the last time of a slot that isn't empty counts."""
    kept = points.where(F.coalesce("time", F.lit("")) != "")
    wide = kept.groupBy(*by).pivot("slot", list(slots)).agg(F.max_by("time", "seq"))
    return rows.join(wide.withColumnsRenamed({s: f"{s}_time" for s in slots}), by, "left")


def resolved_roles(fields: DataFrame, by: list[str]) -> DataFrame:
    """``fields`` (``by``, role, field, cumulative) by role: the field if it is the only candidate, else null and ``ambiguous``."""
    own = fields.where(F.col("role").isNotNull() & ~F.coalesce("cumulative", F.lit(False)))
    counted = own.groupBy(*by, "role").agg(F.count("*").alias("n"), F.min("field").alias("only"))
    return counted.select(*by, "role", F.when(F.col("n") == 1, F.col("only")).alias("field"), (F.col("n") > 1).alias("ambiguous"))


def planned_splits(values: DataFrame, fields: DataFrame, by: list[str], row: str = "id") -> DataFrame:
    """``by``, ``row``, ``splits`` of times ``by, row, field, time``, as the race's ``fields`` (``by``, field, label, role, cumulative) let them be read.

    If every role of a race has one field, splits are the roles; if any has more, none can be told, and all fields of the race, cumulative ones too, are splits under
    their own labels. Splits stand in the order of the fields' numbers; empty and zero times give none.
    """
    roles = resolved_roles(fields, by)
    races = roles.groupBy(*by).agg(F.bool_or("ambiguous").alias("_unclear"))
    number = F.coalesce(F.regexp_extract("field", r"\d+", 0).try_cast("int"), F.lit(0))
    named = fields.select(*by, "field", "label").withColumn("_at", number).join(races, by, "left")
    named = named.join(roles.where("NOT ambiguous").select(*by, "field", F.col("role").alias("_role")), [*by, "field"], "left")
    named = named.withColumn("_label", F.when(F.col("_unclear"), F.col("label")).otherwise(F.col("_role"))).where("_label IS NOT NULL")
    timed = values.where(~text("time").isin("", "00:00:00")).join(named.select(*by, "field", "_at", "_label"), [*by, "field"])
    of = timed.groupBy(*by, row).agg(F.array_sort(F.collect_list(F.struct("_at", "field", F.col("_label").alias("label"), "time"))).alias("s"))
    return of.select(*by, row, F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["time"].alias("time"))).alias("splits"))


def list_specs(lists: DataFrame, hidden: bool = False) -> DataFrame:
    """``name, contest`` of published (or of hidden) lists, each once and in the order of their first places ``seq``."""
    is_hidden = F.coalesce(F.col("mode") == "hidden", F.lit(False))
    contest = F.coalesce(F.nullif(F.col("contest").cast("string"), F.lit("")), F.lit("0"))
    return lists.where(is_hidden == F.lit(hidden)).groupBy("name", contest.alias("contest")).agg(F.min("seq").alias("seq"))


def without_orphans(rows: DataFrame, by: str, leg: str = "leg") -> DataFrame:
    """Rows without a leg go where the event has any other leg."""
    named = rows.where(F.coalesce(leg, F.lit("")) != "").select(by).distinct().withColumn("_named", F.lit(True))
    marked = rows.join(named, by, "left")
    return marked.where((F.coalesce(leg, F.lit("")) != "") | F.col("_named").isNull()).drop("_named")


def groups_are_contests(labels: DataFrame, contests: DataFrame, by: str) -> DataFrame:
    """``reliable`` for each event: every label of its groups is the label of one of its contests, whatever the case."""
    clean = lambda d: d.select(by, F.lower(text("label")).alias("label")).distinct()
    known = clean(contests).withColumn("known", F.lit(True))
    return clean(labels).join(known, [by, "label"], "left").groupBy(by).agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("reliable"))


def entrant_ranks(rows: DataFrame) -> DataFrame:
    """Ranks of timed entrants within their leg: over all, of their gender, of gender and category; ties by bib."""
    timed = rows.withColumn("seconds", to_seconds("time")).where("seconds > 0")
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("seconds", "bib"))
    return timed.withColumns({"rank_overall": place("source", "leg"), "rank_gender": place("source", "leg", "gender"), "rank_category": place("source", "leg", "gender", "category")})


def merged_courses(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """Courses read anew, then cached ones that aren't among them, latest first; ``seq`` is the place, and an id is there once."""
    new = fresh.groupBy("id").agg(F.min("seq").alias("a")).select("id", F.lit(0).alias("part"), "a")
    old = cached.groupBy("id").agg(F.max("scraped_at").alias("at")).join(new, "id", "left_anti")
    old = old.select("id", F.lit(1).alias("part"), (-F.unix_date("at")).cast("bigint").alias("a"))
    return new.unionByName(old)


def segment_order(segment: Column | str, previous: Iterable[Column | str], descending: bool = False) -> list[Column]:
    """Order by a segment's time: rows without one last both ways, ties in the order before."""
    first = of(segment).desc_nulls_last() if descending else of(segment).asc_nulls_last()
    return [first, *map(of, previous)]


def segment_seconds(segment: str, total: Column | str = "total_time", splits: Column | str = "splits") -> Column:
    """Seconds of a segment, or of the whole for ``total``; null without a time, never zero."""
    if segment == "total":
        return to_seconds(total, strict=True)
    found = F.get(F.filter(of(splits), lambda s: s["label"] == segment), F.lit(0))
    return to_seconds(found["time"], strict=True)


def known_emails(asked: DataFrame, users: DataFrame) -> DataFrame:
    """Addresses asked for that have an account, in lower case."""
    low = lambda d: d.select(F.lower("email").alias("email")).distinct()
    return low(asked).join(low(users), "email", "left_semi")


def require_names(rows: DataFrame, name: str = "event_name") -> DataFrame:
    """``rows``; reading them fails if any has no name."""
    named = F.coalesce(F.trim(name), F.lit("")) != ""
    return rows.where(F.when(named, F.lit(True)).otherwise(F.raise_error(F.lit("an event without a name")).cast("boolean")))


def enriched(rows: DataFrame, wanted: Column, details: DataFrame, key: str, fields: Iterable[str]) -> DataFrame:
    """``rows`` with ``fields`` of ``details`` for those that are ``wanted``; details of other rows aren't read into the join."""
    asked = rows.where(wanted).select(key).distinct()
    found = details.join(asked, key, "left_semi").select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    out = rows.join(found, key, "left")
    return out.withColumns({f: F.coalesce(F.when(wanted, F.col(f"_{f}")), F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))


def swapped(stored: DataFrame, claims: DataFrame, key: str, field: str) -> DataFrame:
    """``stored`` with ``field`` set by the first claim (``seq``) of a key whose ``expected`` is the value held; ``won`` is that claim's ``seq``."""
    expected = stored.select(key, F.col(field).alias("_held")).join(claims, key).where(F.col("expected").eqNullSafe(F.col("_held")))
    first = expected.groupBy(key).agg(F.min(F.struct("seq", F.col("value").alias("value"))).alias("c")).select(key, F.col("c.seq").alias("won"), F.col("c.value").alias("_new"))
    return stored.join(first, key, "left").withColumn(field, F.when(F.col("won").isNotNull(), F.col("_new")).otherwise(F.col(field))).drop("_new")


def touched(courses: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Courses with the time of the last reading set to ``now`` for those in ``ids``."""
    mark = ids.select("id").distinct().withColumn("_touched", F.lit(True))
    return courses.join(mark, "id", "left").withColumn("scraped_at", F.when(F.col("_touched"), now).otherwise(F.col("scraped_at"))).drop("_touched")


def deletion(courses: DataFrame, parts: DataFrame, ids: DataFrame) -> DataFrame:
    """Audit rows of deleted courses: ``entity_id``, name and how many participations go with them. Ids that aren't stored give none."""
    gone = courses.join(ids.select("id").distinct(), "id", "left_semi").select("id", "name")
    counts = parts.groupBy(F.col("course_id").alias("id")).agg(F.count("*").alias("n"))
    return gone.join(counts, "id", "left").select(F.lit("delete_course").alias("action"), F.col("id").alias("entity_id"), "name", F.coalesce("n", F.lit(0)).alias("n_parts"))


def audited(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with ``entries`` behind it; their ids are above the highest there is, with gaps."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_last"))
    new = entries.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + 1 + F.monotonically_increasing_id()).drop("_last")
    return log.unionByName(new, allowMissingColumns=True)
