"""Aggregates: dashboard, seasons, event summary, rosters. Counts over an empty table are zeros, not absent rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import dates, disciplines, status, text, times
from paceline.operators.catalogue import athlete_columns, course_columns, validated

RANKS = {"overall": "rank_overall", "category": "rank_category", "gender": "rank_gender"}
#: Places up to which a rank counts, by the name of the counter.
PLACES = {"victories": 1, "podiums": 3, "top10": 10}
BUCKET_SECONDS, MOST_BUCKETS = 300, 60
TOP_CATEGORIES, TOP_CLUBS = 8, 9


def totals(rows: DataFrame) -> DataFrame:
    """Participations, athletes and events of filtered rows, in one row."""
    return rows.agg(
        F.count("*").alias("participations"), F.countDistinct("athlete_id").alias("athletes"), F.countDistinct("course_id").alias("events")
    )


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("course_type").agg(F.count("*").alias("n"))


def by_month(rows: DataFrame) -> DataFrame:
    """Participations of each month that has any; rows without a date are left out."""
    return rows.where("course_date IS NOT NULL").groupBy(dates.month_of("course_date").alias("month")).agg(F.count("*").alias("n"))


def last_months(months: DataFrame, n: int = 12) -> DataFrame:
    return months.orderBy(F.desc("month")).limit(n)


def recent(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n)


def recent_by_event(rows: DataFrame, n: int = 8) -> DataFrame:
    """By day of the event, then import, the newest first; rows without a day come last."""
    return rows.orderBy(F.desc(F.coalesce(F.col("course_date").cast("string"), F.lit(""))), F.desc_nulls_last("created_at"), F.desc("id")).limit(n)


def valid_rank(c: Column | str) -> Column:
    """Ranks below 1 are none."""
    rank = text.of(c)
    return F.when(rank >= 1, rank)


def best_valid_rank() -> Column:
    """The smallest valid one of the three ranks."""
    return F.array_min(F.array(*(valid_rank(c) for c in RANKS.values())))


def rank_counters(rows: DataFrame) -> DataFrame:
    """How often ranks are among the first 1, 3 and 10: overall, in the category, by gender (women, men) and by the best of the three."""
    in_gender = valid_rank("rank_gender")
    ranks = {
        "scratch": valid_rank("rank_overall"), "category": valid_rank("rank_category"), "all": best_valid_rank(),
        "women": F.when(F.upper("athlete_gender") == "F", in_gender), "men": F.when(F.upper("athlete_gender") == "M", in_gender),
    }
    return rows.agg(*(F.count_if(r <= k).alias(f"{name}_{place}") for name, r in ranks.items() for place, k in PLACES.items()))


def seasons(parts: DataFrame, courses: DataFrame, labels: Iterable[str] | None = None, federal_only: bool = False) -> DataFrame:
    """``season, event_count, participation_count`` of dated courses. Pending rows count here."""
    rows = parts if labels is None else parts.where(text.has_label("club", labels))
    of = course_columns(courses).where("course_date IS NOT NULL")
    of = of.where(disciplines.is_federal("course_type")) if federal_only else of
    per_course = rows.groupBy("course_id").agg(F.count("*").alias("n")).join(of, "course_id")
    return per_course.groupBy(dates.season_of("course_date").alias("season")).agg(
        F.count("*").alias("event_count"), F.sum("n").cast("bigint").alias("participation_count")
    )


def seasons_with_current(of: DataFrame, current: int) -> DataFrame:
    """``seasons`` with the current one there in any case, its label and ``is_current``."""
    now = of.sparkSession.range(1).select(
        F.lit(current).cast("bigint").alias("season"), F.lit(0).cast("bigint").alias("event_count"), F.lit(0).cast("bigint").alias("participation_count")
    )
    both = of.unionByName(now).groupBy("season").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("event_count", "participation_count")))
    return both.withColumn("label", dates.season_label("season")).withColumn("is_current", F.col("season") == current)


def status_breakdown(parts: DataFrame, *by: str) -> DataFrame:
    kind = status.status_class("status")
    return parts.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(kind == k).alias(k.lower()) for k in ("finisher", "dnf", "dns", "dsq", "unknown")))


def gender_breakdown(rows: DataFrame, *by: str) -> DataFrame:
    kind = status.gender_class("athlete_gender")
    return rows.groupBy(*by).agg(F.count_if(kind == "F").alias("women"), F.count_if(kind == "M").alias("men"), F.count_if(kind.isNull()).alias("unknown_gender"))


def most_frequent(df: DataFrame, label: Column, by: list[str], limit: int) -> DataFrame:
    """The most frequent labels per group with their counts and the count of all labels that aren't blank; ties by label."""
    n = df.where(F.coalesce(label, F.lit("")) != "").groupBy(*by, label.alias("label")).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*by)
    n = n.withColumn("labels_total", F.sum("n").over(of)).withColumn("place", F.row_number().over(of.orderBy(F.desc("n"), F.asc("label"))))
    return n.where(F.col("place") <= limit)


def top_categories(parts: DataFrame, by: list[str], limit: int = TOP_CATEGORIES) -> DataFrame:
    return most_frequent(parts, F.trim("category"), by, limit)


def top_clubs(parts: DataFrame, by: list[str], labels: Iterable[str], name: str, limit: int = TOP_CLUBS) -> DataFrame:
    """Clubs by participations, the spellings of one club (``labels``) merged under ``name``."""
    return most_frequent(parts, F.when(text.has_label("club", labels), F.lit(name)).otherwise(F.trim("club")), by, limit)


def time_histogram(parts: DataFrame, by: list[str], width: int = BUCKET_SECONDS, most: int = MOST_BUCKETS) -> DataFrame:
    """Times of finishers in steps of ``width`` seconds from the first one's; beyond ``most`` bars the rest is in the last. Empty bars are there."""
    timed = parts.where(~F.coalesce("total_time", F.lit("")).isin("", "00:00:00")).withColumn("_s", times.to_seconds("total_time"))
    step = F.floor(F.col("_s") / width)
    n = timed.groupBy(*by, step.alias("step")).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*by)
    n = n.withColumn("first", F.min("step").over(of))
    bar = F.least(F.col("step") - F.col("first"), F.lit(most - 1))
    bars = n.groupBy(*by, "first", bar.alias("bar")).agg(F.sum("n").alias("n"))
    last = bars.groupBy(*by, "first").agg(F.max("bar").alias("last"))
    grid = last.select(*by, "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("bar"))
    out = grid.join(bars.select(*by, "bar", "n"), [*by, "bar"], "left").fillna(0, ["n"])
    return out.select(*by, ((F.col("first") + F.col("bar")) * width).alias("start"), F.lit(width).alias("width"), "bar", "n")


def split_keys(parts: DataFrame, by: list[str], order: str = "id", with_empty: bool = False) -> DataFrame:
    """Labels of splits in the order in which they first appear; those without any time only ``with_empty``."""
    keys = parts.select(*by, F.col(order).alias("_order"), F.posexplode("splits").alias("_pos", "_split"))
    if not with_empty:
        keys = keys.where(F.coalesce(F.col("_split.time"), F.lit("")) != "")
    first = keys.groupBy(*by, F.col("_split.label").alias("label")).agg(F.min(F.struct("_order", "_pos")).alias("at"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("keys"))


def club_label_counts(parts: DataFrame, like: str | None = None) -> DataFrame:
    rows = parts.where(F.coalesce("club", F.lit("")) != "")
    rows = rows.where(text.contains_text("club", like)) if like else rows
    return rows.groupBy("club").agg(F.count("*").alias("n"))


def season_activity(parts: DataFrame, athletes: DataFrame, courses: DataFrame, years: Iterable[int], labels: Iterable[str] | None = None, federal_only: bool = False) -> DataFrame:
    """Athletes with at least one participation in the seasons, and how many; pending rows count."""
    of = course_columns(courses).where(dates.in_seasons("course_date", years))
    of = of.where(disciplines.is_federal("course_type")) if federal_only else of
    rows = parts if labels is None else parts.where(text.has_label("club", labels))
    n = rows.join(of.select("course_id"), "course_id", "left_semi").groupBy("athlete_id").agg(F.count("*").alias("n"))
    return n.join(athlete_columns(athletes), "athlete_id")


def athlete_order() -> list[Column]:
    """Empty last names last, then last and first name."""
    return [F.when(F.coalesce("athlete_last", F.lit("")) == "", 1).otherwise(0).asc(), F.asc("athlete_last"), F.asc("athlete_first"), F.asc("athlete_id")]


def activity_order() -> list[Column]:
    """Most participations first, then names whatever their accents."""
    return [F.desc("n"), text.searchable("athlete_last").asc(), text.searchable("athlete_first").asc(), F.asc("athlete_id")]


def discipline_families(types: DataFrame, n: str = "n") -> DataFrame:
    """Families of ``by_type`` with their counts, the count of all and the place at which they are shown."""
    of = types.groupBy(disciplines.family_of("course_type").alias("family")).agg(F.sum(n).cast("bigint").alias("n"))
    return of.withColumn("n_all", F.sum("n").over(Window.partitionBy(F.lit(1)))).withColumn("place", disciplines.family_place("family"))


def best_rank(row_rank: str | None = None) -> Column:
    """``struct(rank, scope)``: the best valid rank; equal ones in the order overall, gender, category. With ``row_rank`` that scope only."""
    scopes = ["overall", "gender", "category"] if row_rank is None else [row_rank]
    made = [F.struct(valid_rank(RANKS[s]).alias("rank"), F.lit(k).alias("_k"), F.lit(s).alias("scope")) for k, s in enumerate(scopes)]
    best = F.array_min(F.filter(F.array(*made), lambda x: x["rank"].isNotNull()))
    return F.struct(best["rank"].alias("rank"), best["scope"].alias("scope"))


def on_podium(c: Column | str) -> Column:
    return F.coalesce(text.of(c).between(1, 3), F.lit(False))


def roster(rows: DataFrame) -> DataFrame:
    """Per athlete: participations, podiums (in any of the ranks, and in each), last event by day (the first row of equal days)."""
    any_podium = reduce(lambda a, b: a | b, (on_podium(c) for c in RANKS.values()))
    latest = F.min_by("course_name", F.struct(F.datediff(F.lit("9999-12-31"), F.coalesce("course_date", F.lit("0001-01-01").cast("date"))), "id"))
    return rows.groupBy("athlete_id").agg(
        F.count("*").alias("n"), F.count_if(any_podium).alias("podiums"),
        *(F.count_if(on_podium(c)).alias(f"podiums_{s}") for s, c in RANKS.items()),
        F.max("course_date").alias("last_date"), latest.alias("last_event"),
    )


def club_summary(rows: DataFrame) -> DataFrame:
    any_podium = reduce(lambda a, b: a | b, (on_podium(c) for c in RANKS.values()))
    event = F.struct("course_name", "course_date")
    return rows.agg(
        F.count("*").alias("results"), F.countDistinct("athlete_id").alias("athletes"), F.countDistinct(event).alias("events"), F.count_if(any_podium).alias("podiums")
    )


def podium_list(rows: DataFrame, scope: str | None = None, n: int = 6) -> DataFrame:
    best = rows.withColumn("best", best_rank(scope)).where(F.col("best.rank").between(1, 3))
    return best.orderBy(F.asc("best.rank"), F.desc_nulls_last("course_date"), F.asc("id")).limit(n)


def top_events(events: DataFrame, n: int = 6) -> DataFrame:
    return events.orderBy(F.desc("total"), F.desc_nulls_last("course_date"), F.asc("course_name"), F.asc("course_id")).limit(n)


def favourite_format(rows: DataFrame) -> DataFrame:
    """Per athlete the most frequent format token, dashes apart; of equal ones the one seen first."""
    token = rows.select("athlete_id", "id", disciplines.format_token("course_type", "course_km").alias("token")).where("token <> '—'")
    n = token.groupBy("athlete_id", "token").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = Window.partitionBy("athlete_id").orderBy(F.desc("n"), F.asc("first"))
    return n.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "first")


def athlete_kpi(rows: DataFrame) -> DataFrame:
    """Best place and number of places up to 10 of what is neither pending nor rejected; a rank of 0 counts here."""
    shown = rows.where(~F.coalesce("is_pending", F.lit(False)) & ~F.coalesce("is_rejected", F.lit(False)))
    return shown.groupBy("athlete_id").agg(F.min("rank_overall").alias("best_place"), F.count_if(F.col("rank_overall") <= 10).alias("top10"))


def picker(rows: DataFrame, n: int = 12) -> DataFrame:
    of = rows.groupBy("athlete_id", "athlete_last", "athlete_first").agg(F.count("*").alias("n"))
    return of.orderBy(F.desc("n"), F.asc("athlete_id")).limit(n)


def recent_count(log: DataFrame, key: str, at: str, since: Column) -> DataFrame:
    """How often each key occurs from ``since`` on."""
    return log.where(F.col(at) >= since).groupBy(key).agg(F.count("*").alias("n"))


def repeated_identities(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def validated_only(rows: DataFrame) -> DataFrame:
    return rows.where(validated())
