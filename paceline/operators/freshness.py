"""What an import may skip: fresh events, addresses that lead elsewhere, batches and their totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.urls import normalize_url
from paceline.operators.ranking import latest

#: How long a course counts as fresh: while a participation has no time, and after.
SHORT, LONG = dt.timedelta(minutes=10), dt.timedelta(days=30)


def fresh_courses(courses: DataFrame, parts: DataFrame, now: dt.datetime, short: dt.timedelta = SHORT, long: dt.timedelta = LONG) -> DataFrame:
    """``id, untimed, fresh`` of every course; one that was never read isn't fresh."""
    open_ = parts.groupBy("course_id").agg(F.bool_or(F.coalesce("total_time", F.lit("")) == "").alias("untimed"))
    out = courses.select("id", "scraped_at").join(open_, F.col("id") == F.col("course_id"), "left").drop("course_id")
    out = out.withColumn("untimed", F.coalesce("untimed", F.lit(False)))
    limit = F.when(F.col("untimed"), F.lit(now - short)).otherwise(F.lit(now - long))
    return out.withColumn("fresh", F.coalesce(F.col("scraped_at") > limit, F.lit(False)))


def cached_skips(courses: DataFrame, sources: DataFrame, parts: DataFrame, now: dt.datetime) -> DataFrame:
    """Addresses whose latest course is fresh, and how many participations all their courses have: what reading them would skip."""
    of = sources.select("course_id", "url").join(courses.select(F.col("id").alias("course_id"), "scraped_at"), "course_id")
    newest = latest(of, ["url"], F.desc_nulls_last("scraped_at"), F.desc("course_id"))
    fresh = fresh_courses(courses, parts, now).where("fresh").select(F.col("id").alias("course_id"))
    known = newest.join(fresh, "course_id", "left_semi").select("url")
    n = parts.groupBy("course_id").agg(F.count("*").alias("n"))
    return of.join(known, "url", "left_semi").join(n, "course_id", "left").groupBy("url").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("skipped"))


def stale_links(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links (``url``) that aren't among the fresh ones, compared in comparable form."""
    have = fresh.select(normalize_url("url").alias("_key"))
    return links.join(have, normalize_url(links["url"]) == F.col("_key"), "left_anti")


def passive_targets(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Every link with ``target``: the active address of its course if it is only known as a passive source, else itself."""
    key = normalize_url("url")
    known = sources.withColumn("_key", key)
    active = sources.where("is_active").select("course_id", F.col("url").alias("_active"))
    of = known.join(active, "course_id", "left").groupBy("_key").agg(F.bool_or("is_active").alias("_is_active"), F.min("_active").alias("_active"))
    out = links.withColumn("_key", key).join(of, "_key", "left")
    redirect = F.col("_is_active").eqNullSafe(F.lit(False)) & F.col("_active").isNotNull()
    return out.withColumn("target", F.when(redirect, F.col("_active")).otherwise(F.col("url"))).select(*links.columns, "target")


def batch_totals(items: DataFrame) -> DataFrame:
    """Sums over a batch's items (``imported, updated, skipped, error``), failures, and whether all failed."""
    failed = F.coalesce("error", F.lit("")) != ""
    return items.agg(
        F.count("*").alias("items"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("imported", "updated", "skipped")), F.count_if(failed).alias("errors")
    ).withColumn("all_failed", (F.col("items") > 0) & (F.col("errors") >= F.col("items")))


def reassignments(pairs: DataFrame) -> DataFrame:
    """How often each old identity became each new one."""
    return pairs.groupBy("old", "new").agg(F.count("*").alias("n"))


def links_of(rows: DataFrame, column: str) -> DataFrame:
    """Trimmed addresses of a column, in its order (``seq``); text that is no address is left out."""
    text = F.trim(F.coalesce(column, F.lit("")))
    return rows.select("seq", text.alias("url")).where(F.col("url").startswith("http://") | F.col("url").startswith("https://"))


def link_counts(rows: DataFrame, column: str) -> DataFrame:
    text = F.trim(F.coalesce(column, F.lit("")))
    link: Column = text.startswith("http://") | text.startswith("https://")
    return rows.agg(F.count_if(link).alias("links"), F.count_if(~link & (text != "")).alias("others"))


def deduped(links: DataFrame) -> DataFrame:
    """The first of the links that have the same comparable form, as it was written."""
    return latest(links.withColumn("_key", normalize_url("url")), ["_key"], F.asc("seq"), F.asc("url")).drop("_key")
