"""Queries of listings: filters, joins, pages, searches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import dates, disciplines, status, text, urls
from paceline.operators import catalogue, ranking
from paceline.plans.bindings import CLUB_LABELS, IS_CLUB, TODAY, Tables, query

EVENT_SQL = "course_id, course_name, event_date AS course_date, event_type AS course_type, course_relay, course_km"
GROUP = "GROUP BY course_id, course_name, event_date, event_type, course_relay, course_km"


def rows(t: Tables, **f) -> DataFrame:
    return catalogue.filtered(t.parts, t.athletes, t.courses, catalogue.Filters(**f))


def events(t: Tables, **f) -> DataFrame:
    return catalogue.event_catalogue(rows(t, **f), CLUB_LABELS)


@query(f"SELECT {EVENT_SQL}, count(*) AS total, sum(CASE WHEN {IS_CLUB} THEN 1 ELSE 0 END)::BIGINT AS club_count FROM shown {GROUP}")
def event_catalogue(t: Tables) -> DataFrame:
    return events(t)


@query(
    "SELECT count(DISTINCT course_id) AS events, count(*) AS participations FROM shown WHERE event_type NOT IN ('trail', 'course-a-pied-10k') "
    "AND (event_date BETWEEN DATE '2017-09-01' AND DATE '2018-08-31' OR event_date BETWEEN DATE '2015-09-01' AND DATE '2016-08-31')"
)
def event_catalogue_totals(t: Tables) -> DataFrame:
    return catalogue.event_totals(rows(t, federal_only=True, seasons=dates.parse_seasons("2017, x,2015,2017,0")))


def event_page_sql(order: str, offset: int) -> str:
    return f"SELECT {EVENT_SQL}, count(*) AS total, sum(CASE WHEN {IS_CLUB} THEN 1 ELSE 0 END)::BIGINT AS club_count FROM shown {GROUP} ORDER BY {order} LIMIT 30 OFFSET {offset}"


@query(event_page_sql("event_date DESC NULLS LAST, course_name, course_id", 0))
def event_page_date_desc(t: Tables) -> DataFrame:
    return catalogue.page(events(t), catalogue.event_order("date_desc"), 1, 30)


@query(event_page_sql("event_date ASC NULLS LAST, course_name, course_id", 30))
def event_page_date_asc(t: Tables) -> DataFrame:
    return catalogue.page(events(t), catalogue.event_order("date_asc"), 2, 30)


@query(event_page_sql("course_name, event_date DESC NULLS LAST, course_id", 60))
def event_page_name(t: Tables) -> DataFrame:
    return catalogue.page(events(t), catalogue.event_order("name"), 3, 30)


@query(
    f"SELECT {EVENT_SQL}, scraped_at AS course_scraped_at, count(*) AS total FROM shown s JOIN (SELECT id AS cid, scraped_at FROM courses) c ON c.cid = s.course_id "
    f"{GROUP}, scraped_at ORDER BY scraped_at DESC NULLS LAST, course_name, course_id LIMIT 25"
)
def event_page_imported(t: Tables) -> DataFrame:
    at = t.courses.select(F.col("id").alias("course_id"), F.col("scraped_at").alias("course_scraped_at"))
    n = rows(t).join(at, "course_id").groupBy(*catalogue.EVENT, "course_scraped_at").agg(F.count("*").alias("total"))
    return catalogue.page(n, catalogue.event_order("imported_desc"), 1, 25)


@query(f"SELECT id, course_id, athlete_id, club FROM shown WHERE {IS_CLUB}")
def club_scope_filter(t: Tables) -> DataFrame:
    return rows(t, labels=CLUB_LABELS).select("id", "course_id", "athlete_id", "club")


@query("SELECT id, event_type FROM courses WHERE event_type NOT IN ('trail', 'course-a-pied-10k')")
def federal_filter(t: Tables) -> DataFrame:
    return t.courses.where(disciplines.is_federal("event_type")).select("id", "event_type")


@query(
    "SELECT id, coalesce(nullif(event_type, 'bike-run') NOT IN ('trail', 'course-a-pied-10k'), TRUE) AS keeping_null, "
    "coalesce(nullif(event_type, 'bike-run') NOT IN ('trail', 'course-a-pied-10k'), FALSE) AS dropping_null FROM courses"
)
def federal_null(t: Tables) -> DataFrame:
    slug = F.nullif(F.col("event_type"), F.lit("bike-run"))
    return t.courses.select(
        "id", disciplines.is_federal(slug, keep_null=True).alias("keeping_null"), F.coalesce(disciplines.is_federal(slug), F.lit(False)).alias("dropping_null")
    )


@query("SELECT id, course_id, event_date AS course_date FROM shown WHERE event_date BETWEEN DATE '2018-09-01' AND DATE '2019-08-31'")
def season_filter(t: Tables) -> DataFrame:
    return rows(t, seasons=[2018]).select("id", "course_id", "course_date")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= DATE '1998-02-01' AND l_shipdate < DATE '1998-03-01'")
def date_range_filter(t: Tables) -> DataFrame:
    at = F.col("l_shipdate")
    return t.table("lineitem").where((at >= F.lit(dt.date(1998, 2, 1))) & (at < F.lit(dt.date(1998, 3, 1)))).select("l_orderkey", "l_linenumber", "l_shipdate")


FOLD = "strip_accents(lower({}))"


@query(
    "SELECT id, last_name, first_name FROM athletes WHERE (contains(strip_accents(lower(last_name)), 'lemee') OR contains(strip_accents(lower(first_name)), 'lemee')) "
    "AND (contains(strip_accents(lower(last_name)), 'zo') OR contains(strip_accents(lower(first_name)), 'zo'))"
)
def name_search_words(t: Tables) -> DataFrame:
    return t.athletes.where(text.name_matches(" Zo LEMÉE", "last_name", "first_name")).select("id", "last_name", "first_name")


@query("SELECT id, last_name FROM athletes WHERE FALSE")
def name_search_empty(t: Tables) -> DataFrame:
    return t.athletes.where(text.name_matches("  ", "last_name", "first_name")).select("id", "last_name")


@query("SELECT id FROM athletes WHERE contains(last_name, '%') OR contains(last_name, '_')")
def name_search_escape(t: Tables) -> DataFrame:
    return t.athletes.where(text.name_matches("%", "last_name") | text.name_matches("_", "last_name")).select("id")


@query("SELECT doc_id, length(strip_accents(lower(text))) AS n FROM documents WHERE contains(strip_accents(lower(text)), 'eaux')")
def name_search_deaccent(t: Tables) -> DataFrame:
    folded = text.searchable("text")
    return t.table("documents").where(folded.contains("eaux")).select("doc_id", F.length(folded).cast("bigint").alias("n"))


TRIGRAM_SQL = """
WITH names AS (SELECT p_partkey, p_name FROM part),
words AS (SELECT p_partkey, w FROM (SELECT p_partkey, unnest(regexp_split_to_array(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS w FROM names) WHERE w <> ''),
grams AS (SELECT DISTINCT p_partkey, substr('  ' || w || ' ', k, 3) AS g FROM (SELECT p_partkey, w, unnest(range(1, length(w) + 2)) AS k FROM words)),
term AS (SELECT DISTINCT substr('  ' || w || ' ', k, 3) AS g FROM (SELECT w, unnest(range(1, length(w) + 2)) AS k FROM (SELECT unnest(['small', 'wigget']) AS w)))
SELECT p_partkey, count(*) FILTER (g IN (SELECT g FROM term)) AS shared, (count(*) + (SELECT count(*) FROM term) - count(*) FILTER (g IN (SELECT g FROM term)))::BIGINT AS either
FROM grams GROUP BY p_partkey
HAVING 10 * count(*) FILTER (g IN (SELECT g FROM term)) >= 3 * (count(*) + (SELECT count(*) FROM term) - count(*) FILTER (g IN (SELECT g FROM term)))
"""


@query(TRIGRAM_SQL, bare=True)
def fuzzy_name_similarity(t: Tables) -> DataFrame:
    shared, either = text.common_trigrams("p_name", F.lit("Small Wigget"))
    return t.table("part").where(text.fuzzy_matches("p_name", "Small Wigget")).select("p_partkey", shared.cast("bigint").alias("shared"), either.cast("bigint").alias("either"))


@query("SELECT id, name FROM courses WHERE coalesce(reliability_override, is_reliable_computed) IS FALSE")
def unreliable_only(t: Tables) -> DataFrame:
    return catalogue.unreliable_only(t.courses).select("id", "name")


@query(f"SELECT id, name FROM courses c WHERE EXISTS (SELECT 1 FROM parts p WHERE p.course_id = c.id AND {IS_CLUB})")
def semi_join_courses_with_club(t: Tables) -> DataFrame:
    return catalogue.courses_with_club(t.courses, t.parts, CLUB_LABELS).select("id", "name")


@query(
    f"SELECT id, name, event_date FROM courses c WHERE contains(lower(name), 'triathlon') AND event_type = 'triathlon-m' AND event_date >= DATE '2016-06-01' "
    f"AND event_date <= DATE '2019-12-31' AND coalesce(reliability_override, is_reliable_computed) IS FALSE AND EXISTS (SELECT 1 FROM parts p WHERE p.course_id = c.id AND {IS_CLUB}) "
    "ORDER BY event_date DESC NULLS LAST, name, id LIMIT 50"
)
def course_listing(t: Tables) -> DataFrame:
    found = catalogue.course_listing(
        t.courses, t.parts, name="TRIATHLON", event_type="triathlon-m", labels=CLUB_LABELS, date_from=dt.date(2016, 6, 1), date_to=dt.date(2019, 12, 31), unreliable=True
    )
    return catalogue.page(found, catalogue.course_order(), 1, 50).select("id", "name", "event_date")


@query("SELECT course_id, bool_or(bib_number = '7') IS TRUE AS has_bib FROM parts GROUP BY course_id")
def exists_probe(t: Tables) -> DataFrame:
    return t.parts.groupBy("course_id").agg(F.coalesce(F.bool_or(F.col("bib_number") == "7"), F.lit(False)).alias("has_bib"))


@query(
    "SELECT id, bib_number FROM parts a WHERE course_id = 7 AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.course_id = 14 AND b.bib_number <> '' AND b.bib_number = a.bib_number)"
)
def anti_join_bibs(t: Tables) -> DataFrame:
    return catalogue.absent_bibs(t.parts, 7, 14).select("id", "bib_number")


@query("SELECT id, last_name FROM athletes a WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.athlete_id = a.id AND p.course_id % 3 = 0)")
def orphans(t: Tables) -> DataFrame:
    return catalogue.orphans(t.athletes, t.parts.where("course_id % 3 = 0")).select("id", "last_name")


@query("SELECT athlete_id FROM parts GROUP BY athlete_id HAVING count(*) = count(*) FILTER (course_id = 100)")
def only_on_course(t: Tables) -> DataFrame:
    return catalogue.only_on_course(t.parts, 100)


@query("SELECT a.id, count(p.id) AS n FROM athletes a LEFT JOIN parts p ON p.athlete_id = a.id GROUP BY a.id")
def left_join_counts(t: Tables) -> DataFrame:
    return catalogue.left_counts(t.athletes.select("id"), t.parts, "athlete_id")


@query(
    f"""SELECT c.id, coalesce(s.url, '') AS source_url, coalesce(s.provider, '') AS provider, coalesce(n.total, 0) AS total, coalesce(n.club_count, 0)::BIGINT AS club_count
    FROM courses c LEFT JOIN sources s ON s.course_id = c.id AND s.is_active
    LEFT JOIN (SELECT course_id, count(*) AS total, sum(CASE WHEN {IS_CLUB} THEN 1 ELSE 0 END) AS club_count FROM parts GROUP BY course_id) n ON n.course_id = c.id"""
)
def identities_with_counts(t: Tables) -> DataFrame:
    return catalogue.identities_with_counts(t.courses, t.sources, t.parts, CLUB_LABELS).select("id", "source_url", "provider", "total", "club_count")


@query("SELECT course_id, string_agg(url, ' ' ORDER BY is_active DESC, created_at, id) AS urls FROM sources GROUP BY course_id")
def sources_of_courses(t: Tables) -> DataFrame:
    of = catalogue.with_sources(t.courses, t.sources).where("sources IS NOT NULL")
    return of.select(F.col("id").alias("course_id"), F.array_join(F.transform("sources", lambda s: s["url"]), " ").alias("urls"))


@query("SELECT course_id, is_relay, count(*) AS finishers FROM parts WHERE lower(status) = 'finisher' AND rank_overall IS NOT NULL AND NOT is_pending GROUP BY ALL")
def finishers_by_group(t: Tables) -> DataFrame:
    return catalogue.finishers_by_group(t.parts)


@query(
    "WITH g AS (SELECT course_id, is_relay, count(*) AS finishers FROM parts WHERE lower(status) = 'finisher' AND rank_overall IS NOT NULL AND NOT is_pending GROUP BY ALL) "
    "SELECT p.id, g.finishers FROM parts p LEFT JOIN g ON p.course_id = g.course_id AND p.is_relay = g.is_relay"
)
def participations_with_group_size(t: Tables) -> DataFrame:
    return catalogue.with_group_sizes(t.parts).select("id", "finishers")


LEADERBOARD = (
    "CASE upper(coalesce(status, '')) WHEN 'DNF' THEN 1 WHEN 'DSQ' THEN 2 WHEN 'DNS' THEN 3 ELSE 0 END, (rank_overall IS NULL)::INT, rank_overall NULLS LAST, "
    "(coalesce(total_time, '') IN ('', '00:00:00'))::INT, coalesce(total_time, ''), lower(last_name) NULLS LAST, lower(first_name) NULLS LAST, id"
)


@query(f"SELECT id, status, rank_overall, total_time, last_name FROM shown WHERE course_id = 21 ORDER BY {LEADERBOARD} LIMIT 20 OFFSET 20")
def leaderboard_page(t: Tables) -> DataFrame:
    of = catalogue.leaderboard(rows(t, course_id=21))
    return catalogue.page(of, catalogue.leaderboard_order(), 2, 20).select("id", "status", "rank_overall", "total_time", F.col("athlete_last").alias("last_name"))


@query(f"SELECT course_id, id, row_number() OVER (PARTITION BY course_id ORDER BY {LEADERBOARD}) AS place FROM shown WHERE {IS_CLUB}")
def leaderboard_places(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("course_id").orderBy(*catalogue.leaderboard_order()))
    return catalogue.leaderboard(rows(t), labels=CLUB_LABELS).select("course_id", "id", place.cast("bigint").alias("place"))


@query("SELECT id, is_pending, is_rejected FROM parts WHERE is_pending AND NOT is_rejected")
def pending_queue(t: Tables) -> DataFrame:
    return catalogue.pending(t.parts).select("id", "is_pending", "is_rejected")


@query("SELECT id FROM parts WHERE is_pending AND is_rejected")
def rejected_list(t: Tables) -> DataFrame:
    return catalogue.pending(t.parts, rejected=True).select("id")


@query("SELECT id, scraped_at FROM courses WHERE scraped_at < DATE '2024-01-16'")
def stale_courses(t: Tables) -> DataFrame:
    return catalogue.stale_courses(t.courses, dt.datetime.fromisoformat(TODAY), 30).select("id", "scraped_at")


@query("SELECT url, count(*) AS n, max(page_id) AS page_id FROM pages GROUP BY url")
def latest_by_url(t: Tables) -> DataFrame:
    pages = t.table("pages")
    newest = ranking.latest(pages, ["url"], F.desc("page_id")).select("url", "page_id")
    return newest.join(pages.groupBy("url").agg(F.count("*").alias("n")), "url")


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_matches(url, '^https?://[^/]') AS valid FROM pages")
def url_hosts(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", urls.host_of("url").alias("host"), urls.is_web_address("url").alias("valid"))


@query(
    "SELECT page_id, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'com' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'net' END AS provider "
    "FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"
)
def provider_dispatch(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", urls.provider_of("url", {"com": ["example.com"], "net": ["example.net"]}).alias("provider"))


@query("SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(t: Tables) -> DataFrame:
    return t.table("pages").groupBy(urls.host_of("url").alias("host")).agg(F.count("*").alias("n"))


@query(
    "SELECT page_id, regexp_extract(u, '^([a-z]+://[^/?]*)', 1) || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(u, '(\\?.*)$', 1) AS url FROM ("
    "SELECT page_id, u, regexp_replace(regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS p FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))"
)
def url_normalize(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", urls.normalize_url("url").alias("url"))


@query(
    "SELECT id, lower(CASE WHEN regexp_extract(url, '[?&]heat=([^&#]*)', 1) <> '' THEN regexp_extract(url, '[?&]heat=([^&#]*)', 1) "
    "ELSE regexp_extract(url, '^https?://[^/]+/resultats-courses/[^/?]+/([^/?]+)$', 1) END) AS heat, "
    "CASE WHEN provider IN ('plata', 'platb') THEN regexp_extract(url, '\\d{10,}-\\d+', 0) ELSE '' END AS event FROM sources"
)
def heat_and_event_id(t: Tables) -> DataFrame:
    return t.sources.select("id", urls.heat_slug("url").alias("heat"), urls.event_id("url", "provider", ("plata", "platb")).alias("event"))


@query("SELECT id, status, CASE WHEN o.status IN ('dnf', 'DNS', 'DSQ') THEN TRUE ELSE FALSE END AS out FROM parts o")
def non_finishers(t: Tables) -> DataFrame:
    return t.parts.select("id", "status", status.is_non_finisher("status").alias("out"))


@query("SELECT athlete_id, last_name, first_name, count(*) AS n FROM shown WHERE contains(strip_accents(lower(last_name)), 'lemee') GROUP BY ALL ORDER BY n DESC, athlete_id LIMIT 12")
def athlete_picker(t: Tables) -> DataFrame:
    from paceline.operators.stats import picker

    return picker(rows(t, name="lemee")).withColumnsRenamed({"athlete_last": "last_name", "athlete_first": "first_name"})
