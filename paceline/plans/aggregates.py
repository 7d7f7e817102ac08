"""Queries of aggregates: dashboard, seasons, summaries, rosters, quality, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import catalogue, quality, stats
from paceline.plans.bindings import CLUB_LABELS, CLUB_NAME, IS_CLUB, PLATFORMS, SEASON, SECONDS, STATUS_CLASS, Tables, query
from paceline.plans.listings import rows


@query("SELECT count(*) AS participations, count(DISTINCT athlete_id) AS athletes, count(DISTINCT course_id) AS events FROM shown")
def dashboard_totals(t: Tables) -> DataFrame:
    return stats.totals(rows(t))


@query("SELECT 0::BIGINT AS participations, 0::BIGINT AS athletes, 0::BIGINT AS events")
def dashboard_totals_empty(t: Tables) -> DataFrame:
    return stats.totals(rows(t, name=" "))


@query("SELECT event_type AS course_type, count(*) AS n FROM shown GROUP BY event_type")
def by_type(t: Tables) -> DataFrame:
    return stats.by_type(rows(t))


@query("SELECT strftime(event_date, '%Y-%m') AS month, count(*) AS n FROM shown WHERE event_date IS NOT NULL GROUP BY 1")
def by_month(t: Tables) -> DataFrame:
    return stats.by_month(rows(t))


@query("SELECT strftime(event_date, '%Y-%m') AS month, count(*) AS n FROM shown WHERE event_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def last_12_months(t: Tables) -> DataFrame:
    return stats.last_months(stats.by_month(rows(t)))


@query("SELECT id, created_at FROM shown ORDER BY created_at DESC, id DESC LIMIT 20")
def recent_20(t: Tables) -> DataFrame:
    return stats.recent(rows(t)).select("id", "created_at")


@query("SELECT id, event_date FROM joined ORDER BY coalesce(event_date::VARCHAR, '') DESC, created_at DESC, id DESC LIMIT 8")
def recent_by_event(t: Tables) -> DataFrame:
    return stats.recent_by_event(rows(t, include_pending=True)).select("id", F.col("course_date").alias("event_date"))


def counters_sql() -> str:
    valid = {c: f"CASE WHEN {c} >= 1 THEN {c} END" for c in ("rank_overall", "rank_category", "rank_gender")}
    ranks = {
        "scratch": valid["rank_overall"], "category": valid["rank_category"], "all": f"least({', '.join(valid.values())})",
        "women": f"CASE WHEN upper(gender) = 'F' THEN {valid['rank_gender']} END", "men": f"CASE WHEN upper(gender) = 'M' THEN {valid['rank_gender']} END",
    }
    return ", ".join(f"count(*) FILTER (({r}) <= {k}) AS {name}_{place}" for name, r in ranks.items() for place, k in stats.PLACES.items())


@query(f"SELECT {counters_sql()} FROM shown")
def rank_counters(t: Tables) -> DataFrame:
    return stats.rank_counters(rows(t))


@query(f"SELECT {SEASON} AS season, count(DISTINCT course_id) AS event_count, count(*) AS participation_count FROM joined WHERE event_date IS NOT NULL GROUP BY 1")
def season_rollup(t: Tables) -> DataFrame:
    return stats.seasons(t.parts, t.courses)


@query(
    f"SELECT season, sum(e)::BIGINT AS event_count, sum(p)::BIGINT AS participation_count, 'Saison ' || season || ' — ' || (season + 1) AS label, season = 2025 AS is_current FROM ("
    f"SELECT {SEASON} AS season, count(DISTINCT course_id) AS e, count(*) AS p FROM joined WHERE event_date IS NOT NULL AND {IS_CLUB} "
    "AND event_type NOT IN ('trail', 'course-a-pied-10k') GROUP BY 1 UNION ALL SELECT 2025, 0, 0) GROUP BY season"
)
def season_with_current(t: Tables) -> DataFrame:
    return stats.seasons_with_current(stats.seasons(t.parts, t.courses, CLUB_LABELS, federal_only=True), 2025)


@query(
    f"SELECT course_id, count(*) AS n, {', '.join(f'count(*) FILTER (k = {chr(39)}{k}{chr(39)}) AS {k}' for k in ('finisher', 'dnf', 'dns', 'dsq', 'unknown'))} "
    f"FROM (SELECT course_id, {STATUS_CLASS} AS k FROM shown) GROUP BY course_id"
)
def status_breakdown(t: Tables) -> DataFrame:
    return stats.status_breakdown(rows(t), "course_id")


@query(
    "SELECT course_id, count(*) FILTER (g IN ('f', 'w')) AS women, count(*) FILTER (g IN ('m', 'h')) AS men, count(*) FILTER (g IS NULL OR g NOT IN ('f', 'w', 'm', 'h')) AS unknown_gender "
    "FROM (SELECT course_id, lower(substr(trim(gender), 1, 1)) AS g FROM shown) GROUP BY course_id"
)
def gender_breakdown(t: Tables) -> DataFrame:
    return stats.gender_breakdown(rows(t), "course_id")


def top_sql(label: str, limit: int) -> str:
    return (
        f"WITH n AS (SELECT course_id, {label} AS label, count(*) AS n FROM shown WHERE coalesce({label}, '') <> '' GROUP BY 1, 2) "
        f"SELECT course_id, label, n, labels_total, place FROM (SELECT *, sum(n) OVER (PARTITION BY course_id)::BIGINT AS labels_total, "
        f"row_number() OVER (PARTITION BY course_id ORDER BY n DESC, label) AS place FROM n) WHERE place <= {limit}"
    )


@query(top_sql("trim(category)", 3))
def top_categories(t: Tables) -> DataFrame:
    return stats.top_categories(rows(t), ["course_id"], 3)


@query(top_sql(f"CASE WHEN {IS_CLUB} THEN 'Tri Club' ELSE trim(club) END", 9))
def top_clubs_merged(t: Tables) -> DataFrame:
    return stats.top_clubs(rows(t), ["course_id"], CLUB_LABELS, CLUB_NAME)


@query(
    f"""WITH s AS (SELECT course_id, {SECONDS} // 300 AS step FROM shown WHERE coalesce(total_time, '') NOT IN ('', '00:00:00')),
    f AS (SELECT course_id, min(step) AS first FROM s GROUP BY course_id),
    b AS (SELECT s.course_id, f.first, least(s.step - f.first, 19) AS bar, count(*) AS n FROM s JOIN f ON s.course_id = f.course_id GROUP BY 1, 2, 3),
    g AS (SELECT course_id, first, unnest(range(0, max(bar) + 1)) AS bar FROM b GROUP BY course_id, first)
    SELECT g.course_id, (g.first + g.bar) * 300 AS start, 300 AS width, g.bar, coalesce(b.n, 0)::BIGINT AS n FROM g LEFT JOIN b ON g.course_id = b.course_id AND g.bar = b.bar"""
)
def time_histogram(t: Tables) -> DataFrame:
    return stats.time_histogram(rows(t), ["course_id"], most=20)


@query(
    """WITH k AS (SELECT p.course_id, s.label, min((p.id, s.pos)) AS first_at FROM splits s JOIN parts p ON p.id = s.id WHERE s.seconds IS NOT NULL GROUP BY 1, 2)
    SELECT course_id, string_agg(label, ',' ORDER BY first_at) AS keys FROM k GROUP BY course_id"""
)
def split_keys_first_seen(t: Tables) -> DataFrame:
    return stats.split_keys(t.timed_parts, ["course_id"]).select("course_id", F.array_join("keys", ",").alias("keys"))


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_values(t: Tables) -> DataFrame:
    k = F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).cast("bigint")
    return t.table("events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT club, count(*) AS n FROM parts WHERE coalesce(club, '') <> '' AND contains(lower(club), 'tri') GROUP BY club")
def club_label_counts(t: Tables) -> DataFrame:
    return stats.club_label_counts(t.parts, "TRI")


@query(
    "SELECT athlete_id, last_name, count(*) AS n FROM joined WHERE event_date BETWEEN DATE '2016-09-01' AND DATE '2018-08-31' GROUP BY ALL"
)
def season_activity(t: Tables) -> DataFrame:
    return stats.season_activity(t.parts, t.athletes, t.courses, [2016, 2017]).select("athlete_id", F.col("athlete_last").alias("last_name"), "n")


@query(
    "SELECT athlete_id, n FROM (SELECT athlete_id, last_name, first_name, count(*) AS n FROM joined WHERE event_date BETWEEN DATE '2016-09-01' AND DATE '2017-08-31' GROUP BY ALL) "
    "ORDER BY n DESC, strip_accents(lower(last_name)), strip_accents(lower(first_name)), athlete_id LIMIT 40"
)
def season_activity_page(t: Tables) -> DataFrame:
    of = stats.season_activity(t.parts, t.athletes, t.courses, [2016])
    return catalogue.page(of, stats.activity_order(), 1, 40).select("athlete_id", "n")


FAMILY = (
    "CASE WHEN event_type LIKE 'triathlon%' THEN 'Triathlon' WHEN event_type LIKE 'swimrun%' THEN 'Swim & Run' WHEN event_type LIKE 'duathlon%' THEN 'Duathlon' "
    "WHEN event_type IN ('aquathlon', 'aquarun') THEN 'Aquathlon' WHEN event_type = 'bike-run' THEN 'Run & Bike' ELSE 'Autres' END"
)


@query(
    f"SELECT family, n, sum(n) OVER ()::BIGINT AS n_all, list_position(['Triathlon', 'Swim & Run', 'Duathlon', 'Aquathlon', 'Run & Bike', 'Autres'], family)::BIGINT AS place "
    f"FROM (SELECT {FAMILY} AS family, count(*) AS n FROM shown GROUP BY 1)"
)
def discipline_families(t: Tables) -> DataFrame:
    return stats.discipline_families(stats.by_type(rows(t)))


PODIUM = "(coalesce(rank_overall, 0) BETWEEN 1 AND 3 OR coalesce(rank_category, 0) BETWEEN 1 AND 3 OR coalesce(rank_gender, 0) BETWEEN 1 AND 3)"


@query(
    f"""WITH r AS (SELECT athlete_id, count(*) AS n, count(*) FILTER ({PODIUM}) AS podiums, count(*) FILTER (rank_overall BETWEEN 1 AND 3) AS podiums_overall,
    count(*) FILTER (rank_category BETWEEN 1 AND 3) AS podiums_category, count(*) FILTER (rank_gender BETWEEN 1 AND 3) AS podiums_gender, max(event_date) AS last_date
    FROM shown GROUP BY athlete_id),
    l AS (SELECT athlete_id, course_name AS last_event FROM shown QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY event_date DESC NULLS LAST, id) = 1)
    SELECT r.*, l.last_event FROM r JOIN l ON r.athlete_id = l.athlete_id"""
)
def roster(t: Tables) -> DataFrame:
    return stats.roster(rows(t))


@query(f"SELECT count(*) AS results, count(DISTINCT athlete_id) AS athletes, count(DISTINCT course_name || '|' || coalesce(event_date::VARCHAR, '')) AS events, count(*) FILTER ({PODIUM}) AS podiums FROM shown WHERE {IS_CLUB}")
def club_summary(t: Tables) -> DataFrame:
    return stats.club_summary(rows(t, labels=CLUB_LABELS))


VALID = [f"CASE WHEN {c} >= 1 THEN {c} END" for c in ("rank_overall", "rank_gender", "rank_category")]


@query(
    f"""SELECT id, best AS rank, CASE WHEN best = o THEN 'overall' WHEN best = g THEN 'gender' WHEN best = c THEN 'category' END AS scope FROM (
    SELECT id, o, g, c, least(o, g, c) AS best FROM (SELECT id, {VALID[0]} AS o, {VALID[1]} AS g, {VALID[2]} AS c FROM parts))"""
)
def best_rank(t: Tables) -> DataFrame:
    return t.parts.select("id", stats.best_rank().alias("b")).select("id", "b.rank", "b.scope")


@query(f"SELECT id, least({', '.join(VALID)}) AS rank FROM shown WHERE least({', '.join(VALID)}) BETWEEN 1 AND 3 ORDER BY 2, event_date DESC NULLS LAST, id LIMIT 6")
def podium_list(t: Tables) -> DataFrame:
    return stats.podium_list(rows(t)).select("id", "best.rank")


@query("SELECT course_id, count(*) AS total FROM shown GROUP BY course_id, event_date, course_name ORDER BY total DESC, event_date DESC NULLS LAST, course_name, course_id LIMIT 6")
def top_events(t: Tables) -> DataFrame:
    return stats.top_events(catalogue.event_catalogue(rows(t), CLUB_LABELS)).select("course_id", "total")


TOKEN = (
    "CASE WHEN regexp_extract(event_type, '-(xs|s|m|l|xl)$', 1) <> '' THEN upper(regexp_extract(event_type, '-(xs|s|m|l|xl)$', 1)) "
    "WHEN course_km <> 0 THEN floor(course_km + 0.5)::BIGINT || 'km' WHEN event_type = 'bike-run' THEN 'B&R' WHEN event_type LIKE 'trail%' THEN 'TR' "
    "WHEN event_type LIKE 'course-a-pied%' THEN 'CAP' ELSE '—' END"
)


@query(
    f"WITH n AS (SELECT athlete_id, {TOKEN} AS token, count(*) AS n, min(id) AS first FROM shown GROUP BY 1, 2) "
    "SELECT athlete_id, token, n FROM n WHERE token <> '—' QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY n DESC, first) = 1"
)
def favourite_format(t: Tables) -> DataFrame:
    return stats.favourite_format(rows(t))


@query("SELECT athlete_id, min(rank_overall) AS best_place, count(*) FILTER (rank_overall <= 10) AS top10 FROM joined WHERE NOT is_pending AND NOT is_rejected GROUP BY athlete_id")
def best_place(t: Tables) -> DataFrame:
    return stats.athlete_kpi(rows(t, include_pending=True))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id")
def rate_limit_window(t: Tables) -> DataFrame:
    return stats.recent_count(t.table("events"), "user_id", "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("SELECT name, event_date, event_type, is_relay, count(*) AS n FROM courses GROUP BY ALL HAVING count(*) > 1")
def repeated_identities(t: Tables) -> DataFrame:
    return stats.repeated_identities(t.courses, "name", "event_date", "event_type", "is_relay")


RANKED = f"{STATUS_CLASS} = 'finisher' AND coalesce(rank_overall, 0) <> 0"
REPORT = f"""WITH a AS (SELECT course_id, sum(n - d)::BIGINT AS duplicate_rank, sum(greatest(top - d, 0))::BIGINT AS rank_gap FROM (
    SELECT course_id, is_relay, count(*) AS n, count(DISTINCT rank_overall) AS d, max(rank_overall) AS top FROM parts WHERE {RANKED} GROUP BY 1, 2) GROUP BY course_id),
    b AS (SELECT course_id, count(*) AS n, count(*) FILTER ({STATUS_CLASS} = 'unknown') AS unknown_status,
    count(*) FILTER ({STATUS_CLASS} = 'finisher' AND trim(coalesce(total_time, '')) IN ('', '00:00:00', '0:00:00', '00:00', '0:00', '0')) AS finisher_without_time FROM parts GROUP BY course_id),
    d AS (SELECT course_id, sum(n - 1)::BIGINT AS duplicate_bib FROM (SELECT course_id, bib_number, count(*) AS n FROM parts WHERE coalesce(bib_number, '') <> '' GROUP BY 1, 2) GROUP BY course_id),
    r AS (SELECT c.id AS course_id, coalesce(duplicate_bib, 0) AS duplicate_bib, coalesce(unknown_status, 0) AS unknown_status, coalesce(duplicate_rank, 0) AS duplicate_rank,
    coalesce(rank_gap, 0) AS rank_gap, coalesce(finisher_without_time, 0) AS finisher_without_time, (b.n IS NULL)::BIGINT AS no_participation
    FROM courses c LEFT JOIN a ON a.course_id = c.id LEFT JOIN b ON b.course_id = c.id LEFT JOIN d ON d.course_id = c.id)
    SELECT *, duplicate_bib + unknown_status + duplicate_rank + rank_gap + finisher_without_time + no_participation = 0 AS is_reliable_computed FROM r"""


@query(REPORT)
def quality_report(t: Tables) -> DataFrame:
    return quality.quality_report(t.courses, t.parts, quality.duplicate_bibs(t.parts, "course_id")).drop("quality_issues")


@query(REPORT.replace("SELECT *, duplicate_bib", "SELECT course_id, rank_gap FROM (SELECT *, duplicate_bib") + ") WHERE rank_gap > 0")
def events_with_rank_gap(t: Tables) -> DataFrame:
    return quality.with_anomaly(quality.quality_report(t.courses, t.parts), "rank_gap").select("course_id", "rank_gap")


@query(
    f"SELECT course_id, sum(n - d)::BIGINT AS duplicate_rank, sum(greatest(top - d, 0))::BIGINT AS rank_gap FROM (SELECT course_id, is_relay, count(*) AS n, "
    f"count(DISTINCT rank_overall) AS d, max(rank_overall) AS top FROM parts WHERE {RANKED} GROUP BY 1, 2) GROUP BY course_id"
)
def duplicate_rank_gap(t: Tables) -> DataFrame:
    return quality.rank_anomalies(t.parts)


@query("SELECT l_orderkey, sum(n - 1)::BIGINT AS duplicate_bib FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def duplicate_bib(t: Tables) -> DataFrame:
    return quality.duplicate_bibs(t.table("lineitem").withColumn("bib_number", F.col("l_linenumber").cast("string")), "l_orderkey")


PLAIN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(name)), '^\\d+\\s*(?:er|ere|eme|e)\\b', ' '), '\\b(?:19|20)\\d{2}\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
)


@query(
    f"""WITH of AS (SELECT c.id, c.name, c.event_date, c.event_type, c.is_relay, coalesce(s.url, '') AS url, regexp_extract(coalesce(s.url, ''), '^https?://([^/]+)', 1) AS host,
    lower(CASE WHEN regexp_extract(s.url, '[?&]heat=([^&#]*)', 1) <> '' THEN regexp_extract(s.url, '[?&]heat=([^&#]*)', 1) ELSE regexp_extract(s.url, '^https?://[^/]+/resultats-courses/[^/?]+/([^/?]+)$', 1) END) AS heat,
    CASE WHEN s.provider IN ('plata', 'platb') THEN regexp_extract(s.url, '\\d{{10,}}-\\d+', 0) ELSE '' END AS event, {PLAIN} AS plain, coalesce(event_date, DATE '0001-01-01') AS d
    FROM courses c LEFT JOIN sources s ON s.course_id = c.id AND s.is_active),
    p AS (SELECT a.id AS left_id, b.id AS right_id, CASE WHEN coalesce(a.heat, '') <> '' AND a.url = b.url THEN 0
      WHEN coalesce(a.event, '') <> '' AND a.event = b.event AND a.event_type = b.event_type AND a.is_relay = b.is_relay AND a.host <> b.host THEN 1
      WHEN a.plain <> '' AND a.plain = b.plain AND a.event_type = b.event_type AND a.is_relay = b.is_relay AND abs(date_diff('day', a.event_date, b.event_date)) <= 3 THEN 2 END AS rule
      FROM of a JOIN of b ON a.d > b.d OR (a.d = b.d AND (a.name < b.name OR (a.name = b.name AND a.id < b.id))))
    SELECT left_id, right_id, ['same_source_url', 'shared_event_id', 'close_names'][rule + 1] AS reason FROM p WHERE rule IS NOT NULL"""
)
def self_join_duplicates(t: Tables) -> DataFrame:
    return quality.duplicate_candidates(catalogue.with_active_source(t.courses, t.sources), PLATFORMS)


@query(
    f"""WITH of AS (SELECT c.id, c.event_date, c.event_type, c.is_relay, coalesce(s.url, '') AS url, regexp_extract(coalesce(s.url, ''), '^https?://([^/]+)', 1) AS host,
    lower(CASE WHEN regexp_extract(s.url, '[?&]heat=([^&#]*)', 1) <> '' THEN regexp_extract(s.url, '[?&]heat=([^&#]*)', 1) ELSE regexp_extract(s.url, '^https?://[^/]+/resultats-courses/[^/?]+/([^/?]+)$', 1) END) AS heat,
    CASE WHEN s.provider IN ('plata', 'platb') THEN regexp_extract(s.url, '\\d{{10,}}-\\d+', 0) ELSE '' END AS event, {PLAIN} AS plain
    FROM courses c LEFT JOIN sources s ON s.course_id = c.id AND s.is_active),
    g AS (SELECT *, sum(coalesce(gap, 0)) OVER (PARTITION BY plain, event_type, is_relay ORDER BY event_date, id) AS run FROM
        (SELECT *, (date_diff('day', lag(event_date) OVER (PARTITION BY plain, event_type, is_relay ORDER BY event_date, id), event_date) > 3)::INT AS gap FROM of WHERE event_date IS NOT NULL AND plain <> ''))
    SELECT id, 'same_source_url' AS reason, min(id) OVER w AS representative, count(*) OVER w AS n FROM of WHERE coalesce(heat, '') <> '' WINDOW w AS (PARTITION BY url) QUALIFY count(*) OVER w > 1
    UNION ALL SELECT o.id, 'shared_event_id', k.representative, k.n FROM of o JOIN (SELECT event, event_type, is_relay, min(id) AS representative, count(*) AS n FROM of WHERE coalesce(event, '') <> '' GROUP BY ALL HAVING count(DISTINCT host) > 1) k
        ON o.event = k.event AND o.event_type = k.event_type AND o.is_relay = k.is_relay
    UNION ALL SELECT id, 'close_names', min(id) OVER w, count(*) OVER w FROM g WINDOW w AS (PARTITION BY plain, event_type, is_relay, run) QUALIFY count(*) OVER w > 1"""
)
def duplicate_groups(t: Tables) -> DataFrame:
    return quality.duplicate_groups(catalogue.with_active_source(t.courses, t.sources), PLATFORMS)


@query(
    """SELECT (SELECT count(*) FROM parts WHERE course_id = 14) AS participations,
    (SELECT count(*) FROM parts a WHERE course_id = 14 AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.course_id = 7 AND b.bib_number <> '' AND b.bib_number = a.bib_number)) AS unmatched,
    (SELECT count(*) FROM (SELECT athlete_id FROM parts GROUP BY athlete_id HAVING bool_and(course_id = 14))) AS orphaned"""
)
def merge_impact(t: Tables) -> DataFrame:
    return quality.merge_impact(t.parts, 7, 14)


@query(
    """SELECT count(*) AS participations, count(DISTINCT athlete_id) AS athletes, (SELECT count(*) FROM (SELECT athlete_id FROM parts GROUP BY athlete_id HAVING bool_and(course_id = 21))) AS orphaned
    FROM parts WHERE course_id = 21"""
)
def deletion_impact(t: Tables) -> DataFrame:
    return quality.deletion_impact(t.parts, 21)


@query("SELECT course_id, count(*) AS n, count(*) FILTER (coalesce(total_time, '') <> '') AS timed FROM parts GROUP BY course_id HAVING count(*) FILTER (coalesce(total_time, '') <> '') <= greatest(1, floor(count(*) * 0.6))")
def untimed_events(t: Tables) -> DataFrame:
    return quality.untimed_events(t.parts, 0.6)
