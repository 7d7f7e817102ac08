"""Queries of scalar functions: times, ranks, labels, names, disciplines, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import dates, disciplines, splits, status, text, times
from paceline.plans.bindings import SEASON, Tables, query

#: Times written in all ways, by line number; the same text for both engines.
WRITTEN = (
    "CASE l_linenumber WHEN 1 THEN lpad(CAST(l_partkey % 24 AS STRING), 2, '0') || 'h' || lpad(CAST(l_suppkey % 60 AS STRING), 2, '0') || '’' || lpad(CAST(l_orderkey % 60 AS STRING), 2, '0') "
    "WHEN 2 THEN CAST(l_partkey % 10 AS STRING) || ':' || lpad(CAST(l_suppkey % 60 AS STRING), 2, '0') || ':' || lpad(CAST(l_orderkey % 60 AS STRING), 2, '0') "
    "WHEN 3 THEN ' ' || CAST(l_suppkey % 60 AS STRING) || ':' || lpad(CAST(l_orderkey % 60 AS STRING), 2, '0') "
    "WHEN 4 THEN CAST(l_partkey % 24 AS STRING) || 'H' || CAST(l_suppkey % 60 AS STRING) WHEN 5 THEN '' ELSE 'n/a ' || CAST(l_orderkey AS STRING) END"
)
LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + WRITTEN + " AS raw FROM lineitem"
G = "regexp_extract(s, '{}', {})"
HMS = "format('{{:02d}}:{{:02d}}:{{:02d}}', {}, {}, {})"


def lines(t: Tables) -> DataFrame:
    return t.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{WRITTEN} AS raw")


def parts_of(rule: str, *groups: int | None) -> str:
    return HMS.format(*("0" if g is None else f"TRY_CAST(regexp_extract(s, '{rule}', {g}) AS BIGINT)" for g in groups))


RULES = (r"^(\d+)[hH](\d+)[m''](\d+)", r"^(\d{1,2}):(\d{2}):(\d{2})$", r"^(\d{1,2}):(\d{2})$", r"^(\d+)[hH](\d+)$")
NORMAL = (
    f"CASE WHEN regexp_matches(s, '{RULES[0]}') THEN {parts_of(RULES[0], 1, 2, 3)} WHEN regexp_matches(s, '{RULES[1]}') THEN {parts_of(RULES[1], 1, 2, 3)} "
    f"WHEN regexp_matches(s, '{RULES[2]}') THEN {parts_of(RULES[2], None, 1, 2)} WHEN regexp_matches(s, '{RULES[3]}') THEN {parts_of(RULES[3], 1, 2, None)} ELSE s END"
)
READ = "TRY_CAST(nullif(regexp_extract({0}, '(?:(\\d+):)?(\\d{{1,2}}):(\\d{{2}})$', {1}), '') AS BIGINT)"
SECS = f"(coalesce({READ.format('v', 1)}, 0) * 3600 + {READ.format('v', 2)} * 60 + {READ.format('v', 3)})"


@query(
    f"WITH a AS (SELECT *, translate(trim(raw), '’', '''') AS s FROM ({LINES})), b AS (SELECT *, {NORMAL} AS v FROM a) "
    f"SELECT l_orderkey, l_linenumber, raw, v AS normal, {SECS}::BIGINT AS strict, coalesce({SECS}, 0)::BIGINT AS lenient FROM b"
)
def time_parse(t: Tables) -> DataFrame:
    normal = times.normalize_time("raw")
    return lines(t).select(
        "l_orderkey", "l_linenumber", "raw", normal.alias("normal"), times.to_seconds(normal, strict=True).alias("strict"), times.to_seconds(normal).alias("lenient")
    )


@query("SELECT event_id, format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS clock FROM (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events)")
def time_format(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", times.format_seconds(F.floor(F.col("value") * 100)).alias("clock"))


@query("SELECT id, total_time, trim(coalesce(total_time, '')) IN ('', '00:00:00', '0:00:00', '00:00', '0:00', '0') AS none, CASE WHEN regexp_matches(total_time, '^\\d{2}:[0-5]\\d:[0-5]\\d$') THEN split_part(total_time, ':', 1)::BIGINT * 3600 + split_part(total_time, ':', 2)::BIGINT * 60 + split_part(total_time, ':', 3)::BIGINT END AS clock FROM parts")
def time_absent(t: Tables) -> DataFrame:
    return t.parts.select("id", "total_time", times.has_no_time("total_time").alias("none"), times.clock_seconds("total_time").alias("clock"))


@query("SELECT id, TRY_CAST(nullif(regexp_replace(last_name, '[^0-9]', '', 'g'), '') AS INTEGER) AS rank, nullif(TRY_CAST(nullif(regexp_replace(last_name, '[^0-9]', '', 'g'), '') AS INTEGER), 0) AS valid FROM athletes")
def rank_parse(t: Tables) -> DataFrame:
    return t.athletes.select("id", times.parse_rank("last_name").alias("rank"), times.rank_or_null("last_name").alias("valid"))


LABELLED = "CASE o_orderkey % 9 WHEN 0 THEN 'Abandons' WHEN 1 THEN ' Non-Partant ' WHEN 2 THEN 'Disqualifié' WHEN 3 THEN 'D.N.F.' WHEN 4 THEN 'classé' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'OTL' ELSE 'ok' END"


@query(
    f"SELECT o_orderkey, label, CASE k WHEN 'abandons' THEN 'DNF' WHEN 'nonpartant' THEN 'DNS' WHEN 'disqualifie' THEN 'DSQ' WHEN 'dnf' THEN 'DNF' WHEN 'classe' THEN 'finisher' WHEN 'ok' THEN 'finisher' ELSE '' END AS status "
    f"FROM (SELECT *, regexp_replace(strip_accents(lower(coalesce(label, ''))), '[^a-z0-9]', '', 'g') AS k FROM (SELECT o_orderkey, {LABELLED} AS label FROM orders))"
)
def status_labels(t: Tables) -> DataFrame:
    return t.table("orders").selectExpr("o_orderkey", f"{LABELLED} AS label").withColumn("status", status.status_of_label("label"))


@query("SELECT id, CASE WHEN coalesce(nullif(status, 'Abandon'), '') <> '' THEN status WHEN coalesce(total_time, '') <> '' THEN 'finisher' ELSE 'DNF' END AS status FROM parts")
def status_default(t: Tables) -> DataFrame:
    return t.parts.select("id", status.status_or_default(F.nullif(F.col("status"), F.lit("Abandon")), "total_time").alias("status"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'DNS' WHEN id % 3 = 0 THEN 'DSQ' WHEN id % 2 = 0 THEN 'DNF' ELSE 'finisher' END AS status FROM parts")
def status_flags(t: Tables) -> DataFrame:
    flag = lambda k: F.col("id") % k == 0
    return t.parts.select("id", status.status_of_flags("finisher", DNS=flag(5), DSQ=flag(3), DNF=flag(2)).alias("status"))


#: Names of events in all ways.
EVENT_NAMES = (
    "CASE p_partkey % 12 WHEN 0 THEN 'Triathlon Olympique de ' || p_name || ' 2025' WHEN 1 THEN '2025 IRONMAN 70.3 ' || p_name WHEN 2 THEN 'Ironman ' || p_name WHEN 3 THEN 'Relais S-Entreprises' "
    "WHEN 4 THEN 'Trail 23 km' WHEN 5 THEN 'Semi-marathon de ' || p_name WHEN 6 THEN 'Run and Bike M' WHEN 7 THEN 'SwimRun L ' || p_name WHEN 8 THEN 'Foulées 10 km' "
    "WHEN 9 THEN 'Cyclosport 120,5 km' WHEN 10 THEN 'Duathlon-xs' ELSE p_name END"
)
ALONE = "(^|[^a-z0-9]){}([^a-z0-9]|$)"


def contains_any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(x, '{w}')" for w in words) + ")"


SIZE_SQL = (
    f"CASE WHEN {contains_any('70.3', 'half')} THEN 'l' WHEN {contains_any('xxl', 'ironman', 'embrunman')} OR regexp_matches(x, '{ALONE.format('xl')}') THEN 'xl' "
    f"WHEN {contains_any('longue')} OR regexp_matches(x, '{ALONE.format('l')}') THEN 'l' WHEN {contains_any('olymp')} OR regexp_matches(x, '{ALONE.format('m')}') THEN 'm' "
    f"WHEN {contains_any('sprint', 'decouverte', 'découverte')} OR regexp_matches(x, '{ALONE.format('s')}') THEN 's' WHEN {contains_any('extra')} OR regexp_matches(x, '{ALONE.format('xs')}') THEN 'xs' ELSE '' END"
)
SPORT_SQL = (
    f"CASE WHEN {contains_any('swimrun', 'swim-run', 'swim run', 'swim&run')} THEN 'swimrun' WHEN (regexp_matches(x, '\\bbike\\b') AND regexp_matches(x, '\\brun\\b')) OR {contains_any('bikerun', 'bike-run')} THEN 'bike-run' "
    "WHEN contains(x, 'aquathlon') THEN 'aquathlon' WHEN contains(x, 'aquarun') THEN 'aquarun' WHEN contains(x, 'duathlon') THEN 'duathlon' WHEN contains(x, 'triathlon') THEN 'triathlon' WHEN contains(x, 'trail') THEN 'trail' "
    f"WHEN {contains_any('cyclo', 'cyclisme', 'gran fondo', 'granfondo', 'vélo', 'velo')} THEN CASE WHEN {contains_any('contre-la-montre', 'contre la montre')} OR regexp_matches(x, '\\bclm\\b') THEN 'cyclisme-clm' WHEN {contains_any('route', 'cyclosport')} THEN 'cyclisme-route' ELSE 'cyclisme' END "
    f"WHEN {contains_any('marathon', 'semi', 'course à pied', 'course a pied', 'foulées', 'foulees', 'corrida', 'running')} OR regexp_matches(x, '\\b\\d+\\s*k(m)?\\b') THEN CASE WHEN {contains_any('semi', 'half')} THEN 'course-a-pied-semi' "
    "WHEN contains(x, 'marathon') THEN 'course-a-pied-marathon' WHEN regexp_matches(x, '\\b10\\s*k(m)?\\b') THEN 'course-a-pied-10k' WHEN regexp_matches(x, '\\b5\\s*k(m)?\\b') THEN 'course-a-pied-5k' ELSE 'course-a-pied' END ELSE 'triathlon' END"
)


def event_names(t: Tables) -> DataFrame:
    return t.table("part").selectExpr("p_partkey", f"{EVENT_NAMES} AS name")


@query(
    f"""SELECT p_partkey, name, CASE WHEN sport IN ('triathlon', 'duathlon') AND size <> '' OR sport = 'swimrun' AND size IN ('s', 'm', 'l') THEN sport || '-' || size ELSE sport END AS slug,
    TRY_CAST(replace(nullif(regexp_extract(x, '(\\d+(?:[.,]\\d+)?)\\s*km\\b', 1), ''), ',', '.') AS DOUBLE) AS km
    FROM (SELECT *, {SIZE_SQL} AS size, {SPORT_SQL} AS sport FROM (SELECT *, trim(lower(name)) AS x FROM (SELECT p_partkey, {EVENT_NAMES} AS name FROM part)))"""
)
def classify_text(t: Tables) -> DataFrame:
    return event_names(t).select("p_partkey", "name", disciplines.classify("name").alias("slug"), disciplines.distance_km("name").alias("km"))


@query("SELECT id, event_type, event_type AS slug FROM courses")
def slug_idempotence(t: Tables) -> DataFrame:
    return t.courses.select("id", "event_type", disciplines.normalize_slug("event_type").alias("slug"))


@query(
    "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(name)), '^\\d+\\s*(?:er|ere|eme|e)\\b', ' '), '\\b(?:19|20)\\d{2}\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM courses"
)
def comparable_name(t: Tables) -> DataFrame:
    return t.courses.select("id", text.comparable_name("name").alias("plain"))


@query(
    "SELECT id, trim(regexp_replace(trim(regexp_replace(name, '\\b20\\d{2}\\b', '', 'g')), '\\btriathlon\\s+(de\\s+)?', '', 'gi')) AS place FROM courses"
)
def place_of_event(t: Tables) -> DataFrame:
    """All courses, with the reference's steps that their names meet: the year goes, then the sport; an edition without the word stays."""
    return t.courses.select("id", text.place_of("name").alias("place"))


FULL = "CASE c_custkey % 5 WHEN 0 THEN 'DE LA TOUR Jean ' || c_name WHEN 1 THEN 'Jean-Luc DE LA TOUR' WHEN 2 THEN 'anne lise ' || c_name WHEN 3 THEN 'JP ROUX' ELSE '' END"


@query(
    f"SELECT c_custkey, full_name, CASE c_custkey % 5 WHEN 0 THEN 'DE LA TOUR' WHEN 1 THEN 'DE LA TOUR' WHEN 2 THEN c_name WHEN 3 THEN 'JP ROUX' ELSE '' END AS last, "
    f"CASE c_custkey % 5 WHEN 0 THEN 'Jean ' || c_name WHEN 1 THEN 'Jean-Luc' WHEN 2 THEN 'anne lise' ELSE '' END AS first FROM (SELECT *, {FULL} AS full_name FROM customer)"
)
def name_split(t: Tables) -> DataFrame:
    return t.table("customer").selectExpr("c_custkey", f"{FULL} AS full_name").withColumn("n", text.split_name("full_name")).select("c_custkey", "full_name", "n.last", "n.first")


@query("SELECT id, CASE WHEN event_type = '' OR contains(lower(name), lower(trim(split_part(name, ' ', 1)))) THEN name END AS same, CASE WHEN contains(lower(name), 'triathlon') THEN name ELSE name || ' - Triathlon' END AS qualified FROM courses")
def qualified_name(t: Tables) -> DataFrame:
    return t.courses.select("id", text.qualified_name("name", F.split_part("name", F.lit(" "), F.lit(1))).alias("same"), text.qualified_name("name", F.lit(" Triathlon ")).alias("qualified"))


@query(f"SELECT id, {SEASON} AS season, 'Saison ' || {SEASON} || ' — ' || ({SEASON} + 1) AS label, strftime(event_date, '%Y-%m') AS month FROM courses WHERE event_date IS NOT NULL")
def season_of_date(t: Tables) -> DataFrame:
    of = t.courses.where("event_date IS NOT NULL").withColumn("season", dates.season_of("event_date"))
    return of.select("id", "season", dates.season_label("season").alias("label"), dates.month_of("event_date").alias("month"))


MONTH = "CASE o_orderkey % 4 WHEN 0 THEN 'mai' WHEN 1 THEN 'avr.' WHEN 2 THEN 'DÉCEMBRE' ELSE 'brumaire' END"
DATED = f"CASE o_orderkey % 3 WHEN 0 THEN CAST(1 + o_orderkey % 31 AS STRING) || ' ' WHEN 1 THEN 'du ' || CAST(1 + o_orderkey % 28 AS STRING) || '–' || CAST(2 + o_orderkey % 28 AS STRING) || ' ' ELSE '31 ' END || {MONTH} || ' ' || CAST(2000 + o_orderkey % 30 AS STRING)"


@query(
    f"""SELECT o_orderkey, written, TRY_CAST(CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE (2000 + o_orderkey % 30)::VARCHAR || '-' || CASE o_orderkey % 4 WHEN 0 THEN '05' WHEN 1 THEN '04' ELSE '12' END || '-' ||
    lpad(CASE o_orderkey % 3 WHEN 0 THEN 1 + o_orderkey % 31 WHEN 1 THEN 1 + o_orderkey % 28 ELSE 31 END::VARCHAR, 2, '0') END AS DATE) AS day FROM (SELECT o_orderkey, {DATED} AS written FROM orders)"""
)
def date_in_words(t: Tables) -> DataFrame:
    return t.table("orders").selectExpr("o_orderkey", f"{DATED} AS written").withColumn("day", dates.written_date("written"))


@query("SELECT id, CASE lower(substr(trim(gender), 1, 1)) WHEN 'f' THEN 'F' WHEN 'm' THEN 'M' WHEN 'h' THEN 'M' END AS gender FROM athletes")
def gender_class(t: Tables) -> DataFrame:
    return t.athletes.select("id", status.gender_class("gender").alias("gender"))


@query(
    """WITH w AS (SELECT id, event_type FROM courses), s AS (SELECT id, event_type, CASE WHEN event_type LIKE 'course-a-pied%' THEN 'course-a-pied' WHEN event_type = 'bike-run' THEN 'bike-run' ELSE split_part(event_type, '-', 1) END AS sport FROM w)
    SELECT id, sport, CASE sport WHEN 'duathlon' THEN 'course1=00:10:00; bike=01:00:00; course2=00:30:00' WHEN 'bike-run' THEN 'segment1=00:10:00; bike=01:00:00; run=00:30:00'
    WHEN 'swimrun' THEN 'swim=00:10:00; segment2=01:00:00; run=00:30:00' WHEN 'course-a-pied' THEN 'run=00:30:00' WHEN 'trail' THEN 'run=00:30:00' ELSE 'swim=00:10:00; bike=01:00:00; run=00:30:00' END AS splits FROM s"""
)
def splits_from_slots(t: Tables) -> DataFrame:
    made = splits.slot_splits("event_type", swim=F.lit("00:10:00"), t1=F.lit(""), bike=F.lit("01:00:00"), t2=F.lit(None).cast("string"), run=F.lit("00:30:00"))
    return t.courses.select("id", splits.sport_of_slug("event_type").alias("sport"), splits.readable(made).alias("splits"))


@query("SELECT id, string_agg(label || '=' || format('{:02d}:{:02d}:{:02d}', seconds // 3600, seconds % 3600 // 60, seconds % 60), '; ' ORDER BY pos) AS splits FROM splits WHERE seconds IS NOT NULL AND id IN (SELECT id FROM parts) GROUP BY id")
def splits_from_segments(t: Tables) -> DataFrame:
    return t.timed_parts.select("id", splits.readable(splits.labelled_splits("splits")).alias("splits")).where("splits <> ''")


@query("SELECT id, lower(trim(coalesce(provider, ''))) NOT IN ('', 'manuel', 'other') AS detailed FROM sources")
def detailed_splits(t: Tables) -> DataFrame:
    return t.sources.select("id", disciplines.detailed_splits("provider", ("Other",)).alias("detailed"))
