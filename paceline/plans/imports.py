"""Queries of imports: matching, merging, fusion, sources, freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import freshness, upsert
from paceline.plans.bindings import TODAY, Tables, query

#: The stored half of orders, and a feed that repeats much of it with some values gone or new; one text for both engines.
STORED = "id % 3 <> 0"
FEED = {
    "course_id": "course_id",
    "athlete_id": "athlete_id",
    "bib_number": "bib_number",
    "status": "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'DSQ' ELSE status END",
    "total_time": "CASE WHEN id % 4 = 0 THEN '' ELSE total_time END",
    "club": "CASE WHEN id % 7 = 0 THEN 'Nouveau Club' WHEN id % 2 = 0 THEN '' ELSE club END",
    "rank_overall": "CASE WHEN id % 6 = 0 THEN NULL ELSE rank_overall END",
    "seq": "id",
}
#: Bibs are unique in what is stored.
FIRST_BIB = "row_number() OVER (PARTITION BY course_id, bib_number ORDER BY id) = 1 OR coalesce(bib_number, '') = ''"
FEED_SQL = f"SELECT {', '.join(f'{e} AS {c}' for c, e in FEED.items())} FROM parts WHERE id % 2 = 0"
SETUP = f"""stored AS (SELECT * FROM parts WHERE {STORED} QUALIFY {FIRST_BIB}), feed AS ({FEED_SQL}),
a AS (SELECT f.*, nullif(f.bib_number, '') AS bib FROM feed f),
b AS (SELECT a.*, row_number() OVER (PARTITION BY course_id, bib ORDER BY seq) AS n FROM a WHERE bib IS NOT NULL),
c AS (SELECT b.*, s.id AS sid FROM b LEFT JOIN stored s ON s.course_id = b.course_id AND s.bib_number = b.bib),
u AS (SELECT course_id, athlete_id, count(*) AS there, min(id) AS sid FROM stored WHERE coalesce(bib_number, '') = '' GROUP BY 1, 2),
e AS (SELECT a.*, row_number() OVER (PARTITION BY a.course_id, a.athlete_id ORDER BY seq) AS n, coalesce(u.there, 0) AS there, u.sid FROM a LEFT JOIN u ON u.course_id = a.course_id AND u.athlete_id = a.athlete_id WHERE a.bib IS NULL),
plan AS (SELECT seq, course_id, athlete_id, bib_number, status, total_time, club, rank_overall, CASE WHEN n > 1 THEN 'repeat' WHEN sid IS NOT NULL THEN 'update' ELSE 'insert' END AS action, CASE WHEN n = 1 THEN sid END AS stored_id FROM c
    UNION ALL SELECT seq, course_id, athlete_id, bib_number, status, total_time, club, rank_overall, CASE WHEN there = 1 AND n = 1 THEN 'update' WHEN n <= there THEN 'skip' ELSE 'insert' END, CASE WHEN there = 1 AND n = 1 THEN sid END FROM e),
m AS (SELECT s.id, s.course_id, s.athlete_id, s.bib_number, coalesce(nullif(p.total_time, ''), s.total_time) AS total_time, coalesce(nullif(p.club, ''), s.club) AS club, coalesce(p.rank_overall, s.rank_overall) AS rank_overall,
    CASE WHEN p.seq IS NULL THEN s.status WHEN coalesce(p.status, '') <> '' THEN p.status WHEN coalesce(nullif(p.total_time, ''), s.total_time, '') <> '' THEN 'finisher' ELSE 'DNF' END AS status,
    s.total_time AS ot, s.club AS oc, s.rank_overall AS orank, s.status AS os FROM stored s LEFT JOIN plan p ON p.action = 'update' AND p.stored_id = s.id),
snapshot AS (SELECT id, course_id, athlete_id, bib_number, total_time, club, rank_overall, status,
    CASE WHEN (total_time, club, rank_overall, status) IS DISTINCT FROM (ot, oc, orank, os) THEN 'update' ELSE 'keep' END AS action FROM m
    UNION ALL SELECT NULL, course_id, athlete_id, bib_number, total_time, club, rank_overall, CASE WHEN coalesce(status, '') <> '' THEN status WHEN coalesce(total_time, '') <> '' THEN 'finisher' ELSE 'DNF' END, 'insert' FROM plan WHERE action = 'insert')"""
FIELDS = ["total_time", "club", "rank_overall"]


def stored(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("course_id", "bib_number").orderBy("id")) == 1
    return t.parts.where(STORED).withColumn("_first", first).where(F.col("_first") | (F.coalesce("bib_number", F.lit("")) == "")).drop("_first")


def feed(t: Tables) -> DataFrame:
    return t.parts.where("id % 2 = 0").selectExpr(*(f"{e} AS {c}" for c, e in FEED.items()))


@query(f"WITH {SETUP} SELECT seq, action, stored_id FROM plan")
def multiset_match(t: Tables) -> DataFrame:
    return upsert.matched(stored(t), feed(t)).select("seq", "action", "stored_id")


@query(f"WITH {SETUP} SELECT * FROM snapshot")
def upsert_snapshot(t: Tables) -> DataFrame:
    return upsert.upsert(stored(t), feed(t), FIELDS)


@query(f"WITH {SETUP} SELECT count(*) FILTER (action = 'insert') AS imported, count(*) FILTER (action = 'update') AS updated, (SELECT count(*) FROM plan) - count(*) FILTER (action IN ('insert', 'update')) AS skipped FROM snapshot")
def import_counts(t: Tables) -> DataFrame:
    return upsert.import_counts(upsert.matched(stored(t), feed(t)), upsert.upsert(stored(t), feed(t), FIELDS))


@query(
    "SELECT id, CASE WHEN id % 4 = 0 THEN club ELSE coalesce(nullif(CASE WHEN id % 7 = 0 THEN 'X' WHEN id % 2 = 0 THEN '' ELSE category END, ''), club) END AS club, "
    "CASE WHEN id % 3 = 0 THEN 'DSQ' WHEN coalesce(total_time, '') <> '' THEN 'finisher' ELSE 'DNF' END AS status FROM parts"
)
def cautious_merge(t: Tables) -> DataFrame:
    new = F.when(F.col("id") % 4 != 0, F.when(F.col("id") % 7 == 0, F.lit("X")).when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.col("category")))
    said = F.when(F.col("id") % 3 == 0, F.lit("DSQ"))
    return t.parts.select("id", upsert.merged_value("club", new).alias("club"), upsert.merged_status("total_time", said, F.lit("")).alias("status"))


@query(
    """WITH r AS (SELECT *, status IN ('DNF', 'DNS', 'DSQ') AS stopped, coalesce(total_time, '') <> '' AS timed,
        (coalesce(club, '') <> '')::INT + (coalesce(category, '') <> '')::INT + (coalesce(total_time, '') <> '')::INT + (coalesce(bib_number, '') <> '')::INT AS rich FROM parts),
    f AS (SELECT course_id, bib_number, count(*)::INT AS listed, list_reduce(list({'id': id, 'athlete_id': athlete_id, 'club': club, 'category': category, 'stopped': stopped, 'timed': timed, 'rich': rich} ORDER BY id),
        lambda old, new: CASE WHEN CASE WHEN new.stopped AND NOT old.timed THEN TRUE WHEN old.stopped AND NOT new.timed THEN FALSE WHEN new.timed <> old.timed THEN new.timed ELSE new.rich > old.rich END THEN new ELSE old END) AS held
        FROM r GROUP BY 1, 2)
    SELECT course_id, bib_number, held.id AS id, held.athlete_id AS athlete_id, held.club AS club, held.category AS category, listed FROM f"""
)
def feed_fusion_prefer(t: Tables) -> DataFrame:
    """The rule depends on the order of rows: SQL folds a list by the same rule, and a test holds it against a plain loop."""
    rich = upsert.richness(["club", "category", "total_time", "bib_number"])
    of = t.parts.withColumn("seq", F.col("id"))
    return upsert.fuse(of, ["course_id", "bib_number"], ["id", "athlete_id", "club", "category"], rich)


@query(
    """WITH k AS (SELECT *, athlete_id || '-' || bib_number AS bib FROM parts),
    p AS (SELECT *, count(*) OVER (PARTITION BY bib) AS n FROM k WHERE NOT is_pending),
    h AS (SELECT bib AS b, club AS c, category AS k FROM k WHERE is_pending QUALIFY count(*) OVER (PARTITION BY bib) = 1)
    SELECT p.id, coalesce(nullif(p.club, ''), h.c, p.club) AS club, coalesce(nullif(p.category, ''), h.k, p.category) AS category FROM p LEFT JOIN h ON h.b = p.bib AND p.n = 1"""
)
def fill_gaps(t: Tables) -> DataFrame:
    """All published rows filled from all pending ones; a bib is an athlete's own, as there are but 60 numbers."""
    of = t.parts.withColumn("bib_number", F.concat(F.col("athlete_id").cast("string"), F.lit("-"), "bib_number"))
    return upsert.fill_gaps(of.where("NOT is_pending"), of.where("is_pending"), "course_id", "bib_number", ["club", "category"]).select("id", "club", "category")


@query(
    "WITH f AS (SELECT id, name, event_date, CASE WHEN id % 5 = 0 THEN 'raid-multisport' ELSE event_type END AS event_type, is_relay FROM courses WHERE id % 2 = 0) "
    "SELECT DISTINCT name, event_date, event_type, is_relay FROM f WHERE NOT EXISTS (SELECT 1 FROM courses c WHERE c.name = f.name AND c.event_date IS NOT DISTINCT FROM f.event_date AND c.event_type = f.event_type AND c.is_relay = f.is_relay)"
)
def new_courses(t: Tables) -> DataFrame:
    of = t.courses.where("id % 2 = 0").withColumn("event_type", F.when(F.col("id") % 5 == 0, F.lit("raid-multisport")).otherwise(F.col("event_type")))
    return upsert.new_courses(of, t.courses)


RECLASS = """WITH f AS (SELECT s.url, c.name, c.event_date, c.is_relay, CASE WHEN c.id % 2 = 0 THEN 'raid-multisport' ELSE c.event_type END AS event_type FROM courses c JOIN sources s ON s.course_id = c.id),
o AS (SELECT url, name, event_date, is_relay, min(event_type) AS event_type FROM f GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT event_type) = 1)
SELECT c.id AS course_id, o.event_type FROM o JOIN sources s ON s.url = o.url AND s.is_active JOIN courses c ON c.id = s.course_id AND c.name = o.name AND c.event_date IS NOT DISTINCT FROM o.event_date AND c.is_relay = o.is_relay
WHERE c.event_type <> o.event_type AND NOT EXISTS (SELECT 1 FROM courses d WHERE d.name = o.name AND d.event_date IS NOT DISTINCT FROM o.event_date AND d.event_type = o.event_type AND d.is_relay = o.is_relay)"""


@query(RECLASS)
def reclassify_batch(t: Tables) -> DataFrame:
    own = t.sources.select("url", "course_id")
    of = t.courses.join(own, F.col("id") == F.col("course_id")).select(
        "url", "name", "event_date", "is_relay", F.when(F.col("id") % 2 == 0, F.lit("raid-multisport")).otherwise(F.col("event_type")).alias("event_type")
    )
    return upsert.reclassify(of, t.courses, t.sources)


@query(
    "WITH g AS (SELECT course_id FROM sources WHERE id = 30) SELECT s.id, s.course_id, CASE WHEN g.course_id IS NULL THEN s.is_active ELSE s.id = 30 END AS is_active FROM sources s LEFT JOIN g ON g.course_id = s.course_id"
)
def active_source_switch(t: Tables) -> DataFrame:
    return upsert.activate_source(t.sources, 30).select("id", "course_id", "is_active")


@query(
    """WITH old AS (SELECT * FROM sources WHERE id % 3 <> 0), n AS (SELECT DISTINCT ON (course_id, url) course_id, url, created_at FROM (SELECT * FROM sources WHERE id % 2 = 0) x
    WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.course_id = x.course_id AND old.url = x.url) ORDER BY course_id, url, id),
    b AS (SELECT course_id, url, created_at, is_active FROM old UNION ALL SELECT course_id, url, created_at, FALSE FROM n)
    SELECT course_id, url, is_active OR (NOT bool_or(is_active) OVER (PARTITION BY course_id) AND row_number() OVER (PARTITION BY course_id ORDER BY created_at, url) = 1) AS is_active FROM b"""
)
def attach_sources(t: Tables) -> DataFrame:
    out = upsert.attach_source(t.sources.where("id % 3 <> 0"), t.sources.where("id % 2 = 0").select("course_id", "url", "provider", "created_at"))
    return out.select("course_id", "url", "is_active")


NOW = dt.datetime.fromisoformat(TODAY)
OPEN = "(SELECT course_id, bool_or(coalesce(total_time, '') = '') AS untimed FROM parts GROUP BY course_id)"
FRESH = f"SELECT c.id, c.scraped_at, coalesce(o.untimed, FALSE) AS untimed, coalesce(c.scraped_at > CASE WHEN coalesce(o.untimed, FALSE) THEN TIMESTAMP '2024-02-05' ELSE TIMESTAMP '2024-01-16' END, FALSE) AS fresh FROM courses c LEFT JOIN {OPEN} o ON o.course_id = c.id"


@query(FRESH)
def ttl_freshness(t: Tables) -> DataFrame:
    return freshness.fresh_courses(t.courses, t.parts, NOW, dt.timedelta(days=10), dt.timedelta(days=30))


@query(
    f"""WITH fr AS ({FRESH.replace("TIMESTAMP '2024-02-05'", "TIMESTAMP '2024-02-14 23:50:00'")}), o AS (SELECT s.url, s.course_id, c.scraped_at FROM sources s JOIN courses c ON c.id = s.course_id),
    l AS (SELECT url, course_id FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC NULLS LAST, course_id DESC) = 1),
    k AS (SELECT l.url FROM l JOIN fr ON fr.id = l.course_id AND fr.fresh), n AS (SELECT course_id, count(*) AS n FROM parts GROUP BY 1)
    SELECT o.url, coalesce(sum(n.n), 0)::BIGINT AS skipped FROM o JOIN k ON k.url = o.url LEFT JOIN n ON n.course_id = o.course_id GROUP BY o.url"""
)
def cached_skip_counts(t: Tables) -> DataFrame:
    return freshness.cached_skips(t.courses, t.sources, t.parts, NOW)


@query(
    """WITH v AS (SELECT id, course_id, 'https://x.example/' || (id % 60)::VARCHAR AS url, is_active FROM sources), a AS (SELECT course_id, url AS active FROM v WHERE is_active),
    k AS (SELECT v.url, bool_or(v.is_active) AS ia, min(a.active) AS active FROM v LEFT JOIN a ON a.course_id = v.course_id GROUP BY v.url),
    l AS (SELECT 'https://X.example/' || n::VARCHAR || '/' AS url, 'https://x.example/' || n::VARCHAR AS key FROM range(0, 80) r(n))
    SELECT l.url, CASE WHEN k.ia IS FALSE AND k.active IS NOT NULL THEN k.active ELSE l.url END AS target FROM l LEFT JOIN k ON k.url = l.key"""
)
def passive_redirect(t: Tables) -> DataFrame:
    known = t.sources.withColumn("url", F.concat(F.lit("https://x.example/"), (F.col("id") % 60).cast("string")))
    links = t.spark.range(80).select(F.concat(F.lit("https://X.example/"), F.col("id").cast("string"), F.lit("/")).alias("url"))
    return freshness.passive_targets(links, known)


@query("SELECT count(*) AS items, sum(id % 7)::BIGINT AS imported, sum(id % 5)::BIGINT AS updated, sum(id % 3)::BIGINT AS skipped, count(*) FILTER (id % 9 = 0) AS errors, FALSE AS all_failed FROM sources")
def batch_totals(t: Tables) -> DataFrame:
    of = t.sources.select(*((F.col("id") % k).alias(c) for c, k in (("imported", 7), ("updated", 5), ("skipped", 3))), F.when(F.col("id") % 9 == 0, F.lit("timeout")).alias("error"))
    return freshness.batch_totals(of)


@query("SELECT count(*) FILTER (regexp_matches(trim(url), '^https?://')) AS links, count(*) FILTER (NOT regexp_matches(trim(url), '^https?://')) AS others FROM pages")
def link_counts(t: Tables) -> DataFrame:
    return freshness.link_counts(t.table("pages"), "url")


@query("WITH l AS (SELECT page_id AS seq, regexp_replace(url, '[?#].*$', '') AS url FROM pages), k AS (SELECT *, regexp_replace(url, '/+$', '') AS key FROM l) SELECT seq, url FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1")
def url_normalize_dedupe(t: Tables) -> DataFrame:
    of = t.table("pages").select(F.col("page_id").alias("seq"), F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    return freshness.deduped(freshness.links_of(of, "url"))
