"""Queries of rankings and segment statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import catalogue, ranking, stats
from paceline.plans.bindings import PARTS, SECONDS, SEGMENTS, Tables, query, select
from paceline.plans.listings import rows

TIMED = f"CASE WHEN coalesce(total_time, '') NOT IN ('', '00:00:00') THEN {SECONDS} END"
#: An event's segments in order of first appearance by rank; every ranked participation has every segment.
GRID = """f AS (SELECT p.course_id, p.id, p.rank_overall, s.pos, s.label, s.seconds FROM splits s JOIN parts p ON p.id = s.id WHERE p.rank_overall IS NOT NULL),
l AS (SELECT course_id, label, row_number() OVER (PARTITION BY course_id ORDER BY first_at) AS pos FROM (SELECT course_id, label, min((rank_overall, id, pos)) AS first_at FROM f GROUP BY 1, 2)),
who AS (SELECT DISTINCT course_id, id FROM f),
grid AS (SELECT w.course_id, w.id, l.label, l.pos, f.seconds FROM who w JOIN l ON l.course_id = w.course_id LEFT JOIN f ON f.id = w.id AND f.label = l.label),
c AS (SELECT *, CASE WHEN count(seconds) OVER u = count(*) OVER u THEN (sum(seconds) OVER u)::BIGINT END AS cumulative FROM grid
    WINDOW u AS (PARTITION BY course_id, id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


def timed(t: Tables) -> DataFrame:
    absent = F.coalesce("total_time", F.lit("")).isin("", "00:00:00")
    return t.parts.withColumn("seconds", F.when(~absent, catalogue.seconds()))


@query(f"SELECT id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY course_id, v IS NULL ORDER BY v) END AS rank FROM (SELECT id, course_id, {TIMED} AS v FROM parts)")
def rank_in_set(t: Tables) -> DataFrame:
    return ranking.rank_among(timed(t), "seconds", ["course_id"]).select("id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {GRID} SELECT course_id, id, label, pos, seconds, cumulative FROM c")
def cumulative_segments(t: Tables) -> DataFrame:
    out = ranking.segment_rows(t.dealt(t.parts, "id"), t.long_splits)
    return out.select("course_id", "id", "label", F.col("pos").cast("bigint").alias("pos"), "seconds", "cumulative")


@query(
    f"""WITH {GRID}, r AS (SELECT *, CASE WHEN cumulative IS NOT NULL THEN rank() OVER (PARTITION BY course_id, pos, cumulative IS NULL ORDER BY cumulative) END AS rc,
    CASE WHEN seconds IS NOT NULL THEN rank() OVER (PARTITION BY course_id, pos, seconds IS NULL ORDER BY seconds) END AS ri, pos = max(pos) OVER (PARTITION BY course_id) AS last FROM c)
    SELECT r.course_id, r.id, r.pos, (CASE WHEN r.last THEN coalesce(p.rank_overall, rc) ELSE rc END)::BIGINT AS rank_cumulative, ri AS rank_isolated FROM r JOIN parts p ON p.id = r.id
    WHERE (CASE WHEN r.last THEN coalesce(p.rank_overall, rc) ELSE rc END) IS NOT NULL AND ri IS NOT NULL"""
)
def rank_evolution(t: Tables) -> DataFrame:
    of = ranking.evolution(ranking.segment_rows(t.dealt(t.parts, "id"), t.long_splits), t.tasks)
    return of.select("course_id", "id", *(F.col(c).cast("bigint").alias(c) for c in ("pos", "rank_cumulative", "rank_isolated")))


@query(
    f"""WITH p AS MATERIALIZED ({select({c: PARTS[c] for c in ("id", "course_id", "rank_overall")}, "orders")}),
    s AS MATERIALIZED (SELECT id, label, min(seconds) AS seconds FROM ({select(SEGMENTS, "lineitem")}) GROUP BY id, label),
    k AS MATERIALIZED (SELECT p.course_id, p.id, p.rank_overall, s.label, s.seconds FROM s JOIN p ON p.id = s.id WHERE s.seconds > 0 AND NOT (s.label = 't1' AND s.seconds % 2 = 1)),
    a AS MATERIALIZED (SELECT course_id, label, rank_overall AS reference, arg_max(seconds, id) AS seconds FROM k WHERE rank_overall IN (1, 10, 25, 50, 100) GROUP BY course_id, label, rank_overall)
    SELECT k.course_id, k.id, k.label, a.reference, (1000 * k.seconds) // a.seconds AS thousandths FROM k JOIN a ON a.course_id = k.course_id AND a.label = k.label""",
    bare=True,
)
def reference_comparison(t: Tables) -> DataFrame:
    of = t.segments.where("NOT (label = 't1' AND seconds % 2 = 1)").join(t.parts.select("id", "course_id", "rank_overall"), "id")
    found = ranking.reference_comparison(of)
    return found.select("course_id", "id", "label", "reference", F.floor(F.col("seconds") * 1000 / F.col("reference_seconds")).alias("thousandths"))


@query(
    f"""WITH n AS (SELECT *, rank() OVER (PARTITION BY course_id ORDER BY total) AS place FROM (SELECT course_id, id, {TIMED} AS total FROM parts) WHERE total IS NOT NULL),
    t AS (SELECT n.course_id, n.id, s.label, g.gain, n.place, n.total * 1000 - s.seconds * g.gain AS v, 0 AS one FROM n JOIN splits s ON s.id = n.id, (SELECT unnest([5, 10, 20, 50, 100, 250]) AS gain) g WHERE s.seconds IS NOT NULL),
    u AS (SELECT * FROM t UNION ALL SELECT course_id, NULL, NULL, NULL, NULL, total * 1000, 1 FROM n),
    r AS (SELECT *, coalesce(sum(one) OVER (PARTITION BY course_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM u)
    SELECT course_id, id, label, gain, place, greatest(0, place - (1 + ahead)) AS places_won FROM r WHERE id IS NOT NULL"""
)
def improvement_whatif(t: Tables) -> DataFrame:
    totals = timed(t).select("course_id", "id", F.col("seconds").alias("total"))
    out = ranking.improvement(totals, t.segments.where("NOT (label = 't1' AND seconds % 2 = 1)"))
    return out.select("course_id", "id", "label", "gain", F.col("place").cast("bigint").alias("place"), F.col("places_won").cast("bigint").alias("places_won"))


@query(
    f"""WITH s AS (SELECT id, course_id, gender, category, {TIMED} AS v FROM shown WHERE lower(status) = 'finisher')
    SELECT id, row_number() OVER (PARTITION BY course_id ORDER BY v, id) AS place, row_number() OVER (PARTITION BY course_id, gender ORDER BY v, id) AS place_gender,
    row_number() OVER (PARTITION BY course_id, gender, category ORDER BY v, id) AS place_category FROM s WHERE v > 0"""
)
def er_ranks(t: Tables) -> DataFrame:
    of = rows(t).where(F.lower("status") == "finisher").withColumn("gender", F.col("athlete_gender"))
    of = of.withColumn("seconds", F.when(~catalogue.absent_time(), catalogue.seconds()))
    out = ranking.ranks_by_time(of, "seconds", ["course_id"], "id")
    return out.select("id", *(F.col(c).cast("bigint").alias(c) for c in ("place", "place_gender", "place_category")))


SIZED = (
    "z AS (SELECT course_id, is_relay, count(*) AS finishers FROM parts WHERE lower(status) = 'finisher' AND rank_overall IS NOT NULL AND NOT is_pending GROUP BY ALL), "
    "s AS (SELECT p.*, z.finishers, c.bad FROM parts p LEFT JOIN z ON z.course_id = p.course_id AND z.is_relay = p.is_relay "
    "JOIN (SELECT id AS cid, coalesce(reliability_override, is_reliable_computed) IS FALSE AS bad FROM courses) c ON c.cid = p.course_id)"
)


@query(
    f"""WITH {SIZED} SELECT id, CASE WHEN reason IS NULL THEN (rank_overall * 100 + finishers - 1) // finishers END AS percent, reason FROM (SELECT *, CASE WHEN bad THEN 'unreliable'
    WHEN rank_overall IS NULL THEN 'no_rank' WHEN rank_overall < 1 THEN 'bad_rank' WHEN finishers IS NULL OR finishers < 2 THEN 'too_few' WHEN rank_overall > finishers THEN 'beyond_total' END AS reason FROM s)"""
)
def rank_ratio(t: Tables) -> DataFrame:
    bad = t.courses.select(F.col("id").alias("course_id"), catalogue.reliable().eqNullSafe(F.lit(False)).alias("bad"))
    of = catalogue.with_group_sizes(t.parts).join(bad, "course_id")
    return of.select("id", ranking.rank_ratio("rank_overall", "finishers", "bad").alias("r")).select("id", "r.percent", "r.reason")


@query(
    f"""WITH {SIZED} SELECT athlete_id, id FROM s WHERE rank_overall >= 1 AND finishers >= 2 AND rank_overall <= finishers
    QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY (rank_overall * 1000000000000) // finishers, rank_overall, id) = 1"""
)
def best_ratio(t: Tables) -> DataFrame:
    return ranking.best_ratio(catalogue.with_group_sizes(t.parts)).select("athlete_id", "id")


POINTS = "SELECT l_orderkey AS race, l_suppkey AS runner, l_linenumber AS point, min(CAST(l_quantity AS BIGINT)) AS seg, min(CAST(l_extendedprice AS BIGINT)) AS cumulative FROM lineitem GROUP BY 1, 2, 3"


def points(t: Tables) -> DataFrame:
    """One row per passage, dealt by race once, which holds for all that follows."""
    of = t.table("lineitem").select(
        F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("runner"), F.col("l_linenumber").alias("point"),
        F.bround("l_quantity").cast("bigint").alias("segment"), F.bround("l_extendedprice").cast("bigint").alias("cumulative"),
    )
    return t.dealt(of, "race").groupBy("race", "runner", "point").agg(F.min("segment").alias("segment"), F.min("cumulative").alias("cumulative"))


@query(
    f"WITH p AS ({POINTS}), m AS (SELECT race, max(point) AS final_point FROM p GROUP BY race) "
    "SELECT p.race, p.runner, m.final_point, max(CASE WHEN p.point = m.final_point THEN p.cumulative END) AS final FROM p JOIN m ON m.race = p.race GROUP BY 1, 2, 3"
)
def final_passages(t: Tables) -> DataFrame:
    return ranking.final_passages(points(t))


@query(
    f"SELECT race, point, runner, CASE WHEN gap > 0 THEN gap END AS dead FROM (SELECT race, point, runner, cumulative - seg - lag(cumulative) OVER (PARTITION BY race ORDER BY point, runner) AS gap FROM ({POINTS}))"
)
def dead_time_lag(t: Tables) -> DataFrame:
    return ranking.dead_times(points(t), ["race"], ["point", "runner"]).select("race", "point", "runner", "dead")


@query(
    """WITH e AS (SELECT user_id, event_id, CAST(floor(value * 10) AS BIGINT) % 7 AS v, ts FROM events),
    s AS (SELECT *, CASE WHEN v > 0 THEN v END - coalesce(last_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM e),
    f AS (SELECT *, coalesce(min(step) OVER (PARTITION BY user_id) < 0, FALSE) AS falling FROM s)
    SELECT user_id, event_id, falling, CASE WHEN falling THEN CASE WHEN v > 0 THEN v END ELSE step END AS duration FROM f"""
)
def cumulative_to_durations(t: Tables) -> DataFrame:
    of = t.table("events").withColumn("cumulative", F.floor(F.col("value") * 10) % 7)
    return ranking.durations(of, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "falling", "duration")


@query(f"SELECT course_id, count(*) AS n, min({TIMED}) AS best, max({TIMED}) AS worst FROM parts GROUP BY course_id")
def time_range(t: Tables) -> DataFrame:
    return timed(t).groupBy("course_id").agg(F.count("*").alias("n"), F.min("seconds").alias("best"), F.max("seconds").alias("worst"))


@query("SELECT id, count(*) FILTER (seconds IS NOT NULL) AS n FROM splits WHERE id IN (SELECT id FROM parts) GROUP BY id")
def splits_per_participation(t: Tables) -> DataFrame:
    return t.timed_parts.select("id", F.size(F.filter("splits", lambda s: s["time"] != "")).cast("bigint").alias("n"))


@query(
    """WITH k AS (SELECT p.course_id, s.label, min((p.rank_overall, p.id, s.pos)) AS first_at FROM splits s JOIN parts p ON p.id = s.id WHERE p.rank_overall IS NOT NULL GROUP BY 1, 2)
    SELECT course_id, string_agg(label, ',' ORDER BY first_at) AS keys FROM k GROUP BY course_id"""
)
def published_segments(t: Tables) -> DataFrame:
    ranked = t.timed_parts.where("rank_overall IS NOT NULL").withColumn("ranking", F.struct("rank_overall", "id"))
    return stats.split_keys(ranked, ["course_id"], "ranking", with_empty=True).select("course_id", F.array_join("keys", ",").alias("keys"))
