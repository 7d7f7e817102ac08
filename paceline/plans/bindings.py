"""The race-results tables made of the driver's tables, once for Spark and once for the oracle.

The expressions below are read alike by both engines, so each column is stated once. What a query then does with
the columns is written separately: with the operators of this package on one side, in SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.splits import SPLITS
from paceline.functions.times import format_seconds

#: Labels of the club that club queries are about, in comparable form, and its name.
CLUB_LABELS, CLUB_NAME = ("tri club", "tc"), "Tri Club"
PLATFORMS = ("plata", "platb")
#: Rows of a table for each task after `Tables.dealt`, so that a task's memory doesn't grow with the table.
TASK_ROWS = 500_000
#: The day that queries take for today.
TODAY = "2024-02-15"

ATHLETES = {
    "id": "c_custkey",
    "last_name": "CASE WHEN c_custkey % 97 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN 'LEMÉE ' || CAST(c_custkey % 50 AS STRING) ELSE c_name END",
    "first_name": "CASE c_custkey % 4 WHEN 0 THEN 'Zoé' WHEN 1 THEN 'anne' WHEN 2 THEN 'Jean-Luc' ELSE '' END",
    "gender": "CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'f' WHEN 3 THEN ' H' END",
    "birth_date": "CASE WHEN c_custkey % 3 <> 0 THEN CAST('1970-01-01' AS DATE) + CAST(c_custkey % 9000 AS INT) END",
    "club": "c_mktsegment",
    "club_locked": "c_custkey % 13 = 0",
    "created_at": "CAST('2020-01-01' AS DATE) + CAST(c_custkey % 700 AS INT)",
}
COURSES = {
    "id": "p_partkey",
    "name": "CASE p_partkey % 4 WHEN 0 THEN '5e Triathlon de ' || p_name || ' ' || CAST(2015 + p_partkey % 8 AS STRING) WHEN 1 THEN 'Triathlon de ' || p_name ELSE p_name END",
    "event_date": "CASE WHEN p_partkey % 19 <> 0 THEN CAST('2016-01-01' AS DATE) + CAST((p_partkey * 37) % 1500 AS INT) END",
    "event_type": "CASE p_type WHEN 'ECONOMY' THEN 'triathlon-m' WHEN 'PROMO' THEN 'trail' WHEN 'LARGE' THEN 'swimrun-l' WHEN 'MEDIUM' THEN 'duathlon-s' WHEN 'SMALL' THEN 'bike-run' ELSE 'course-a-pied-10k' END",
    "is_relay": "p_size % 9 = 0",
    "distance_km": "CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) END",
    "is_reliable_computed": "CASE p_size % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "reliability_override": "CASE p_size % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "scraped_at": "CASE WHEN p_partkey % 11 <> 0 THEN CAST('2024-01-01' AS DATE) + CAST(p_partkey % 60 AS INT) END",
}
CLOCK = "3000 + CAST(floor(o_totalprice / 40) AS BIGINT)"
TWO = "lpad(CAST({} AS STRING), 2, '0')"
PARTS = {
    "id": "o_orderkey",
    "athlete_id": "o_custkey",
    "course_id": "(o_orderkey * 7) % 400",
    "club": "CASE o_custkey % 6 WHEN 0 THEN 'Tri Club' WHEN 1 THEN '  tri \tCLUB ' WHEN 2 THEN 'Tri Club Sud' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'AS ' || CAST(o_custkey % 23 AS STRING) END",
    "category": "CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END",
    "bib_number": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_orderkey % 60 AS STRING) END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'finisher' WHEN 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'dnf' WHEN 1 THEN 'DNS' WHEN 2 THEN 'DSQ' ELSE 'Finisher' END ELSE 'Abandon' END",
    "total_time": (
        "CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderkey % 31 = 0 THEN '00:00:00' WHEN o_orderkey % 37 = 0 THEN NULL ELSE "
        + " || ':' || ".join(TWO.format(x) for x in (f"CAST(floor(({CLOCK}) / 3600) AS INT)", f"CAST(floor((({CLOCK}) % 3600) / 60) AS INT)", f"({CLOCK}) % 60"))
        + " END"
    ),
    "rank_overall": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 40 AS INT) END",
    "rank_category": "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 12 AS INT) END",
    "rank_gender": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 21 AS INT) END",
    "is_relay": "o_orderkey % 11 = 0",
    "is_pending": "o_orderkey % 17 = 0",
    "is_rejected": "o_orderkey % 34 = 0",
    "created_at": "o_orderdate",
}
EVENT_KEY = "CAST(1517534975000 + page_id % 30 AS STRING) || '-' || CAST(page_id % 2 AS STRING)"
SOURCES = {
    "id": "page_id",
    "course_id": "(page_id * 3) % 400",
    "url": (
        f"CASE page_id % 3 WHEN 0 THEN 'https://www.plata.example/resultats/evt/' || {EVENT_KEY} || '?heat=M' || CAST(page_id % 4 AS STRING) "
        f"WHEN 1 THEN 'https://live.platb.example/resultats-courses/evt-' || {EVENT_KEY} || '/M' || CAST(page_id % 4 AS STRING) ELSE url END"
    ),
    "provider": "CASE page_id % 3 WHEN 0 THEN 'plata' WHEN 1 THEN 'platb' ELSE 'other' END",
    "is_active": "page_id % 2 = 0 AND page_id < 400",
    "created_at": "CAST('2023-01-01' AS DATE) + CAST(page_id % 300 AS INT)",
}
LABEL = "CASE l_linenumber WHEN 1 THEN 'swim' WHEN 2 THEN 't1' WHEN 3 THEN 'bike' WHEN 4 THEN 't2' WHEN 5 THEN 'run' ELSE 'seg' || CAST(l_linenumber AS STRING) END"
SEGMENTS = {"id": "l_orderkey", "pos": "l_linenumber", "label": LABEL, "seconds": "CAST(l_quantity AS BIGINT) * 60 + l_linenumber"}


class Tables:
    """The driver's tables in one folder, and the race-results tables on top of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def bound(self, name: str, columns: dict[str, str]) -> DataFrame:
        return self.table(name).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))

    @cached_property
    def tasks(self) -> int:
        """Tasks that share the rows of ``lineitem``, the largest table; its rows are counted from the files' footers."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // TASK_ROWS))

    def dealt(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` by ``by`` in as many parts as the rows ask for: partitions by size in bytes hold many rows of narrow columns, as these shrink much when they are packed."""
        return df.repartition(self.tasks, *by)

    @property
    def athletes(self) -> DataFrame:
        return self.bound("customer", ATHLETES)

    @property
    def courses(self) -> DataFrame:
        return self.bound("part", COURSES)

    @property
    def parts(self) -> DataFrame:
        return self.bound("orders", PARTS)

    @property
    def sources(self) -> DataFrame:
        return self.bound("pages", SOURCES)

    @property
    def segments(self) -> DataFrame:
        """One row per participation and segment: repeated line numbers of an order are one. Dealt by participation once, which holds for all that follows."""
        return self.dealt(self.bound("lineitem", SEGMENTS), "id").groupBy("id", "pos", "label").agg(F.min("seconds").alias("seconds"))

    @property
    def long_splits(self) -> DataFrame:
        """`segments` with the times that splits have: null for ``t1`` of odd length."""
        return self.segments.withColumn("seconds", F.when((F.col("label") != "t1") | (F.col("seconds") % 2 == 0), F.col("seconds")))

    @property
    def timed_parts(self) -> DataFrame:
        """Participations with their splits, those of odd length of time without a time for ``t1``."""
        time = F.when((F.col("label") == "t1") & (F.col("seconds") % 2 == 1), F.lit("")).otherwise(format_seconds("seconds"))
        of = self.segments.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", time.alias("time")))).alias("s"))
        of = of.select("id", F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["time"].alias("time"))).cast(SPLITS).alias("splits"))
        return self.parts.join(of, "id")


def select(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


CLEAN_CLUB = "regexp_replace(lower(trim(translate(club, chr(9) || chr(10) || chr(13) || chr(160), '    '))), ' {2,}', ' ', 'g')"
IS_CLUB = f"coalesce({CLEAN_CLUB} IN ('tri club', 'tc'), FALSE)"
SECONDS = "(split_part(total_time, ':', 1)::BIGINT * 3600 + split_part(total_time, ':', 2)::BIGINT * 60 + split_part(total_time, ':', 3)::BIGINT)"
SEASON = "(year(event_date) - (month(event_date) < 9)::INT)::BIGINT"
STATUS_CLASS = "CASE WHEN lower(trim(coalesce(status, ''))) IN ('finisher', 'dnf', 'dns', 'dsq') THEN lower(trim(status)) ELSE 'unknown' END"
WITH = f"""WITH athletes AS ({select(ATHLETES, 'customer')}), courses AS ({select(COURSES, 'part')}),
parts AS ({select(PARTS, 'orders')}), sources AS ({select(SOURCES, 'pages')}),
segments AS (SELECT id, pos, label, min(seconds) AS seconds FROM ({select(SEGMENTS, 'lineitem')}) GROUP BY ALL),
splits AS (SELECT id, pos, label, CASE WHEN label = 't1' AND seconds % 2 = 1 THEN NULL ELSE seconds END AS seconds FROM segments),
joined AS (SELECT p.*, c.name AS course_name, c.event_date AS event_date, c.event_type AS event_type, c.is_relay AS course_relay, c.distance_km AS course_km,
    a.last_name AS last_name, a.first_name AS first_name, a.gender AS gender, a.club AS athlete_club
    FROM parts p JOIN courses c ON p.course_id = c.id JOIN athletes a ON p.athlete_id = a.id),
shown AS (SELECT * FROM joined WHERE is_pending IS NOT DISTINCT FROM FALSE),
"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, bare: bool = False) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query and its oracle, a SELECT over the tables above; ``bare`` for one that brings everything itself."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            own = body[5:] if body.upper().startswith("WITH ") else f"result AS ({body}) SELECT * FROM result"
            ORACLE[f.__name__] = body if bare else f"{WITH}{own}"
        return f

    return keep
