"""Queries of landed documents and of the rows made of them.

The documents are written here from the race tables, as a service would publish them, and are parsed by the operators;
the SQL gives the rows that they were written from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.times import to_seconds
from paceline.operators import rows
from paceline.plans.bindings import Tables, query
from paceline.runtime import ship
from paceline.sources import landed

PAGE = 10
#: Participations of a course in one document: those whose ids share this quotient.
CHUNK = "CAST(floor(id / 40000) AS INT)"
XOR_KEY = 90


def faulty(body: Column, course: str, page: str) -> Column:
    """Bodies of a page as it landed: one course in 13 has its first page twice, one in 17 lacks the second, one in 19 has a first page that is cut short."""
    c, first = F.col(course), F.col(page) == 0
    copies = F.when((c % 17 == 0) & (F.col(page) == 1), F.array().cast("array<string>")).when(first & (c % 19 == 0), F.array(F.substring(body, 1, 20)))
    return F.explode(copies.when(first & (c % 13 == 0), F.array(body, body)).otherwise(F.array(body))).alias("body")


OWNER = "split_part(source, '/', 1)"
#: Pages of a course and their number; whether the faults above hit it. A course's first page has ``f`` rows.
PAGED = f"""WITH n AS (SELECT course_id, count(*) AS n, least(count(*), {PAGE}) AS f, (count(*) - 1) // {PAGE} + 1 AS pages FROM parts GROUP BY 1),
faults AS (SELECT *, course_id % 13 = 0 AND course_id % 19 <> 0 AS twice, course_id % 17 = 0 AND pages > 1 AS hole, course_id % 19 = 0 AS cut FROM n)
"""


def page_documents(t: Tables) -> DataFrame:
    """Numbered pages of each course; one course in seven announces a row too many, one in eleven has no last page, and `faulty` ones."""
    at = Window.partitionBy("course_id").orderBy("id")
    numbered = t.parts.select("course_id", "id", "bib_number", F.row_number().over(at).alias("n"))
    ends = numbered.groupBy("course_id").agg(F.max("n").alias("most"))
    pages = numbered.groupBy("course_id", F.expr(f"CAST((n - 1) DIV {PAGE} AS INT)").alias("page")).agg(F.collect_list(F.struct("id", F.col("bib_number").alias("bib"))).alias("content"))
    last = (F.col("page") == F.expr(f"(most - 1) DIV {PAGE}")) & (F.col("course_id") % 11 != 0)
    announced = F.col("most") + F.when(F.col("course_id") % 7 == 0, 1).otherwise(0)
    body = F.to_json(F.struct(F.col("course_id").alias("race"), "page", last.alias("last"), announced.alias("announced"), "content"))
    return pages.join(ends, "course_id").select(F.concat_ws("/", "course_id", "page").alias("source"), faulty(body, "course_id", "page"))


@query(PAGED + "SELECT p.course_id AS race, id, bib_number AS bib FROM parts p JOIN faults USING (course_id) WHERE course_id % 7 <> 0 AND course_id % 11 <> 0 AND NOT twice AND NOT hole AND NOT cut")
def json_pages(t: Tables) -> DataFrame:
    return landed.rows_of_complete(landed.numbered_pages(page_documents(t), "id bigint, bib string", OWNER))


@query(
    PAGED
    + f"""SELECT course_id AS race, n + twice::INT * f - cut::INT * f - hole::INT * least(n - f, {PAGE}) AS n_read, n + (course_id % 7 = 0)::INT AS n_announced,
    course_id % 7 <> 0 AND course_id % 11 <> 0 AND NOT twice AND NOT hole AND NOT cut AS complete FROM faults
    WHERE pages - cut::INT - hole::INT > 0"""
)
def page_completeness(t: Tables) -> DataFrame:
    return landed.completeness(landed.numbered_pages(page_documents(t), "id bigint, bib string", OWNER))


@query(PAGED + "SELECT course_id AS edition, id AS rid, bib_number AS bib FROM parts JOIN faults USING (course_id) WHERE course_id % 11 <> 0 AND NOT twice AND NOT cut AND NOT (course_id % 17 = 0 AND (pages > 1 OR n >= 5))")
def linked_pages(t: Tables) -> DataFrame:
    """Every fifth row comes again on the page after its own; one edition in eleven never ends; `faulty` ones."""
    n = F.row_number().over(Window.partitionBy("course_id").orderBy("id"))
    of = t.parts.select("course_id", F.col("id").alias("rid"), F.col("bib_number").alias("bib"), n.alias("n"))
    of = of.withColumn("page", F.expr(f"CAST((n - 1) DIV {PAGE} AS INT)"))
    again = of.unionByName(of.where("n % 5 = 0").withColumn("page", F.col("page") + 1))
    pages = again.groupBy("course_id", "page").agg(F.collect_list(F.struct("rid", "bib")).alias("value"))
    most = pages.groupBy("course_id").agg(F.max("page").alias("most"))
    final = (F.col("page") == F.col("most")) & (F.col("course_id") % 11 != 0)
    link = F.when(~final, F.concat(F.lit("next-"), (F.col("page") + 1).cast("string")))
    body = F.to_json(F.struct(F.col("course_id").alias("edition"), "page", "value", link.alias("@odata.nextLink")))
    docs = pages.join(most, "course_id").select(F.concat_ws("/", "course_id", "page").alias("source"), faulty(body, "course_id", "page"))
    return landed.linked_pages(docs, "rid bigint, bib string", "rid", OWNER)


@query("SELECT count(*) AS documents, count(*) FILTER (id % 5 = 0) AS failed FROM sources")
def failures_kept(t: Tables) -> DataFrame:
    """One document in five is cut short; the others are read, and the failures are known."""
    body = F.when(F.col("id") % 5 == 0, F.concat(F.lit('{"id": '), F.col("id").cast("string"))).otherwise(F.to_json(F.struct("id", "url")))
    docs = t.sources.select(F.col("id").alias("source"), body.alias("body"))
    return landed.json_documents(docs, "id bigint, url string").agg(F.count("*").alias("documents"), F.count_if("failed").alias("failed"))


@query(
    "SELECT p.course_id AS course, CAST(p.id AS STRING) AS bib, count(s.seconds) AS n_splits, sum(s.seconds)::BIGINT AS seconds FROM parts p JOIN segments s ON s.id = p.id GROUP BY 1, 2, p.id"
)
def nested_event(t: Tables) -> DataFrame:
    points = t.segments.groupBy("id").agg(F.collect_list(F.struct("label", "seconds")).alias("points"))
    runner = F.struct(F.col("id").cast("string").alias("bib"), F.col("club").alias("name"), "points")
    courses = t.parts.join(points, "id").groupBy("course_id", F.expr(CHUNK).alias("chunk")).agg(F.collect_list(runner).alias("runners"))
    docs = courses.select(F.col("course_id").alias("source"), F.to_json(F.struct(F.col("chunk").alias("event"), F.array(F.struct(F.col("course_id").alias("id"), "runners")).alias("courses"))).alias("body"))
    out = landed.nested_event(docs)
    each = F.transform("splits", lambda s: to_seconds(s["time"]))
    return out.select("course", "bib", F.size("splits").cast("bigint").alias("n_splits"), F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("seconds"))


@query("SELECT CAST(id AS STRING) AS id, bib_number AS bib, CASE WHEN course_id % 2 = 0 THEN total_time END AS time FROM parts")
def positional_columns(t: Tables) -> DataFrame:
    """Courses list their columns in two orders, and those with odd numbers have no times."""
    even = F.col("course_id") % 2 == 0
    names = F.when(even, F.array(F.lit("TIME"), F.lit("BIB"), F.lit("ID"))).otherwise(F.array(F.lit("ID"), F.lit("BIB")))
    own = F.col("id").cast("string")
    row = F.when(even, F.array("total_time", "bib_number", own)).otherwise(F.array(own, "bib_number"))
    lists = t.parts.groupBy("course_id", F.expr(CHUNK).alias("chunk"), names.alias("DataFields")).agg(F.collect_list(row).alias("data"))
    docs = lists.select(F.col("course_id").alias("source"), F.to_json(F.struct("DataFields", "data")).alias("body"))
    return landed.positional(docs, {"id": "ID", "bib": "BIB", "time": "TIME"})


@query("SELECT 'C' || course_id::VARCHAR AS contest, CASE WHEN course_id % 2 = 0 THEN status END AS status, CAST(id AS STRING) AS id FROM parts")
def group_tree(t: Tables) -> DataFrame:
    """Rows of courses with odd numbers lie in the contest, the others one level deeper, by status."""
    contest = F.concat(F.lit("C"), F.col("course_id").cast("string"))
    lists = t.parts.groupBy("course_id", F.expr(CHUNK).alias("chunk"), "status").agg(F.collect_list(F.array(F.col("id").cast("string"))).alias("data"))
    deep = lists.where("course_id % 2 = 0").groupBy("course_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("status", "data"))).alias("m"))
    deep = deep.select(contest.alias("source"), F.to_json(F.create_map(contest, "m")).alias("body"))
    flat = lists.where("course_id % 2 = 1").select(contest.alias("source"), F.to_json(F.create_map(contest, "data")).alias("body"))
    out = landed.group_tree(deep.unionByName(flat))
    return out.select(F.get("labels", F.lit(0)).alias("contest"), F.get("labels", F.lit(1)).alias("status"), F.get("row", F.lit(0)).alias("id"))


def tag(name: str, **attributes: Column | str) -> Column:
    pairs = [F.concat(F.lit(f' {k}="'), F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *pairs, F.lit("/>"))


def clax_documents(t: Tables) -> DataFrame:
    """One document per course and block of ids: entrants by leg, and results of all but one in eight."""
    own = F.col("id").cast("string")
    e = tag("E", d=own, n=F.concat(F.lit("N "), own), p=F.concat(F.lit("L"), (F.col("id") % 3).cast("string")), x=F.when(F.col("id") % 2 == 0, F.lit("F")).otherwise(F.lit("M")), ca=(F.col("id") % 5).cast("string"))
    r = F.when(F.col("id") % 8 != 0, tag("R", d=own, t="total_time"))
    of = t.parts.groupBy("course_id", F.expr(CHUNK).alias("chunk")).agg(F.array_join(F.collect_list(e), "").alias("e"), F.array_join(F.collect_list(r), "").alias("r"))
    return of.select(F.concat_ws("/", "course_id", "chunk").alias("source"), F.concat(F.lit("<Epreuve>"), "e", "r", F.lit("</Epreuve>")).alias("body"))


@query(
    "SELECT course_id::VARCHAR || '/' || floor(id / 40000)::INT::VARCHAR AS source, id::VARCHAR AS bib, 'N ' || id::VARCHAR AS name, 'L' || (id % 3)::VARCHAR AS leg, CASE WHEN id % 2 = 0 THEN 'F' ELSE 'M' END AS gender, "
    "(id % 5)::VARCHAR AS category, CASE WHEN id % 8 <> 0 THEN nullif(coalesce(total_time, ''), '') END AS time FROM parts"
)
def xml_entrants(t: Tables) -> DataFrame:
    return landed.entrants(clax_documents(t)).withColumn("time", F.nullif("time", F.lit("")))


@query(
    """WITH e AS (SELECT course_id::VARCHAR || '/' || floor(id / 40000)::INT::VARCHAR AS source, id::VARCHAR AS bib, id % 3 AS leg, id % 2 AS gender, id % 5 AS category,
    split_part(total_time, ':', 1)::BIGINT * 3600 + split_part(total_time, ':', 2)::BIGINT * 60 + split_part(total_time, ':', 3)::BIGINT AS seconds
    FROM parts WHERE id % 8 <> 0 AND coalesce(total_time, '') NOT IN ('', '00:00:00'))
    SELECT source, bib, row_number() OVER (PARTITION BY source, leg ORDER BY seconds, bib)::INT AS rank_overall, row_number() OVER (PARTITION BY source, leg, gender ORDER BY seconds, bib)::INT AS rank_gender,
    row_number() OVER (PARTITION BY source, leg, gender, category ORDER BY seconds, bib)::INT AS rank_category FROM e"""
)
def xml_entrant_ranks(t: Tables) -> DataFrame:
    return rows.entrant_ranks(landed.entrants(clax_documents(t))).select("source", "bib", "rank_overall", "rank_gender", "rank_category")


@query("SELECT id::VARCHAR AS \"Dossard\", trim(regexp_replace(coalesce(club, ''), '\\s+', ' ', 'g')) AS \"Club & co\", coalesce(total_time, '') AS \"Temps\" FROM parts WHERE id % 23 <> 0")
def html_tables(t: Tables) -> DataFrame:
    """A heading without a name and cells with tags, entities and line breaks; rows with a cell too few; a second table, and one around both."""
    cell = lambda c: F.concat(F.lit("<td class=x>"), F.coalesce(c, F.lit("")), F.lit("</td>"))
    club = F.concat(F.lit("<b>\n"), F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("club", F.lit("")), r"\s+", " ")), " ", "&nbsp;"), F.lit("</b>"))
    blank = F.when(F.col("id") % 23 != 0, cell(F.lit("?"))).otherwise(F.lit(""))
    row = F.concat(F.lit("<tr>"), cell(F.col("id").cast("string")), blank, cell(club), cell(F.col("total_time")), F.lit("</tr>"))
    head = F.lit("<TABLE><tr><td>Menu</td></tr><tr><td><table><TR><th>Dossard</th><th></th><th>Club &amp; co</th><th>Temps</th></TR>")
    tail = F.lit("</table></td></tr><tr><td><table><tr><th>Rang</th></tr><tr><td>1</td></tr></table></td></tr></TABLE>")
    of = t.parts.groupBy("course_id", F.expr(CHUNK).alias("chunk")).agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    out = landed.html_table(of.select(F.col("course_id").alias("source"), F.concat(head, "rows", tail).alias("body")))
    return out.select(*(F.col("cells")[c].alias(c) for c in ("Dossard", "Club & co", "Temps")))


@query("SELECT id::VARCHAR AS id, coalesce(club, '') AS club FROM parts WHERE course_id % 9 <> 0")
def encoded_blocks(t: Tables) -> DataFrame:
    """Blocks of every ninth course aren't base64."""
    line = F.concat_ws("|", F.col("id").cast("string"), F.coalesce("club", F.lit("")), F.lit(""))
    of = t.parts.groupBy("course_id", F.expr(CHUNK).alias("chunk")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    ship(t.spark)
    hidden = F.base64(F.encode(landed.xored(XOR_KEY)(F.encode("text", "UTF-8")), "UTF-8"))
    docs = of.select(F.col("course_id").alias("source"), F.when(F.col("course_id") % 9 == 0, F.lit("*not base64*")).otherwise(hidden).alias("body"))
    out = landed.encoded_rows(docs, XOR_KEY)
    return out.select(F.col("fields")[0].alias("id"), F.col("fields")[1].alias("club"))


@query(
    "SELECT p.id, " + ", ".join(f"max(CASE WHEN s.label = '{x}' THEN s.seconds END) AS {x}_time" for x in ("swim", "t1", "bike")) + " FROM parts p LEFT JOIN segments s ON s.id = p.id GROUP BY p.id"
)
def checkpoint_pivot(t: Tables) -> DataFrame:
    points = t.segments.select("id", F.col("label").alias("slot"), F.col("pos").alias("seq"), F.col("seconds").cast("string").alias("time"))
    out = rows.with_checkpoints(t.parts.select("id"), points, ["id"], ("swim", "t1", "bike"))
    return out.select("id", *(F.col(f"{s}_time").cast("bigint").alias(f"{s}_time") for s in ("swim", "t1", "bike")))


@query(
    "SELECT course_id, provider AS role, CASE WHEN count(*) = 1 THEN min(url) END AS field, count(*) > 1 AS ambiguous FROM sources WHERE id % 4 <> 0 GROUP BY 1, 2"
)
def unique_roles(t: Tables) -> DataFrame:
    of = t.sources.select("course_id", F.col("provider").alias("role"), F.col("url").alias("field"), (F.col("id") % 4 == 0).alias("cumulative"))
    return rows.resolved_roles(of, ["course_id"])


@query("SELECT provider AS name, (course_id % 50)::VARCHAR AS contest, min(id) AS seq FROM sources WHERE id % 3 <> 0 GROUP BY 1, 2")
def published_lists(t: Tables) -> DataFrame:
    mode = F.when(F.col("id") % 3 == 0, F.lit("hidden")).when(F.col("id") % 3 == 1, F.lit("live"))
    return rows.list_specs(t.sources.select(F.col("provider").alias("name"), (F.col("course_id") % 50).alias("contest"), mode.alias("mode"), F.col("id").alias("seq")))


@query("WITH r AS (SELECT id, course_id, CASE WHEN course_id % 10 = 0 THEN '' ELSE trim(category) END AS leg FROM parts) SELECT id FROM r QUALIFY leg <> '' OR NOT bool_or(leg <> '') OVER (PARTITION BY course_id)")
def orphans_without_leg(t: Tables) -> DataFrame:
    leg = F.when(F.col("course_id") % 10 == 0, F.lit("")).otherwise(F.trim("category"))
    return rows.without_orphans(t.parts.select("id", "course_id", leg.alias("leg")), "course_id").select("id")


@query("SELECT id, trim(name) || CASE WHEN id % 3 <> 0 THEN ' - ' || event_type ELSE '' END AS name FROM courses")
def course_names(t: Tables) -> DataFrame:
    spaced = F.concat(F.lit("  "), F.regexp_replace("name", " ", "  "))
    heat = F.when(F.col("id") % 3 != 0, F.concat("event_type", F.lit("\t")))
    return t.courses.select("id", rows.course_name(spaced, heat).alias("name"))


@query("SELECT course_id, bool_and(provider <> 'other') AS reliable FROM sources GROUP BY course_id")
def groups_are_contests(t: Tables) -> DataFrame:
    labels = t.sources.select("course_id", F.upper("provider").alias("label"))
    contests = t.sources.select("course_id").distinct().select("course_id", F.explode(F.array(F.lit("plata"), F.lit(" platb "))).alias("label"))
    return rows.groups_are_contests(labels, contests, "course_id")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS part FROM courses WHERE id % 4 = 0 OR id % 3 = 0")
def merged_course_lists(t: Tables) -> DataFrame:
    fresh = t.courses.where("id % 4 = 0").select("id", F.col("id").alias("seq"))
    return rows.merged_courses(fresh.unionByName(fresh), t.courses.where("id % 3 = 0").select("id", "scraped_at")).select("id", "part")


@query("WITH t AS (SELECT p.id, p.course_id, s.seconds FROM parts p LEFT JOIN segments s ON s.id = p.id AND s.label = 'bike') SELECT id, row_number() OVER (PARTITION BY course_id ORDER BY seconds DESC NULLS LAST, id)::INT AS place FROM t")
def segment_order(t: Tables) -> DataFrame:
    bike = t.segments.where("label = 'bike'").select("id", "seconds")
    order = rows.segment_order("seconds", ["id"], descending=True)
    return t.parts.join(bike, "id", "left").select("id", F.row_number().over(Window.partitionBy("course_id").orderBy(*order)).alias("place"))


@query("SELECT p.id, s.seconds FROM (SELECT DISTINCT id FROM segments) x JOIN parts p ON p.id = x.id LEFT JOIN splits s ON s.id = p.id AND s.label = 't1'")
def segment_seconds(t: Tables) -> DataFrame:
    return t.timed_parts.select("id", rows.segment_seconds("t1").alias("seconds"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'DSQ' WHEN id % 7 = 0 THEN 'DNF' WHEN coalesce(total_time, '') NOT IN ('', '00:00:00') THEN 'finisher' ELSE 'DNS' END AS status FROM parts")
def published_status(t: Tables) -> DataFrame:
    flag = lambda k: F.when(F.col("id") % k == 0, F.lit(" o")).when(F.col("id") % 2 == 0, F.lit("N"))
    return t.parts.select("id", rows.published_status(flag(5), flag(7), "total_time").alias("status"))


#: Names of athletes as a service prints them: the last name in capitals, figures as letters; the first name may be missing, and so may the last.
FIGURES, LETTERS = "0123456789#", "ABCDEFGHIJK"
PRINTED = f"""WITH n AS (SELECT p.id, p.course_id, p.bib_number, p.is_relay, upper(translate(a.last_name, '{FIGURES}', '{LETTERS}')) AS last, a.first_name AS first FROM parts p JOIN athletes a ON a.id = p.athlete_id),
s AS (SELECT *, CASE WHEN last = '' THEN first ELSE last END AS own, CASE WHEN last = '' THEN '' ELSE first END AS other FROM n)
"""


def printed_names(t: Tables) -> DataFrame:
    last = F.upper(F.translate("last_name", FIGURES, LETTERS))
    people = t.athletes.select(F.col("id").alias("athlete_id"), last.alias("last"), "first_name")
    return t.parts.select("id", "course_id", "bib_number", "is_relay", "athlete_id").join(people, "athlete_id")


@query(PRINTED + "SELECT id, own AS last, other AS first, CASE id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'F' ELSE '' END AS gender, CASE WHEN id % 3 < 2 THEN 'S' || (id % 4)::VARCHAR ELSE '' END AS category FROM s")
def name_cells(t: Tables) -> DataFrame:
    code = F.when(F.col("id") % 3 < 2, F.concat(F.when(F.col("id") % 3 == 0, F.lit("H")).otherwise(F.lit("F")), F.lit("-S"), (F.col("id") % 4).cast("string"))).otherwise(F.lit(""))
    name = F.concat(F.lit(" "), F.concat_ws("  ", "last", "first_name"), code)
    return printed_names(t).select("id", rows.name_cell(name).alias("n")).select("id", "n.*")


@query(
    PRINTED
    + "SELECT id, CASE WHEN id % 3 = 0 AND coalesce(bib_number, '') <> '' THEN 'Anonyme ' || course_id::VARCHAR || '-' || bib_number WHEN is_relay THEN trim(first || ' ' || last) ELSE own END AS last, "
    "CASE WHEN (id % 3 = 0 AND coalesce(bib_number, '') <> '') OR is_relay THEN '' ELSE other END AS first FROM s"
)
def runner_identities(t: Tables) -> DataFrame:
    of = rows.identity(F.concat_ws(" ", "first_name", "last"), F.col("id") % 3 == 0, "bib_number", "course_id", "is_relay")
    return printed_names(t).select("id", of.alias("n")).select("id", "n.*")


@query("SELECT 'C' || course_id::VARCHAR AS source, CASE WHEN course_id % 3 = 0 THEN '' ELSE 'Abandons' END AS contest, CASE WHEN course_id % 5 = 0 THEN 'DNS' WHEN course_id % 3 = 0 THEN 'DNF' ELSE '' END AS status, CAST(id AS STRING) AS id FROM parts")
def contests_and_statuses(t: Tables) -> DataFrame:
    """Every list is called after a status, which is a contest's name in two courses of three; below it are genders, in one course of five after another status."""
    own = F.concat(F.lit("C"), F.col("course_id").cast("string"))
    lists = t.parts.groupBy("course_id", F.expr(CHUNK).alias("chunk")).agg(F.collect_list(F.array(F.col("id").cast("string"))).alias("data"))
    gender = F.create_map(F.lit("#1_Féminin"), F.col("data"))
    plain, deep = F.to_json(F.create_map(F.lit("#2_Abandons"), gender)), F.to_json(F.create_map(F.lit("#2_Abandons"), F.create_map(F.lit("#1_Non partants"), gender)))
    docs = lists.select(own.alias("source"), F.when(F.col("course_id") % 5 == 0, deep).otherwise(plain).alias("body"))
    named = lists.where("course_id % 3 <> 0").select(own.alias("source"), F.lit(" ABANDONS").alias("label")).distinct()
    out = landed.contests_and_statuses(landed.group_tree(docs), named)
    return out.select("source", "contest", "status", F.get("row", F.lit(0)).alias("id"))


@query("WITH c AS (SELECT id AS seq, id % 400 AS k, 'v' || id::VARCHAR AS value, id % 3 = 0 AS right_one FROM sources), f AS (SELECT k, min(seq) AS won FROM c WHERE right_one GROUP BY k) SELECT c.id, f.won, CASE WHEN f.won IS NULL THEN c.event_type ELSE 'v' || f.won::VARCHAR END AS event_type FROM courses c LEFT JOIN f ON f.k = c.id")
def compare_and_swap(t: Tables) -> DataFrame:
    """Claims that expect the value held, of which the first wins, among others that expect another one."""
    held = t.courses.select("id", "event_type")
    claims = t.sources.select(F.col("id").alias("seq"), (F.col("id") % 400).alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    claims = claims.join(held.withColumnRenamed("id", "k"), "k").select(F.col("k").alias("id"), "seq", "value", F.when(F.col("seq") % 3 == 0, F.col("event_type")).otherwise(F.lit("?")).alias("expected"))
    return rows.swapped(held, claims, "id", "event_type").select("id", "won", "event_type")


@query("SELECT 'delete_course' AS action, c.id AS entity_id, c.name, count(p.id) AS n_parts FROM courses c LEFT JOIN parts p ON p.course_id = c.id WHERE c.is_relay GROUP BY c.id, c.name")
def deletion_audit(t: Tables) -> DataFrame:
    gone = rows.deletion(t.courses, t.parts, t.courses.where("is_relay").select("id"))
    log = t.spark.createDataFrame([], "id bigint, action string, entity_id bigint, name string, n_parts bigint")
    return rows.audited(log, gone).select("action", "entity_id", "name", "n_parts")


@query("SELECT id, CASE WHEN id IN (SELECT course_id FROM sources) THEN DATE '2024-02-15' ELSE scraped_at END AS scraped_at FROM courses")
def touched_courses(t: Tables) -> DataFrame:
    return rows.touched(t.courses, t.sources.select(F.col("course_id").alias("id")), F.lit("2024-02-15").cast("date")).select("id", "scraped_at")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 'detail' ELSE category END AS category FROM parts")
def club_enrichment(t: Tables) -> DataFrame:
    details = t.parts.select("id", F.lit("detail").alias("category"))
    return rows.enriched(t.parts.select("id", "category"), F.col("id") % 6 == 0, details, "id", ["category"])
