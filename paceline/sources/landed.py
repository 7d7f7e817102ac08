"""Landed documents (JSON pages, XML, HTML tables, encoded blocks, CSV files) as rows.

A landed document is a row ``(source, body)``: where it was read and its whole text. Each parser takes such a
DataFrame, so that documents come from a folder (`landed`) or a table alike and are parsed where they lie.
A null or malformed body gives no rows; `json_documents` names such documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paceline.functions.columns import DURATION, column_roles, require
from paceline.functions.splits import of_seconds
from paceline.functions.status import status_of_label
from paceline.runtime import ship

CLAX = "E array<struct<_d:string,_n:string,_p:string,_x:string,_ca:string>>, R array<struct<_d:string,_t:string>>"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """``(source, body)`` of every file under ``path``."""
    files = spark.read.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"))


def json_documents(docs: DataFrame, schema: str) -> DataFrame:
    """``docs`` with ``doc``, the body read by ``schema``, and ``failed`` for bodies that aren't such JSON: the others go on."""
    read = docs.withColumn("doc", F.from_json("body", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return read.withColumn("failed", F.col("doc").isNull() | F.col("doc._bad").isNotNull())


def good(docs: DataFrame, schema: str) -> DataFrame:
    return good_of(docs, schema).drop("source")


def good_of(docs: DataFrame, schema: str) -> DataFrame:
    """``source`` and the fields of the documents that can be read."""
    return json_documents(docs, schema).where(~F.col("failed")).select("source", "doc.*").drop("_bad")


def broken(docs: DataFrame, schema: str, owner: str, name: str) -> DataFrame:
    """``name`` of the documents that can't be read, where ``owner``, an expression of ``source``, tells whose they are."""
    return json_documents(docs, schema).where("failed").select(F.expr(owner).cast("bigint").alias(name)).where(F.col(name).isNotNull()).distinct()


def numbered_pages(docs: DataFrame, row: str, owner: str | None = None) -> DataFrame:
    """Pages ``race, page, content`` up to the first that says it is the last or is empty, with ``complete`` of the race.

    A race is complete if it has such a page, every page from 0 to it exactly once, as many rows as it announces, and no page that couldn't be read
    (``owner``, an expression of ``source``, tells the race of those). Totals that a source announces check the result only; they don't bound what is read.
    """
    schema = f"race bigint, page int, last boolean, announced bigint, content array<struct<{row}>>"
    pages = good(docs, schema)
    rows = F.coalesce(F.size("content"), F.lit(0))
    ends = F.when(F.coalesce("last", F.lit(False)) | (rows < 1), F.col("page"))
    stops = pages.groupBy("race").agg(F.min(ends).alias("stop"), F.max("announced").alias("announced"))
    read = pages.drop("announced").join(stops, "race").where(F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
    seen = read.groupBy("race", "stop", "announced").agg(
        F.sum(rows).alias("n_read"), F.count("*").alias("n_pages"), F.count_distinct("page").alias("n_different"), F.min("page").alias("first")
    )
    whole = (F.col("n_pages") == F.col("stop") + 1) & (F.col("n_different") == F.col("n_pages")) & (F.col("first") == 0)
    whole = whole & F.coalesce(F.col("n_read") == F.col("announced"), F.lit(True))
    if owner is not None:
        seen = seen.join(broken(docs, schema, owner, "race").withColumn("broken", F.lit(True)), "race", "left")
        whole = whole & F.col("broken").isNull()
    seen = seen.select("race", "n_read", F.col("announced").alias("n_announced"), F.coalesce(whole, F.lit(False)).alias("complete"))
    return read.select("race", "page", "content").join(seen, "race")


def completeness(pages: DataFrame) -> DataFrame:
    """One row per race: rows read and announced, and whether the race may be imported."""
    return pages.select("race", "n_read", "n_announced", "complete").distinct()


def rows_of_complete(pages: DataFrame) -> DataFrame:
    """Rows of complete races; a ranking that was cut short gives none."""
    return pages.where("complete").select("race", F.explode("content").alias("row")).select("race", "row.*")


def linked_pages(docs: DataFrame, row: str, key: str, owner: str | None = None) -> DataFrame:
    """Rows of pages that link to the next one; a row that comes again with its ``key`` counts once, at its first place.

    Rows without a key stay. An edition gives rows only if its pages are whole: 0 to the last, each once, all but the last with a link, and none that
    couldn't be read (``owner``, an expression of ``source``, tells the edition of those).
    """
    schema = f"edition bigint, page int, value array<struct<{row}>>, `@odata.nextLink` string"
    pages = good(docs, schema).withColumnRenamed("@odata.nextLink", "link")
    seen = pages.groupBy("edition").agg(
        F.count("*").alias("n"), F.count_distinct("page").alias("n_different"), F.min("page").alias("first"), F.max("page").alias("last"),
        F.count_if(F.col("link").isNull()).alias("n_ends"), F.max_by(F.col("link").isNull(), "page").alias("ended"),
    )
    whole = seen.where("n = n_different AND first = 0 AND n = last + 1 AND n_ends = 1 AND ended").select("edition")
    if owner is not None:
        whole = whole.join(broken(docs, schema, owner, "edition"), "edition", "left_anti")
    rows = pages.select("edition", "page", F.posexplode("value").alias("_pos", "row")).select("edition", "page", "_pos", "row.*")
    first = F.row_number().over(Window.partitionBy("edition", key).orderBy("page", "_pos"))
    named = rows.where(F.col(key).isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")
    return named.unionByName(rows.where(F.col(key).isNull())).join(whole, "edition", "left_semi").drop("page", "_pos")


def nested_event(docs: DataFrame) -> DataFrame:
    """``event, course, bib, name, splits`` of documents that hold courses, their runners and their points."""
    runner = "bib string, name string, points array<struct<label string, seconds bigint>>"
    events = good(docs, f"event bigint, courses array<struct<id bigint, runners array<struct<{runner}>>>>")
    runners = events.select("event", F.explode("courses").alias("c")).select("event", F.col("c.id").alias("course"), F.explode("c.runners").alias("r"))
    points = F.coalesce("r.points", F.array().cast("array<struct<label:string,seconds:bigint>>"))
    return runners.select("event", "course", "r.bib", "r.name", of_seconds(points["label"], points["seconds"]).alias("splits"))


def positional(docs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows of documents whose columns are named apart: ``wanted`` has the field for each column.

    The first of fields with one name counts; a field that a document lacks, or a row too short for it, gives null.
    """
    lists = good(docs, "DataFields array<string>, data array<array<string>>")
    rows = lists.select("DataFields", F.explode("data").alias("row"))

    def cell(field: str) -> Column:
        at = F.array_position("DataFields", F.lit(field))
        return F.when(at > 0, F.get("row", (at - 1).cast("int")))

    return rows.select(*(cell(field).alias(column) for column, field in wanted.items()))


def by_role(docs: DataFrame, wanted: Sequence[str], fixed: dict[str, str]) -> DataFrame:
    """``source``, ``wanted`` roles, ``fixed`` columns (by the name of their field) and ``segments`` of documents that publish their columns as expressions.

    A row's cell of a role stands where the document's field of that role stands in ``DataFields``. A document that lacks one of the wanted roles is an error that names it.
    Segments are ``label, time``, without a time where the cell is no duration.
    """
    lists = good_of(docs, "DataFields array<string>, list struct<Fields: array<struct<Expression: string, Label: string>>>, data array<array<string>>")
    fields = lists.select("source", "DataFields", F.posexplode("list.Fields").alias("seq", "f"))
    at = F.array_position("DataFields", F.col("f.Expression"))
    roles = column_roles(fields.select("source", "seq", F.col("f.Expression").alias("expression"), F.col("f.Label").alias("label"), F.when(at > 0, (at - 1).cast("int")).alias("at")))
    rows = lists.select("source", "DataFields", F.explode("data").alias("row")).join(require(roles, wanted), "source", "left")
    none = F.raise_error(F.concat(F.lit("no columns in "), F.col("source").cast("string"))).cast("map<string,int>")
    rows = rows.withColumn("places", F.coalesce("places", none))
    cell = lambda k: F.get("row", k)
    named = [F.get("row", F.array_position("DataFields", F.lit(field)).cast("int") - 1).alias(column) for column, field in fixed.items()]
    segment = F.transform("segments", lambda s: F.struct(s["label"].alias("label"), F.when(cell(s["at"]).rlike(DURATION), cell(s["at"])).alias("time")))
    return rows.select("source", *named, *(cell(F.col("places")[r]).alias(r) for r in wanted), segment.alias("segments"))


def group_tree(docs: DataFrame, depth: int = 4) -> DataFrame:
    """``source, labels, row``: rows of groups that lie in groups, lists at any level, with the labels that lead to them.

    More than ``depth`` levels of groups raise an error.
    """
    spark = docs.sparkSession
    level = docs.select("source", F.array().cast("array<string>").alias("labels"), F.try_parse_json("body").alias("node"))
    kind = F.schema_of_variant("node")
    parts = []
    for _ in range(depth + 1):
        found = level.where(kind.startswith("ARRAY")).selectExpr("source", "labels", "explode(CAST(node AS ARRAY<ARRAY<STRING>>)) AS row")
        parts.append(found)
        inner = level.where(kind.startswith("OBJECT")).lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        level = inner.select("source", F.concat("labels", F.array("key")).alias("labels"), F.col("value").alias("node"))
    deep = F.raise_error(F.concat(F.lit(f"more than {depth} levels of groups in "), F.coalesce("source", F.lit("?"))))
    out = level.select("source", deep.cast("array<string>").alias("labels"), F.array().cast("array<string>").alias("row"))
    for p in parts:
        out = p.unionByName(out)
    return out


def contests_and_statuses(tree: DataFrame, contests: DataFrame, by: str = "source") -> DataFrame:
    """``by, contest, status, row`` of the rows of `group_tree`: what their labels say.

    The first label names the contest, unless the table of statuses knows it and no contest of the source (``by, label``) has that name. Of the others the last
    known one is the status; an unknown label, such as a gender, leaves it as it is. A number in front of a label (``#2_``) is its place and nothing more.
    """
    labels = F.transform("labels", lambda x: F.trim(F.regexp_replace(x, r"^#\d+_", "")))
    known = contests.groupBy(by).agg(F.collect_set(F.lower(F.trim("label"))).alias("_known"))
    of = tree.withColumn("labels", labels).join(known, by, "left")
    first = F.get("labels", F.lit(0))
    named = F.coalesce(F.array_contains("_known", F.lower(first)), F.lit(False))
    status = (status_of_label(first) != "") & ~named
    later = F.filter(F.slice("labels", 2, F.greatest(F.size("labels"), F.lit(1))), lambda x: status_of_label(x) != "")
    found = F.coalesce(F.try_element_at(later, F.lit(-1)), F.when(status, first), F.lit(""))
    return of.select(by, F.when(status | first.isNull(), F.lit("")).otherwise(first).alias("contest"), status_of_label(found).alias("status"), "row")


def entrants(docs: DataFrame) -> DataFrame:
    """``source, bib, name, leg, gender, category, time``: entrants with their result, by bib; the last result of a bib counts."""
    read = docs.select("source", F.from_xml("body", CLAX).alias("x"))
    people = read.select("source", F.explode("x.E").alias("e")).select(
        "source", F.col("e._d").alias("bib"), F.col("e._n").alias("name"), F.coalesce("e._p", F.lit("")).alias("leg"),
        F.coalesce("e._x", F.lit("")).alias("gender"), F.coalesce("e._ca", F.lit("")).alias("category"),
    )
    results = read.select("source", F.posexplode("x.R").alias("pos", "r")).groupBy("source", F.col("r._d").alias("bib")).agg(F.max_by("r._t", "pos").alias("time"))
    return people.join(results, ["source", "bib"], "left")


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements ``tag`` of XML files, one row each, so that a large file is split."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


#: Entities that tables have.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def cell_text(c: Column) -> Column:
    text = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: The innermost tables of a page, one match each.
TABLE = r"(?is)<table\b[^>]*>((?:(?!<table\b).)*?)</table\s*>"


def html_rows(docs: DataFrame, nth: int = 0) -> DataFrame:
    """``source, heads, cells, even``: rows of the ``nth`` table of each page that holds no other table; ``even`` if a row has as many cells as the first.

    A page whose table isn't closed, or without any, is read as one table.
    """
    tables = F.regexp_extract_all("body", F.lit(TABLE), F.lit(1))
    table = F.when(F.size(tables) > 0, F.get(tables, F.lit(nth))).when(F.lit(nth == 0), F.col("body"))
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), cell_text))
    of_all = docs.select("source", cells.alias("all")).where(F.size("all") > 1)
    of_row = of_all.select("source", F.col("all")[0].alias("heads"), F.explode(F.slice("all", 2, F.size("all"))).alias("cells")).where(F.size("cells") > 0)
    return of_row.withColumn("even", F.size("cells") == F.size("heads"))


def html_table(docs: DataFrame, nth: int = 0) -> DataFrame:
    """``source, cells``: rows below a table's first one, as maps from heading to text.

    Cells without a heading go, as do rows without cells and rows with another number of cells than there are headings, whose cells can't be told apart
    (`uneven` counts them). The first of equal headings counts.
    """
    even = html_rows(docs, nth).where("even")
    pairs = F.arrays_zip(F.col("heads").alias("h"), F.col("cells").alias("c"))
    numbered = F.transform(pairs, lambda p, k: F.struct(p["h"].alias("h"), p["c"].alias("c"), k.alias("k")))
    named = F.filter(numbered, lambda p: (p["h"] != "") & (F.array_position("heads", p["h"]) == p["k"] + 1))
    return even.select("source", F.map_from_arrays(F.transform(named, lambda p: p["h"]), F.transform(named, lambda p: p["c"])).alias("cells"))


def uneven(docs: DataFrame, nth: int = 0) -> DataFrame:
    """``source, n_uneven``: pages with rows that `html_table` leaves out."""
    return html_rows(docs, nth).where("NOT even").groupBy("source").agg(F.count("*").alias("n_uneven"))


def xored(key: int) -> Callable[[Column], Column]:
    """Texts of bytes that were combined with ``key``; null for those that aren't UTF-8 then."""

    def plain(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else (np.frombuffer(raw, np.uint8) ^ np.uint8(key)).tobytes().decode()
        except UnicodeDecodeError:
            return None

    @F.pandas_udf(StringType())
    def texts(raw: pd.Series) -> pd.Series:
        return raw.map(plain)

    return texts


def encoded_rows(docs: DataFrame, key: int) -> DataFrame:
    """``source, fields`` of base64 blocks of lines whose fields a pipe parts; a block that can't be read gives no rows."""
    ship(docs.sparkSession)
    text = xored(key)(F.try_to_binary(F.trim("body"), F.lit("base64")))
    lines = docs.select("source", F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line") != "")
    return lines.select("source", F.split("line", r"\|").alias("fields"))


#: Bytes 0x80 to 0x9F as Spark's Latin-1 reads them, and as Windows-1252 means them; five of them have no meaning.
LATIN, WINDOWS = zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)), strict=True)


def read_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file with every cell as trimmed text, empty if absent; a column without a heading is ``Colonne N``, counted from 1.

    A file that isn't UTF-8 throughout is read as Windows-1252. Equal headings are told apart by `` (2)``, `` (3)``.
    ``multi_line=False`` lets a large file be split, if no cell has a line break. More than one file is an error, as each has headings and an encoding of
    its own: `paceline.sources.sheets` reads many files.
    """
    if len(spark.read.text(path).inputFiles()) > 1:
        raise ValueError(f"more than one file in {path}")
    valid = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0] is not False
    read = spark.read.option("header", False).option("multiLine", multi_line).option("escape", '"')
    rows = read.option("encoding", "UTF-8" if valid else "ISO-8859-1").csv(path)
    head = rows.first()
    if head is None:
        return rows
    meant = {} if valid else str.maketrans("".join(LATIN), "".join(WINDOWS))
    names, seen = [], {}
    for k, cell in enumerate(head, 1):
        name = (cell or "").removeprefix("\ufeff").translate(meant).strip() or f"Colonne {k}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name} ({seen[name]})")

    def cell_of(c: str) -> Column:
        found = F.coalesce(F.col(c), F.lit(""))
        return F.trim(found if valid else F.translate(found, "".join(LATIN), "".join(WINDOWS)))

    # the heading stands at the start of the file's first split, so it is known by its place rather than by its values
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).where("_at > 0")
    return placed.select(*(cell_of(c).alias(n) for c, n in zip(rows.columns, names, strict=True)))
