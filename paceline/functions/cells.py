"""Cells as services publish them: decoration, several languages, ranks glued to values, and the parts of a segment's cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import bound, of
from paceline.functions.times import normalize_time, parse_rank

#: A text in several languages, and the languages that are preferred; an image; a rank before or behind a value.
LANGUAGES = r"^\{[A-Za-z]{2}:[^{}|]*(?:\|[A-Za-z]{2}:[^{}|]*)*\}$"
PREFERRED = ("FR", "EN")
IMAGE = r"\[img:[^\]]*\]"
RANK_BEFORE = r"^(\d+)\.\s*(.*)$"
RANK_BEHIND = r"^(.*?)\s*\(\s*(\d+)\.?\s*\)$"
RANK_BEHIND_STRICT = r"^(.*?)\s*\(\s*(\d+)\.\s*\)$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_language(c: Column | str) -> Column:
    """The French text of ``{DE:...|EN:...|FR:...}``, else the English, else the first that isn't empty.

    Only if every part is a text with a language of two letters, and one of them isn't empty; any other text is free text and stays as it is.
    """
    text = of(c)
    parts = F.split(F.substring(text, F.lit(2), F.length(text) - 2), r"\|")
    pairs = F.transform(parts, lambda p: F.struct(F.upper(F.substring(p, 1, 2)).alias("k"), F.substr(p, F.lit(4)).alias("v")))

    def choose(found: Column) -> Column:
        some = F.filter(found, lambda p: p["v"] != "")
        said = lambda language: F.try_element_at(F.filter(some, lambda p: p["k"] == language), F.lit(-1))["v"]
        return F.coalesce(*map(said, PREFERRED), F.try_element_at(some, F.lit(1))["v"], text)

    return F.when(text.rlike(LANGUAGES), bound(pairs, choose)).otherwise(text)


def clean_cell(c: Column | str) -> Column:
    """A cell without images, marks in front and other languages; null is empty."""
    bare = stripped(F.regexp_replace(F.coalesce(of(c).cast("string"), F.lit("")), IMAGE, ""))
    return one_language(stripped(F.ltrim(bare, F.lit("#"))))


def rank_and_label(c: Column | str) -> Column:
    """``struct(rank, label)`` of cells such as ``1.S4M`` or ``M0M (1.)``; without a rank the whole cell is the label."""
    cell = clean_cell(c)
    cut = lambda pattern, rank, label: F.struct(F.regexp_extract(cell, pattern, rank).try_cast("int").alias("rank"), F.trim(F.regexp_extract(cell, pattern, label)).alias("label"))
    bare = F.struct(F.lit(None).cast("int").alias("rank"), cell.alias("label"))
    return F.when(cell.rlike(RANK_BEFORE), cut(RANK_BEFORE, 1, 2)).when(cell.rlike(RANK_BEHIND), cut(RANK_BEHIND, 2, 1)).otherwise(bare)


def without_rank(c: Column | str, strict: bool = True) -> Column:
    """A value without the rank in brackets behind it. ``strict`` wants the rank's full stop, as in free text a number in brackets may be its own; times don't need it."""
    pattern = RANK_BEHIND_STRICT if strict else RANK_BEHIND
    return F.when(of(c).rlike(pattern), F.trim(F.regexp_extract(of(c), pattern, 1))).otherwise(of(c))


def segment_cell(c: Column | str) -> Column:
    """``struct(time, rank, gap, speed)`` of a segment's HTML cell: the time in bold, ``P:2``, ``0.62%``, ``3.87 km/h``; what is missing is empty, a rank null."""
    html = F.coalesce(of(c), F.lit(""))
    bold = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<b\b[^>]*>(.*?)</b>", 1), r"<[^>]*>", ""))
    plain = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    return F.struct(
        normalize_time(bold).alias("time"),
        parse_rank(F.regexp_extract(plain, r"P:\s*(\d+)", 1)).alias("rank"),
        F.regexp_extract(plain, r"(\d+[.,]?\d*\s*%)", 1).alias("gap"),
        F.regexp_extract(plain, r"(?i)(\d+[.,]?\d*\s*km/h)", 1).alias("speed"),
    )
