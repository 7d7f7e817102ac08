"""What published columns mean: expressions reduced to what they show, roles by an ordered rule table, guards for columns that must be there."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paceline.functions.text import of
from paceline.runtime import ship

#: Turns after which an expression that still changes is an error.
TURNS = 10
#: Functions that only shape what they show; what a comparison looks like; a text in quotes.
SHAPING = ("ucase", "lcase", "trim", "format", "OuStatut", "Statut", "iif", "if", "switch")
COMPARES = re.compile("[<>=]")
QUOTED = re.compile('"[^"]*"')
#: How a column's role is told by its reduced expression. The first line that holds decides.
ROLES = (
    ("shown_bib", "is", ("bib", "displaybib", "dossard", "dossardbis")),
    ("rank", "has", ("classementgeneral", "autorank")),
    ("rank_category", "has", ("classementcategorie", "agegroup")),
    ("category", "has", ("categorie", "category")),
    ("gender", "has", ("sexemf",)),
    ("split_rank", "ends", (".p",)),
    ("name", "has", ("affichernom", "nomrelais", "nomequipe", "lfname", "displayname")),
    ("club", "has", ("club",)),
    ("gender", "is", ("sex", "sexe", "gender")),
    ("time", "is", ("time", "temps", "tempstotal", "tempsfinal", "tempsfinal.decimal", "tempscorrige", "tempsoustatut", "finish", "arrivee")),
    ("time", "is", ("temps.chip", "arrivee.chip", "finish.chip")),
    ("time_gun", "is", ("temps.gun", "arrivee.gun", "finish.gun")),
    ("time_text", "is", ("temps.text", "arrivee.text", "finish.text", "finishresult.text")),
)
#: Roles that no field is read for, columns that are ornaments, and what stands in for a role that is missing.
LEFT_OUT = ("shown_bib", "split_rank")
ORNAMENTS, ORNAMENTS_BEGIN = ("customflag", "lienphotos", "nation.iocname"), ("icone(", "gaptimetop(")
STAND_INS = {"category": "rank_category", "time": "time_gun"}
DURATION = r"^\d{1,3}:\d{2}(:\d{2})?([.,]\d+)?$"


def pieces(text: str, mark: str) -> list[str]:
    """``text`` cut at each ``mark`` that isn't inside parentheses; empty pieces go."""
    depth, begin, out = 0, 0, []
    for at, c in enumerate(f"{text}{mark}"):
        depth += (c == "(") - (c == ")")
        if c == mark and (depth == 0 or at == len(text)):
            out.append(text[begin:at].strip())
            begin = at + 1
    return [p for p in out if p]


def joined_value(text: str) -> str:
    """Of terms joined by ``&`` the first that isn't a text in quotes."""
    terms = pieces(text, "&")
    return text if len(terms) < 2 else next((t for t in terms if not QUOTED.fullmatch(t)), terms[0])


def inside(text: str) -> str:
    """What shaping functions around the whole expression are given."""
    name, bracket, rest = text.partition("(")
    if bracket and text.endswith(")") and name.strip().lower() in {s.lower() for s in SHAPING}:
        return inside(rest[:-1].strip())
    return text


def branch(text: str) -> str:
    """Of arguments the longest that compares nothing."""
    args = pieces(text, ";")
    return text if len(args) < 2 else max([a for a in args if not COMPARES.search(a)] or args, key=len)


def reduced(expression: str | None) -> str:
    """An expression without decoration: the rules above in turn until nothing changes; more than ``TURNS`` turns are an error."""
    text = (expression or "").strip()
    for _ in range(TURNS):
        new = branch(inside(joined_value(text)))
        if new == text:
            return text
        text = new
    raise ValueError(f"expression still changes after {TURNS} turns: {expression}")


def plain(expression: str | None) -> str:
    """A reduced expression without marks, accents and capitals."""
    text = unicodedata.normalize("NFD", re.sub(r"[#\[\]]", "", reduced(expression)))
    return "".join(c for c in text if not unicodedata.combining(c)).lower().strip()


@F.pandas_udf(StringType())
def comparable(expressions: pd.Series) -> pd.Series:
    """`plain` of each expression. Meant for column lists, not for rows."""
    return expressions.map(plain)


def role(c: Column | str) -> Column:
    """The role of a reduced expression, or null."""
    text, tests = of(c), {"is": lambda t, w: t == w, "has": lambda t, w: t.contains(w), "ends": lambda t, w: t.endswith(w)}
    lines = []
    for name, how, words in ROLES:
        holds = F.lit(False)
        for w in words:
            holds = holds | tests[how](text, w)
        lines.append(F.when(holds, F.lit(name)))
    return F.coalesce(*lines)


def column_roles(fields: DataFrame, by: str = "source") -> DataFrame:
    """``by, role, label, at`` of published columns ``by, seq, expression, label, at`` (their place in a data row).

    The first column of a role has it. A column without a role whose expression is one plain word and that has a label is a ``segment``; everything else is ``extra``, among it further
    columns of a role. Columns of ranks of splits and bibs for show are left out, and so are those without a place. Missing roles are taken over by their stand-ins.
    """
    ship(fields.sparkSession)
    kinds = fields.select("expression").distinct().withColumn("reduced", comparable("expression"))
    known = fields.where("at IS NOT NULL").join(kinds, "expression").withColumn("own", role("reduced"))
    known = known.where(F.col("own").isNull() | ~F.col("own").isin(*LEFT_OUT))
    first = F.col("seq") == F.min("seq").over(Window.partitionBy(by, "own"))
    ornament = F.col("reduced").isin(*ORNAMENTS)
    for w in ORNAMENTS_BEGIN:
        ornament = ornament | F.col("reduced").startswith(w)
    segment = F.col("own").isNull() & ~ornament & F.col("reduced").rlike("^[a-z0-9_]+$") & (F.trim(F.coalesce("label", F.lit(""))) != "")
    known = known.withColumn("kind", F.when(F.col("own").isNotNull() & first, F.col("own")).when(segment, "segment").otherwise("extra"))
    there = F.collect_set("kind").over(Window.partitionBy(by))
    also = [F.when((F.col("kind") == other) & ~F.array_contains("there", F.lit(missing)), F.lit(missing)) for missing, other in STAND_INS.items()]
    out = known.withColumn("there", there).select(by, F.explode(F.array_compact(F.array("kind", *also))).alias("role"), F.trim("label").alias("label"), "at")
    return out.where("role <> 'time_gun'")


def require(roles: DataFrame, wanted: Sequence[str], by: str = "source") -> DataFrame:
    """``by, places, segments``: for each source the places of its roles as a map, and its segments (``at, label``).

    Reading a source that lacks one of ``wanted`` fails, and the error names source and role.
    """
    single = F.collect_list(F.when(~F.col("role").isin("segment", "extra"), F.struct("role", "at")))
    segments = F.collect_list(F.when(F.col("role") == "segment", F.struct("at", "label")))
    places = roles.groupBy(by).agg(F.map_from_entries(single).alias("places"), F.array_sort(segments).alias("segments"))
    missing = F.filter(F.array(*map(F.lit, wanted)), lambda r: ~F.array_contains(F.map_keys("places"), r))
    error = F.concat(F.lit("columns missing in "), F.col(by).cast("string"), F.lit(": "), F.array_join(missing, ", "))
    # the check is the column that is used, so that no plan can leave it out
    checked = F.when(F.size(missing) == 0, F.col("places")).otherwise(F.raise_error(error).cast("map<string,int>"))
    return places.select(by, checked.alias("places"), "segments")
