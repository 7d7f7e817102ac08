"""Status of a participation, from labels, flags and times."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import of, strip_accents

FINISHER, DNF, DNS, DSQ = "finisher", "DNF", "DNS", "DSQ"
NON_FINISHERS = (DNF, DNS, DSQ)
#: Labels, in lower case without accents and punctuation.
LABELS = {
    "dsq": DSQ, "disq": DSQ, "disqualifie": DSQ, "disqualifies": DSQ, "disqualified": DSQ, "dq": DSQ,
    "dnf": DNF, "abd": DNF, "abandon": DNF, "abandons": DNF, "ab": DNF,
    "dns": DNS, "nonpartant": DNS, "nonpartants": DNS, "np": DNS, "forfait": DNS, "ff": DNS,
    "finisher": FINISHER, "classe": FINISHER, "fin": FINISHER, "ok": FINISHER,
}


def status_of_label(c: Column | str) -> Column:
    """Status that a label stands for; empty if it is unknown, empty or null."""
    key = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(LABELS.items())))
    return F.coalesce(F.try_element_at(table, key), F.lit(""))


def filled(c: Column | str) -> Column:
    return F.coalesce(of(c), F.lit("")) != ""


def status_or_default(status: Column | str, total_time: Column | str) -> Column:
    """The status given, else finisher with a time and DNF without."""
    return F.when(filled(status), of(status)).when(filled(total_time), F.lit(FINISHER)).otherwise(F.lit(DNF))


def status_of_flags(otherwise: Column | str, **flags: Column | str) -> Column:
    """The first flag that is true, in the order given (``DNS=..., DSQ=...``), else ``otherwise``."""
    out = F.when(F.lit(False), F.lit(""))
    for name, flag in flags.items():
        out = out.when(F.coalesce(of(flag), F.lit(False)), F.lit(name))
    return out.otherwise(of(otherwise) if not isinstance(otherwise, str) else F.lit(otherwise))


def status_of_labels(*labels: Column | str, not_started: Column | str | None = None) -> Column:
    """The first label that is known; else DNS if ``not_started``, else empty."""
    known = [F.nullif(status_of_label(c), F.lit("")) for c in labels]
    flag = F.when(F.coalesce(of(not_started), F.lit(False)), F.lit(DNS)) if not_started is not None else F.lit(None).cast("string")
    return F.coalesce(*known, flag, F.lit(""))


def status_of_result(label: Column | str, total_time: Column | str, rank: Column | str) -> Column:
    """A known label; else finisher with a time or a rank, else DNF."""
    known = status_of_label(label)
    return F.when(known != "", known).when(filled(total_time) | of(rank).isNotNull(), F.lit(FINISHER)).otherwise(F.lit(DNF))


def only_finishers(value: Column | str, status: Column | str) -> Column:
    """Times and ranks of those who didn't finish are void."""
    return F.when(~F.coalesce(of(status), F.lit("")).isin(*NON_FINISHERS), of(value))


def is_non_finisher(status: Column | str) -> Column:
    return F.upper(F.coalesce(of(status), F.lit(""))).isin(*NON_FINISHERS)


def display_group(status: Column | str) -> Column:
    """0 for those ranked, then DNF, DSQ, DNS; upper and lower case are one, blanks around count."""
    s = F.upper(F.coalesce(of(status), F.lit("")))
    return F.when(s == DNF, 1).when(s == DSQ, 2).when(s == DNS, 3).otherwise(0)


def status_class(status: Column | str) -> Column:
    """finisher, dnf, dns, dsq or unknown, blanks around and case apart."""
    s = F.lower(F.trim(F.coalesce(of(status), F.lit(""))))
    return F.when(s.isin(FINISHER, "dnf", "dns", "dsq"), s).otherwise(F.lit("unknown"))


def gender_class(gender: Column | str) -> Column:
    """``F`` or ``M`` by the first letter (f, w; m, h), else null."""
    g = F.lower(F.substring(F.trim(of(gender)), 1, 1))
    return F.when(g.isin("f", "w"), F.lit("F")).when(g.isin("m", "h"), F.lit("M"))


def gender_of_category(category: Column | str, suffix: bool = False, teams: tuple[str, ...] = ("MX", "EQ")) -> Column:
    """Gender in a category code, by its first or last letter; codes of teams have none."""
    c = F.upper(F.trim(F.coalesce(of(category), F.lit(""))))
    letter = F.regexp_extract(c, r"([FMH])$" if suffix else r"^([FMH])", 1)
    team = reduce(lambda a, b: a | b, (c.startswith(t) for t in teams), F.lit(False))
    return F.when(team | (letter == ""), F.lit("")).when(letter == "F", F.lit("F")).otherwise(F.lit("M"))
