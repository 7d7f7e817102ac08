"""Seasons, months and dates written as text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import bound, deaccent, of

#: A season starts on the first day of this month and is named by the year of its start.
FIRST_MONTH = 9
#: Names of months, whole and short.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9,
    "octobre": 10, "novembre": 11, "decembre": 12,
    "janv": 1, "fevr": 2, "avr": 4, "juil": 7, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}


def season_of(c: Column | str) -> Column:
    return (F.year(of(c)) - (F.month(of(c)) < FIRST_MONTH).cast("int")).cast("bigint")


def season_label(c: Column | str) -> Column:
    year = of(c).cast("bigint")
    return F.format_string("Saison %d — %d", year, year + 1)


def in_seasons(c: Column | str, seasons: Iterable[int]) -> Column:
    """The date lies in one of ``seasons``; null dates don't. Closed ranges, so that file statistics prune. No season: no filter."""
    ranges = [of(c).between(F.lit(dt.date(y, FIRST_MONTH, 1)), F.lit(dt.date(y + 1, FIRST_MONTH - 1, 31))) for y in seasons]
    return F.coalesce(reduce(lambda a, b: a | b, ranges), F.lit(False)) if ranges else F.lit(True)


def parse_seasons(text: str | None) -> list[int]:
    """Years of a comma-separated list in order, each once; what isn't a usable year is left out."""
    years = []
    for token in (text or "").split(","):
        try:
            year = int(token.strip())
        except ValueError:
            continue
        if dt.MINYEAR <= year < dt.MAXYEAR and year not in years:
            years.append(year)
    return years


def seasons_of_text(c: Column | str) -> Column:
    """``parse_seasons`` over a column, as an array of int."""
    years = F.transform(F.split(F.coalesce(of(c), F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(years, lambda y: y.isNotNull() & y.between(dt.MINYEAR, dt.MAXYEAR - 1)))


def month_of(c: Column | str) -> Column:
    return F.date_format(of(c), "yyyy-MM")


def iso_date(c: Column | str) -> Column:
    """The date of an ISO text; null for all else."""
    text = of(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def written_date(c: Column | str) -> Column:
    """The first day of ``16 mai 2026``, ``16–17 mai 2026`` or ``12 avr. 2026``; null if there is none or no such day.

    Word by word: a month stands between a day, or two, and a year.
    """
    number = F.create_map(*(F.lit(x) for x in chain.from_iterable(MONTHS.items())))
    joined = F.regexp_replace(F.lower(deaccent(c)), r"(?U)\s*[-–—/]\s*", "-")
    found = bound(F.split(F.trim(joined), r"(?U)\s+"), lambda words: dates_among(words, number))  # no-break spaces too
    return F.try_to_date(F.try_element_at(found, F.lit(1)), "yyyy-M-d")


def dates_among(words: Column, number: Column) -> Column:
    """The dates in figures that months among ``words`` have their days and years beside; ``number`` maps months to figures."""
    word = lambda k: F.coalesce(F.try_element_at(words, k), F.lit(""))

    def day_at(k: Column) -> Column:
        """The date whose month is word ``k``, in figures; null if its neighbours don't fit."""
        month = F.try_element_at(number, F.rtrim(word(k), F.lit(".")))
        one_before = F.when(k > 2, word(F.greatest(k - 2, F.lit(1)))).otherwise(F.lit(""))
        days = F.when(one_before.rlike(r"\d$"), F.concat(one_before, F.lit("-"), word(k - 1))).otherwise(word(k - 1))
        day = F.regexp_extract(days, r"(\d{1,2})(?:-\d{1,2})?$", 1)
        year = F.regexp_extract(word(k + 1), r"^\d{4}", 0)
        return F.when(month.isNotNull() & (day != "") & (year != ""), F.concat_ws("-", year, month, day))

    places = F.when(F.size(words) > 2, F.sequence(F.lit(2), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, day_at), lambda x: x.isNotNull())


def any_date(c: Column | str) -> Column:
    """The first reading that works: ISO, ``dd/mm/yyyy``, month in words."""
    text = F.trim(of(c))
    return F.coalesce(
        F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"),
        F.try_to_date(F.regexp_extract(text, r"^(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy"),
        written_date(text),
    )
