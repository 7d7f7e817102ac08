"""Labels and names as column expressions: folding, search, similarity, splitting.

Every function takes and returns columns, so Catalyst sees through all of them. Null in gives null out
unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tab, line feed, carriage return and no-break space count as blanks in labels.
BLANKS = "\t\n\r "
LATIN = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
COMPATIBLE = [*range(0xA0, 0x250), *range(0x2000, 0x2150), *range(0xFB00, 0xFB07)]


def of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def unaccented(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """From the Unicode database: single letters and what they become, and those that become several."""
    one: dict[str, str] = {}
    more: list[tuple[str, str]] = []
    for code in LATIN if form == "NFD" else sorted({*LATIN, *COMPATIBLE}):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1:
            one[c] = plain
        elif plain != c and plain:
            more.append((c, plain))
    return "".join(one), "".join(one.values()), tuple(more)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression would be computed anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def deaccent(c: Column | str) -> Column:
    """Latin letters without their accents; letters that only look joined (``œ``, ``ß``) stay."""
    source, target, _ = unaccented("NFD")
    return F.regexp_replace(F.translate(of(c), source, target), r"[̀-ͯ]", "")


def strip_accents(c: Column | str) -> Column:
    """As ``deaccent``, and compatibility forms (ligatures, fractions, superscripts) become plain; null gives an empty string."""
    source, target, more = unaccented("NFKD")
    plain = F.regexp_replace(F.translate(F.coalesce(of(c), F.lit("")), source, target), r"[̀-ͯ]", "")
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), more, plain)


def normalize_label(c: Column | str) -> Column:
    """Comparable form of a label: blanks are spaces, no spaces at the ends, one between words, lower case."""
    spaced = F.translate(of(c), BLANKS, " " * len(BLANKS))
    return F.regexp_replace(F.lower(F.trim(spaced)), " {2,}", " ")


def normalize_label_unicode(c: Column | str) -> Column:
    """As ``normalize_label`` over all Unicode white space; null gives an empty string."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(of(c), F.lit("")), r"(?U)\s+", " ")))


def has_label(c: Column | str, labels: Iterable[str]) -> Column:
    """Whether the label is one of ``labels`` (in comparable form), whole and never as a part; null is not."""
    return F.coalesce(normalize_label(c).isin(*labels), F.lit(False))


def searchable(c: Column | str) -> Column:
    return F.lower(deaccent(c))


def name_matches(term: str, *names: Column | str) -> Column:
    """Every word of ``term`` is part of one of ``names``, whatever the case and accents. A term without words matches nothing."""
    plain = "".join(x for x in unicodedata.normalize("NFD", term) if not unicodedata.combining(x)).lower()
    if not plain.split():
        return F.lit(False)
    folded = [F.coalesce(searchable(n), F.lit("")) for n in names]
    return reduce(and_, (reduce(lambda a, b: a | b, (n.contains(w) for n in folded)) for w in plain.split()))


def contains_text(c: Column | str, part: str) -> Column:
    """``part`` is in the text, whatever the case; ``%`` and ``_`` are ordinary characters."""
    return F.lower(of(c)).contains(part.lower())


def trigrams(c: Column | str) -> Column:
    """Distinct three-letter pieces of every word, words padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(of(c)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    pieces = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(pieces))


def common_trigrams(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Numbers of trigrams that both sides have, and that either has."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams over all trigrams, 0 to 1; 0 if neither side has a word."""
    both, either = common_trigrams(a, b)
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def fuzzy_matches(c: Column | str, term: str, threshold: float = 0.3) -> Column:
    """The term is part of the text or similar to it."""
    return contains_text(c, term) | (similarity(c, F.lit(term)) >= threshold)


def split_name(c: Column | str) -> Column:
    """``struct(last, first)`` of a full name: an upper-case block in front or at the end is the last name, else the last word is.

    Only the first line counts. An empty or null name gives two empty strings.
    """
    line = F.trim(F.split_part(F.trim(F.coalesce(of(c), F.lit(""))), F.lit("\n"), F.lit(1)))
    words = F.filter(F.split(F.regexp_replace(line, r"\s+", " "), " "), lambda w: w != "")
    upper = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    n = F.size(words)

    def run(of_words: Column) -> Column:
        """Length of the upper-case block in front."""
        first_other = F.array_position(F.transform(of_words, lambda w: upper(w)), F.lit(False))
        return F.when(first_other == 0, F.size(of_words)).otherwise(first_other - 1).cast("int")

    front, back = run(words), run(F.reverse(words))
    join = lambda x: F.array_join(x, " ")
    part = lambda a, size: join(F.slice(words, a, size))
    one = F.lit(1)
    return (
        F.when(n == 0, F.struct(F.lit("").alias("last"), F.lit("").alias("first")))
        .when(front > 0, F.struct(part(one, front).alias("last"), part(front + 1, F.greatest(n - front, F.lit(0))).alias("first")))
        .when(back > 0, F.struct(part(F.greatest(n - back + 1, one), back).alias("last"), part(one, F.greatest(n - back, F.lit(0))).alias("first")))
        .otherwise(F.struct(part(F.greatest(n, one), one).alias("last"), part(one, F.greatest(n - 1, F.lit(0))).alias("first")))
    )


def comparable_name(c: Column | str) -> Column:
    """What stays of an event's name from one publication to the next: no accents, edition ordinal, year or punctuation."""
    text = F.lower(deaccent(c))
    text = F.regexp_replace(text, r"^\d+\s*(?:er|ere|eme|e)\b", " ")
    text = F.regexp_replace(text, r"\b(?:19|20)\d{2}\b", " ")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


#: Words of an event's name that don't belong to its place. Sports, the words between a sport and its place, and sizes at the end.
SPORTS = (
    "triathlon", "tri", "duathlon", "swimrun", "swim-run", "swim run", "aquathlon", "aquarun", "bikerun", "bike-run", "bike run",
    "runbike", "run-bike", "run bike", "challenge", "ironman", "half", "ultra", "trail",
)
BEFORE_PLACES = ("de", "la", "le", "les", "des", "du", "international", "saint", "sainte")
SIZE_WORDS = ("s", "m", "l", "xl", "xs", "xxl", "sprint", "olympique", "olympic", "half", "longue", "distance", "format")
LENGTHS = ("plage", "plages", "km", "h")


def place_of(c: Column | str) -> Column:
    """The place in an event's name: without year, edition, sport, size, length and what follows a dash or ``à``; the name itself if nothing stays.

    The name is read word by word; what is still to come decides whether a sport's name is one (the last word is not).
    """
    without_year = F.regexp_replace(of(c), r"(?U)\b20\d{2}\b", "")  # wherever it stands, in brackets or beside another one
    words = F.filter(F.split(without_year, r"(?U)\s+"), lambda w: w != "")
    words = F.when(F.try_element_at(words, F.lit(-1)).rlike("^[-–—]+$"), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    place = bound(words, place_among)
    return F.when(place == "", of(c)).otherwise(place)


def place_among(words: Column) -> Column:
    """`place_of` a name's words without its year; empty if nothing stays."""
    n = F.size(words)
    state = lambda kept, opening, skip, over: F.struct(kept.alias("kept"), opening.alias("opening"), skip.alias("skip"), over.alias("over"))
    no, yes = F.lit(False), F.lit(True)

    def read(s: Column, k: Column) -> Column:
        word, low = F.element_at(words, k), F.lower(F.element_at(words, k))
        coming = F.lower(F.coalesce(F.try_element_at(words, k + 1), F.lit("")))
        pair = F.concat(low, F.lit(" "), coming)
        number = low.rlike(r"^\d+$")
        two = (low.rlike(r"^\d+e?$") & (coming == "edition")) | (number & coming.isin(*LENGTHS)) | (pair.isin(*SPORTS) & (k + 1 < n))
        name = F.when(s["opening"], F.regexp_replace(word, "(?i)^(d['’])?(sainte?-)?", "")).otherwise(word)
        return (
            F.when(s["over"], s)
            .when(s["skip"], state(s["kept"], s["opening"], no, no))
            .when((F.size(s["kept"]) > 0) & low.isin("à", "a", "-", "–") & (k < n), state(s["kept"], no, no, yes))
            .when(two, state(s["kept"], s["opening"] | pair.isin(*SPORTS), yes, no))
            .when(low.isin(*SPORTS) & (k < n), state(s["kept"], yes, no, no))
            .when(low.rlike(rf"^\d+-?({'|'.join(LENGTHS)})$"), state(s["kept"], s["opening"], no, no))
            .when(s["opening"] & low.isin(*BEFORE_PLACES) & (k < n), state(s["kept"], yes, no, no))
            .otherwise(state(F.concat(s["kept"], F.array(name)), no, no, no))
        )

    start = state(F.array().cast("array<string>"), no, no, no)
    end = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, read)

    def joined(end: Column) -> Column:
        kept = end["kept"]
        sized = ~end["over"] & (F.size(kept) > 1) & F.lower(F.try_element_at(kept, F.lit(-1))).isin(*SIZE_WORDS)
        kept = F.when(sized, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.trim(F.regexp_replace(F.array_join(F.filter(kept, lambda w: w != ""), " "), "[-–—]+$", ""))

    return bound(end, joined)


def qualified_name(name: Column | str, qualifier: Column | str) -> Column:
    """``name - qualifier``, unless the qualifier is blank or already part of the name."""
    name, q = of(name), F.trim(F.coalesce(of(qualifier), F.lit("")))
    there = (q == "") | F.lower(F.coalesce(name, F.lit(""))).contains(F.lower(q))
    return F.when(there, name).otherwise(F.concat(F.coalesce(name, F.lit("")), F.lit(" - "), q))


def is_team_name(c: Column | str, markers: Iterable[str] = ("/", "&", "+")) -> Column:
    """The name is of several people: it holds one of ``markers``."""
    return F.coalesce(reduce(lambda a, b: a | b, (of(c).contains(m) for m in markers)), F.lit(False))


def identities_differ(a: Column | str, b: Column | str) -> Column:
    """Two names that can't be one person's; false if either is empty."""
    fold = lambda x: F.trim(F.regexp_replace(F.lower(strip_accents(x)), "[^a-z0-9]+", " "))
    words = lambda x: F.array_sort(F.split(fold(of(x)), " "))
    return (fold(of(a)) != "") & (fold(of(b)) != "") & (words(a) != words(b))


#: What Windows-1252 has at 0x80 to 0x9F; five bytes have no meaning there.
WINDOWS, CONTROLS = zip(*((bytes([b]).decode("cp1252"), chr(b)) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)), strict=True)


def repair_mojibake(c: Column | str) -> Column:
    """UTF-8 that was read as Windows-1252, read right; any other text as it is."""
    text = of(c)
    one_byte = text.rlike(f"^[\\x00-\\x7F\\xA0-\\xFF{''.join(WINDOWS)}]*$")
    raw = F.encode(F.translate(text, "".join(WINDOWS), "".join(CONTROLS)), "ISO-8859-1").cast("string")
    return F.when(one_byte, F.coalesce(F.try_validate_utf8(raw), text)).otherwise(text)
