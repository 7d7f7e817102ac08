"""Addresses of result pages: validity, comparable form, provider, sub-event and event id."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import of

#: Several digits, a dash and an edition number: an event's id on platforms that publish one.
EVENT_ID = r"\d{10,}-\d+"


def host_of(c: Column | str) -> Column:
    """The host in lower case without port; null for what is no address."""
    return F.lower(F.regexp_extract(F.try_parse_url(F.trim(of(c)), F.lit("AUTHORITY")), r"^(?:[^@]*@)?([^:]*)", 1))


def is_web_address(c: Column | str) -> Column:
    """http or https, with a host; malformed text is not one."""
    text = F.trim(of(c))
    scheme = F.lower(F.try_parse_url(text, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & (F.coalesce(host_of(text), F.lit("")) != ""), F.lit(False))


def normalize_url(c: Column | str) -> Column:
    """Comparable form: trimmed, scheme and host in lower case, no slash at the end, no fragment; the query stays."""
    text = F.regexp_replace(F.trim(of(c)), "#.*$", "")
    rule = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?.*)?$"
    scheme, authority, path, query = (F.regexp_extract(text, rule, k) for k in (1, 2, 3, 4))
    path = F.regexp_replace(path, "/+$", "")
    whole = F.concat(F.lower(scheme), F.lit("://"), F.lower(authority), F.when(path == "", F.lit("/")).otherwise(path), query)
    return F.when(text.rlike(rule), whole).otherwise(text)


def provider_of(c: Column | str, hosts: Mapping[str, Iterable[str]]) -> Column:
    """The first provider one of whose hosts is the address's host or a parent domain of it; null if there is none."""
    host, out = host_of(c), F.when(F.lit(False), F.lit(""))
    for provider, names in hosts.items():
        own = F.lit(False)
        for name in names:
            own = own | (host == name) | host.endswith(f".{name}")
        out = out.when(own, F.lit(provider))
    return out


def heat_slug(c: Column | str, folder: str = "resultats-courses") -> Column:
    """The sub-event that an address names: parameter ``heat``, or the third and last part of a path below ``folder``; empty if it names a whole event."""
    text = of(c)
    given = F.regexp_extract(F.coalesce(F.try_parse_url(text, F.lit("QUERY")), F.lit("")), "(?:^|&)heat=([^&]*)", 1)
    given = F.coalesce(F.try_url_decode(given), given)
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    third = F.when((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == folder), F.get(parts, F.lit(2)))
    return F.lower(F.when(given != "", given).otherwise(F.coalesce(third, F.lit(""))))


def event_id(c: Column | str, provider: Column | str, platforms: Iterable[str]) -> Column:
    """The event's id in the address, on ``platforms`` only; else empty."""
    return F.when(of(provider).isin(*platforms), F.regexp_extract(of(c), EVENT_ID, 0)).otherwise(F.lit(""))


def sub_url(base: Column | str, *parts: Column | str) -> Column:
    """Address of a part of an event, as a key of its own."""
    return F.concat_ws("/", F.regexp_replace(of(base), "/+$", ""), *(of(p).cast("string") for p in parts))
