"""URL functions on columns.

A URL is parsed by one pattern (scheme, authority, path, query, fragment); what doesn't match is unparseable.
Percent-encoding stays as it is, except that a query's %20 becomes +; default ports are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.schemas import LINK_TRACKING_NAMES, MASTHEAD_LINKS, SOCIAL_HOSTS, TRACKING_LINKS, TRACKING_NAMES, TRACKING_PREFIXES

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark; empty if there is none or the URL can't be parsed."""
    return F.regexp_extract(F.trim(url), URL, n)


def parseable(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(URL), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host without user, port and one leading www.; null if the URL can't be parsed."""
    name = F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^[^@]*@", ""), ":[0-9]*$", ""))
    return F.when(parseable(url), F.regexp_replace(name, "^www\\.(?=.)", ""))


def parameters(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(part(url, 4), "^\\?", ""), "&"), lambda p: p != "")


def name_of(parameter: Column) -> Column:
    return F.lower(F.split(parameter, "=")[0])


def canonical(url: Column) -> Column:
    tracks = lambda p: name_of(p).isin(TRACKING_NAMES) | name_of(p).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.filter(parameters(url), lambda p: ~tracks(p))
    placed = F.transform(kept, lambda p, i: F.struct(F.split(p, "=")[0].alias("name"), i.alias("place"), F.replace(p, F.lit("%20"), F.lit("+")).alias("text")))
    query = F.array_join(F.transform(F.array_sort(placed), lambda p: p["text"]), "&")
    scheme = F.lower(part(url, 1))
    authority = F.regexp_replace(F.lower(part(url, 2)), "^www\\.(?=.)", "")
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.when(part(url, 3).isin("", "/"), "/").otherwise(F.regexp_replace(part(url, 3), "/$", ""))
    whole = F.concat(scheme, F.lit("://"), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(parseable(url), whole).otherwise(F.trim(url))


def suffixes(name: Column) -> Column:
    """A host and every parent domain of it."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def link_kind(url: Column) -> Column:
    """other, social, tracking, masthead or article; the first that applies."""
    target = F.lower(F.concat(F.when(part(url, 3) == "", "/").otherwise(part(url, 3)), part(url, 4)))
    root = part(url, 3).isin("", "/") & F.forall(parameters(url), lambda p: name_of(p).isin(LINK_TRACKING_NAMES))
    any_of = lambda patterns: target.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.when(~parseable(url), "other").when(host(url).isin(SOCIAL_HOSTS), "social").when(any_of(TRACKING_LINKS), "tracking").when(any_of(MASTHEAD_LINKS) | root, "masthead").otherwise("article")
