"""Canonical URLs, hosts and digests as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that name a campaign, not a page
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "msclkid"]
_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-case host in ASCII form, without user information and port; empty where there is none or it has no such form."""
    said = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", ""), r":[0-9]*$", ""))
    ascii_ = lambda h: F.when(h.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h), F.lit(""))).otherwise(h)
    return F.get(F.transform(F.array(said), ascii_), F.lit(0))  # the host is read once


def domain(url: Column) -> Column:
    """Host without ``www.`` and a final dot; a bare name counts as an address."""
    whole = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    return F.regexp_replace(F.regexp_replace(host(whole), r"\.+$", ""), r"^www\.", "")


def domain_match(url: Column, domains: list[str]) -> Column:
    """Whether the address lies in one of the domains or below."""
    known = F.array(*[F.lit(x) for x in domains])
    lies = lambda d: F.exists(known, lambda x: (d == x) | F.endswith(d, F.concat(F.lit("."), x)))
    return F.coalesce(F.get(F.transform(F.array(domain(url)), lies), F.lit(0)), F.lit(False))  # the domain is read once


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#\s]*)", 1)


def parameters(url: Column) -> Column:
    """Array of (key, value) of the query, decoded, in order; blank values stay, an undecodable part is left as it is."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#\s]*)", 1), "&"), lambda x: x != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(parts, lambda x: F.struct(plain(F.regexp_extract(x, "^([^=]*)", 1)).alias("key"), plain(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))


def parameter(url: Column, key: str) -> Column:
    """First value of a parameter; null where it is missing or blank."""
    return F.nullif(F.get(F.filter(parameters(url), lambda x: x["key"] == key), F.lit(0))["value"], F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, campaign parameters, final slash or fragment.

    http and https, www, path case and the order of parameters stay apart, as redirects are not assumed.  Null
    without an http host, with user information, or with a port that is no number.
    """
    s, h, authority = scheme(url), host(url), F.regexp_extract(url, _AUTHORITY, 1)
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    usual = (port == "") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443"))
    kept = F.filter(parameters(url), lambda x: ~F.startswith(F.lower(x["key"]), F.lit(TRACKING_PREFIX)) & ~F.lower(x["key"]).isin(TRACKING_KEYS))
    said = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(kept, lambda x: F.concat(said(x["key"]), F.lit("="), said(x["value"]))), "&")
    good = s.isin("http", "https") & (h != "") & ~authority.rlike("^.+@") & ~authority.rlike(r"\][^:]|:[^0-9\]:]+$")
    place = F.coalesce(F.nullif(F.regexp_replace(path(url), "/+$", ""), F.lit("")), F.lit("/"))
    return F.when(good, F.concat(s, F.lit("://"), h, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), place, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _without_dots(place: Column) -> Column:
    """A path with its ``.`` and ``..`` steps taken, however many; it never climbs above the root."""
    steps = F.split(place, "/")
    last = F.element_at(steps, -1)
    taken = F.aggregate(
        F.filter(steps, lambda s: s != "."), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    ended = F.when(last.isin(".", ".."), F.concat(taken, F.array(F.lit("")))).otherwise(taken)
    whole = F.array_join(ended, "/")
    return F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(F.lit("/"), whole))


def resolved(base: Column, href: Column) -> Column:
    """An address found on a page: absolute, from the scheme, from the root, a query or fragment of the page, or beside it."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare, folder = F.regexp_extract(base, r"^([^?#]*)", 1), F.regexp_extract(path(base), r"^(.*/)", 1)
    place, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    dotted = lambda c: F.when(c.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(c)).otherwise(c)
    beside = F.concat(F.when(folder == "", "/").otherwise(folder), place)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, dotted(place), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(bare, href))
        .when(href == "", base)
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .otherwise(F.concat(origin, dotted(beside), rest))
    )


def _quoted(part: Column) -> Column:
    """A value as JSON text; null as null; control characters in lower-case hexadecimal."""
    said = F.regexp_extract(F.to_json(F.array(part)), r"(?s)^\[(.*)\]$", 1)
    low = said
    for code in ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"):
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return F.coalesce(F.when(part.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), low).otherwise(said), F.lit("null"))


def key_digest(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON list with a space after each comma."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[_quoted(p) for p in parts]), F.lit("]")), 256)
