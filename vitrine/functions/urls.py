"""Hosts, paths and markets of URLs as columns."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codes import countries, currencies
from .constants import (
    CONTAINER_SEGMENT_PATTERN,
    DETAIL_CONTAINER_PATTERN,
    DETAIL_ENDING_PATTERN,
    GENERIC_TAIL_PATTERN,
    GENERIC_TLDS,
    LANGUAGES,
    LISTING_ROUTES,
    LISTING_SEGMENT_PATTERN,
    LOCALE_SEGMENT_PATTERN,
    PAGE_SEGMENT_PATTERN,
    PATH_LANGUAGES,
    PRODUCT_QUERY_PATTERN,
    PRODUCT_ROUTES,
    PUBLISHER_PATTERN,
    RESULT_SEGMENT_PATTERN,
    SHOP_ROUTES,
)
from .numbers import col


def page_host(c: Column | str) -> Column:
    """The host of an http(s) URL in lower case, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), "(?i)^https?://([^/?#]+)", 1))


def canonical_host(c: Column | str) -> Column:
    """Host or domain without scheme, port and www."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(x, "^([^/?#]*)", 1), r":\d+$", ""), r"^www\.", "")


def host_suffixes(c: Column | str) -> Column:
    """A host and all domains it belongs to, from the longest to the last label."""
    labels = F.split(col(c), r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def registrable_label(c: Column | str) -> Column:
    """The label that a registrant chose: before the last, or before a two-part suffix such as co.uk."""
    labels = F.split(canonical_host(c), r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin("co", "com", "net", "org", "gov", "ac", "edu")
    return F.when(n == 1, labels[0]).when(two, F.element_at(labels, -3)).otherwise(F.element_at(labels, -2))


def is_public_host(c: Column | str) -> Column:
    """A dotted name that is no local name, or an IPv4 address outside the private, loopback, link-local and reserved ranges."""
    h = F.lower(col(c))
    v4 = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    part = lambda i: F.split_part(h, F.lit("."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    valid = F.greatest(a, b, part(3), part(4)) <= 255
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    name = h.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]{0,61}[a-z0-9]$") & ~h.rlike(r"(^|\.)(localhost|local|internal|test|invalid|example|home|lan)$")
    return F.coalesce(F.when(v4, valid & ~private).otherwise(name), F.lit(False))


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), "(?i)^https?://[^/?#]*([^?#]*)", 1)


def path_segments(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(url_path(c)), "/"), lambda s: s != "")


def product_path(c: Column | str) -> Column:
    """What follows the product route in a path, or else a shop's; null if there is no such route or nothing follows."""
    segments = path_segments(c)

    def first(routes: list[str]) -> Column:
        return F.array_min(F.array_compact(F.array(*(F.nullif(F.array_position(segments, F.lit(r)), F.lit(0)) for r in routes))))

    at = F.coalesce(first(PRODUCT_ROUTES), first(SHOP_ROUTES))
    rest = F.slice(segments, at.cast("int") + 1, F.size(segments))
    return F.when(F.size(rest) > 0, F.array_join(rest, "/"))


def is_listing_route(c: Column | str) -> Column:
    """The path ends in a listing: its last segments name a category, a search or a tag, and no product route follows."""
    return F.coalesce(F.arrays_overlap(path_segments(c), F.array(*map(F.lit, LISTING_ROUTES))) & product_path(c).isNull(), F.lit(False))


def is_listing_url(c: Column | str) -> Column:
    """Whether a URL lists products, by its query and by words of several languages in its path; what is no http URL counts as a listing."""
    url = F.coalesce(col(c), F.lit(""))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    segments = F.filter(F.split(F.coalesce(F.try_url_decode(url_path(url)), url_path(url)), "/"), lambda s: s != "")
    plain = lambda s: F.translate(F.lower(s), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")

    def lists(s: Column, i: Column) -> Column:
        contained = F.coalesce(F.get(segments, i - 1).rlike(CONTAINER_SEGMENT_PATTERN), F.lit(False))
        listed = s.rlike(LISTING_SEGMENT_PATTERN) & ((i == 0) | contained | ~s.rlike(GENERIC_TAIL_PATTERN))
        return plain(s).rlike(RESULT_SEGMENT_PATTERN) | s.rlike(PAGE_SEGMENT_PATTERN) | listed

    found = F.exists(F.transform(segments, lists), lambda x: x)
    return (page_host(url) == "") | F.exists(keys, lambda k: ~k.rlike(PRODUCT_QUERY_PATTERN)) | found


def is_detail_url(c: Column | str) -> Column:
    """Whether a URL is one product's page: the last segment after a product container, or a page file, with nothing but languages before; pages of publishers are none."""
    path = F.regexp_replace(F.coalesce(F.try_url_decode(url_path(c)), url_path(c)), "/+$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(segments)
    container = F.array_position(F.transform(segments, lambda s: s.rlike(DETAIL_CONTAINER_PATTERN)), F.lit(True)).cast("int")
    languages = lambda upto: F.forall(F.slice(segments, F.lit(1), F.greatest(upto, F.lit(0))), lambda s: s.rlike(LOCALE_SEGMENT_PATTERN))
    inside = (container > 0) & (container == n - 1) & languages(container - 1)
    ending = F.coalesce(F.element_at(segments, -1).rlike(DETAIL_ENDING_PATTERN), F.lit(False)) & languages(n - 1)
    return F.coalesce((n > 0) & ~path.rlike(PUBLISHER_PATTERN) & (inside | ending), F.lit(False))


def product_path_priority(c: Column | str) -> Column:
    """0 for product pages, 1 for listings, 2 for all else."""
    return F.when(product_path(c).isNotNull(), 0).when(is_listing_route(c), 1).otherwise(2)


def locale_neutral_url(c: Column | str) -> Column:
    """Host and path without a leading language or market segment and without query."""
    path = F.regexp_replace(url_path(c), r"(?i)^/[a-z]{2}([-_][a-z]{2})?(?=/|$)", "")
    return F.concat(canonical_host(page_host(c)), F.when(F.regexp_replace(path, "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, "/+$", "")))


def country_code(value: str, known: frozenset[str]) -> str:
    """An ISO country from a code or a locale; '' if it is none."""
    v = (value or "").strip().replace("_", "-").upper()
    v = v if re.fullmatch("[A-Z]{2}", v) else (m[1] if (m := re.fullmatch("[A-Z]{2}-([A-Z]{2})", v)) else "")
    v = "GB" if v == "UK" else v
    return v if v in known else ""


MARKET = T.StructType().add("country", "string").add("currency", "string").add("explicit", "boolean").add("conflict", "boolean").add("context", "string")
#: Query keys that select a country, and those that select a currency.
COUNTRY_KEYS = {"country", "country_code", "countrycode", "market", "region", "locale"}
CURRENCY_KEYS = {"currency", "currency_code", "currencycode"}


def market_of(url: str | None, known: frozenset[str], money: frozenset[str]) -> tuple[str, str, bool, bool, str]:
    """Country and currency that a URL selects: by query, by the segments before a product route, by the country domain. Several of a kind are a conflict and select nothing.

    known and money are the codes of all countries and currencies.
    """
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").removeprefix("www.")
        query = [(k.lower(), v.strip()) for k, v in parse_qsl(u.query, keep_blank_values=True)]
    except ValueError:
        return "", "", False, False, ""
    if not host:
        return "", "", False, False, ""
    chosen: dict[str, None] = {}
    paid: dict[str, None] = {}
    explicit = vague_country = vague_currency = False

    def select(token: str) -> None:
        nonlocal explicit, vague_country
        explicit = True
        code = country_code(token, known)
        if code:
            chosen[code] = None
        else:
            vague_country = True

    for k, v in query:
        if k in COUNTRY_KEYS and not re.fullmatch("(?i)(?:[a-z]{2}[-_])?EU", v):
            # A locale selects a country only if it names one.
            select("" if k == "locale" and not re.fullmatch("(?i)[a-z]{2}[-_][a-z]{2}", v) else v)
        elif k in CURRENCY_KEYS:
            explicit = True
            if v.upper() in money:
                paid[v.upper()] = None
            else:
                vague_currency = True
    segments = [s for s in u.path.split("/") if s]
    routes = [i for kind in (PRODUCT_ROUTES, SHOP_ROUTES) for i, s in enumerate(segments) if s.lower() in kind]
    at = routes[0] if routes else min(len(segments), 1)
    for s in segments[:at]:
        s = s.strip().replace("_", "-").upper()
        if m := re.fullmatch("([A-Z]{2})-([A-Z]{2})", s):
            if m[2] != "EU":
                token = m[2] if m[1] in LANGUAGES else m[1]
                select("" if token == "UK" else token)
        elif re.fullmatch("[A-Z]{2}", s) and s not in PATH_LANGUAGES and not (s in LANGUAGES and not country_code(s, known)):
            select("" if s == "UK" else s)
    tld = re.search(r"\.([a-z]{2})$", host)
    domain = "GB" if re.search(r"\.(?:co\.)?uk$", host) else country_code(tld[1], known) if tld else ""
    if domain and domain not in GENERIC_TLDS:
        chosen[domain] = None
    if len(chosen) > 1 or len(paid) > 1:
        return "", "", explicit, True, "conflict"
    country, currency = next(iter(chosen), ""), next(iter(paid), "")
    parts = [f"country:{country}" if country else "country:?" * vague_country, f"currency:{currency}" if currency else "currency:?" * vague_currency]
    return country, currency, explicit, False, "|".join(p for p in parts if p)


def market_context(url: Column | str) -> Column:
    """country, currency, explicit, conflict and context of a URL column."""
    known, money = countries(), currencies()

    @F.pandas_udf(MARKET)
    def contexts(s: pd.Series) -> pd.DataFrame:
        distinct = {u: market_of(u, known, money) for u in s.unique()}
        return pd.DataFrame([distinct[u] for u in s], columns=["country", "currency", "explicit", "conflict", "context"])

    return contexts(col(url))


def source_key(domain: Column | str, url: Column | str, context: Column) -> Column:
    """The key of a product page: domain, market and what follows the product route; '' if it is no product page."""
    path = product_path(url)
    market = F.when(context != "", F.concat(F.lit("@"), context)).otherwise("")
    return F.coalesce(F.concat(canonical_host(domain), F.lit("|"), market, F.lit("/product/"), path), F.lit(""))
