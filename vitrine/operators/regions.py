"""Which market a site serves, inferred from what its pages show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import (
    ADDRESS_PATTERN,
    GLOBAL_PATTERN,
    REGION_ADDRESSES,
    REGION_CITIES,
    REGION_CURRENCIES,
    REGION_LOCALES,
    REGION_NAMES,
    REGION_PHONES,
    REGION_TLDS,
    REGION_WEIGHTS,
    SHARED_CURRENCY_WEIGHT,
    SHIPPING_PATTERN,
)
from ..functions.numbers import bound
from ..functions.urls import canonical_host


def _signal(country: Column | str, kind: str, value: Column | str, weight: int | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(country).alias("country"), F.lit(kind).alias("kind"), lit(value).alias("value"), F.lit(REGION_WEIGHTS[kind] if weight is None else weight).alias("weight"))


def region_signals(domain: Column, language: Column, document: Column, text: Column, prices: Column) -> Column:
    """country, kind, value and weight of every signal of one page: country domain, language, address, currency, phone, names of countries, where goods are sent from, and a global offer.

    language is the page's own; document its markup, text its words, prices its price texts in
    one string. A null says nothing.
    """
    fields = F.struct(*(F.coalesce(c, F.lit("")).alias(n) for n, c in (("domain", canonical_host(domain)), ("language", language), ("document", document), ("text", text), ("prices", prices))))
    return bound(fields, _signals)


def _signals(x: Column) -> Column:
    found = [F.when(x["domain"].rlike(f"(?i){p}"), _signal(c, "tld", x["domain"])) for c, p in REGION_TLDS.items()]
    own = F.lower(F.translate(x["language"], "_", "-"))
    spoken = F.element_at(F.create_map(*(F.lit(v) for kv in REGION_LOCALES.items() for v in kv)), F.when(own.isin(*REGION_LOCALES), own))
    found.append(F.when(spoken.isNotNull(), _signal(spoken, "language", x["language"])))
    for locale, country in REGION_LOCALES.items():
        seen = F.regexp_extract(x["document"], rf"(?i)\b({locale.replace('-', '[-_]')})\b", 1)
        found.append(F.when(seen != "", _signal(country, "language", seen)))
    address = F.trim(F.regexp_extract(x["document"], f"(?i){ADDRESS_PATTERN}", 1))
    found += [F.when(F.lower(address).rlike(f"^(?:{names})$"), _signal(c, "structured-address", address)) for c, names in REGION_ADDRESSES.items()]
    found += [F.when(x["prices"].rlike(f"(?i){p}"), _signal(c, "currency", money)) for c, (money, p) in REGION_CURRENCIES.items()]
    found.append(F.when(x["prices"].rlike(r"(?i)€|\bEUR\b") & spoken.isin("DE", "FR"), _signal(spoken, "currency", "EUR", SHARED_CURRENCY_WEIGHT)))
    found += [F.when(x["text"].rlike(p), _signal(c, "phone", code)) for c, (code, p) in REGION_PHONES.items()]
    for country, p in REGION_NAMES.items():
        seen = F.regexp_extract(x["text"], f"(?i)({p})", 1)
        found.append(F.when(seen != "", _signal(country, "explicit-market", seen)))
    everywhere = F.regexp_extract(x["text"], f"(?i)({GLOBAL_PATTERN})", 1)
    found.append(F.when(everywhere != "", _signal("GLOBAL", "global-market", everywhere)))
    cities = "|".join(city for own in REGION_CITIES.values() for city in own)
    sent = F.regexp_extract_all(x["text"], F.lit(rf"(?i)({SHIPPING_PATTERN}(?:{cities})\b)"), 1)
    country_of = F.create_map(*(F.lit(v) for c, own in REGION_CITIES.items() for city in own for v in (city, c)))
    last = lambda s: F.regexp_extract(F.lower(s), f"({cities})$", 1)
    sent = F.transform(sent, lambda s: _signal(F.element_at(country_of, last(s)), "fulfillment-location", s))
    return F.concat(F.array_compact(F.array(*found)), sent)
