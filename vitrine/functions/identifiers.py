"""Product identifiers and quantities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import UNITS
from .numbers import col
from .text import bilingual_normalize


def canonical_gtin(c: Column | str) -> Column:
    """A valid 8, 12, 13 or 14-digit number padded to 14 digits, else null; all digits equal is not valid."""
    raw = F.trim(col(c).cast("string"))
    full = F.lpad(raw, 14, "0")
    digit = lambda i: F.substring(full, i, 1).cast("int")
    total = sum((digit(i) * (3 if i % 2 else 1) for i in range(1, 14)), F.lit(0))
    good = raw.rlike(r"^(\d{8}|\d{12,14})$") & ~raw.rlike(r"^(\d)\1+$") & ((10 - total % 10) % 10 == digit(14))
    return F.when(good, full)


def shared_gtin(a: Column | str, b: Column | str) -> Column:
    """The first shared number of two arrays, '' if there is none."""
    both = F.array_intersect(F.coalesce(col(a), F.array().cast("array<string>")), F.coalesce(col(b), F.array().cast("array<string>")))
    return F.coalesce(F.get(both, 0), F.lit(""))


def conflicting_gtins(a: Column | str, b: Column | str) -> Column:
    """Both known and nothing shared."""
    return (F.coalesce(F.size(col(a)), F.lit(0)) > 0) & (F.coalesce(F.size(col(b)), F.lit(0)) > 0) & (shared_gtin(a, b) == "")


def parse_quantity(c: Column | str, ascii_only: bool = False) -> Column:
    """The one quantity that a text states, as kind, amount and unit; null if it states none or several."""
    names = {n: unit for unit, ns in UNITS.items() for n in ns}
    pattern = r"(?:^|\s)(\d+(?:\.\d+)?)\s*(" + "|".join(sorted(names, key=len, reverse=True)) + r")(?=$|\s)"
    x = bilingual_normalize(c, ascii_only)
    kinds = F.create_map(*(F.lit(v) for n, (kind, size, unit) in names.items() for v in (n, f"{kind}|{size!r}|{unit}")))

    def quantity(found: Column) -> Column:
        unit = F.split(F.element_at(kinds, F.regexp_extract(found, r"([^\d.\s]+)$", 1)), r"\|")
        amount = F.round(F.regexp_extract(found, r"(\d+(?:\.\d+)?)", 1).cast("double") * unit[1].cast("double"), 6)
        return F.struct(unit[0].alias("kind"), amount.alias("amount"), unit[2].alias("unit"))

    found = F.transform(F.regexp_extract_all(x, F.lit(pattern), 0), lambda m: quantity(F.trim(m)))
    sound = F.filter(found, lambda q: (q["amount"] > 0) & (q["amount"] <= 1e9) & ((q["kind"] != "count") | (q["amount"] == F.floor(q["amount"]))))
    one = F.array_distinct(sound)
    return F.when(F.size(one) == 1, one[0])


def quantities_conflict(a: Column | str, b: Column | str) -> Column:
    """Both known and different."""
    return F.coalesce(~(col(a) == col(b)), F.lit(False))


def quantities_equal(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(col(a) == col(b), F.lit(False))
