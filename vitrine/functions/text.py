"""Normalization, tokens and hashes of names as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import GENERIC_TOKENS, SIZE_PATTERN, STOPWORDS
from .numbers import col


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F))


def squeeze(c: Column | str) -> Column:
    """Runs of white space of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def bilingual_normalize(c: Column | str, ascii_only: bool = False) -> Column:
    """One spelling for names in Latin and Arabic script; null counts as empty.

    ascii_only skips the compatibility composition, and with it Python, for columns known to
    need none.
    """
    x = F.coalesce(col(c), F.lit(""))
    x = x if ascii_only else _nfkc(x)
    x = F.translate(x, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    x = F.regexp_replace(x, "([0-9])[,٫]([0-9])", "$1.$2")
    x = F.regexp_replace(x, "[٬ـً-ٰٟۖ-ۭ]", "")
    x = F.lower(F.translate(x, "أإآٱىیةۀک", "ااااييههك"))
    x = F.regexp_replace(x, r"[^\p{L}\p{N}.]+", " ")
    return squeeze(F.regexp_replace(x, r"\.(?!\d)|(?<!\d)\.", " "))


def bilingual_tokens(c: Column | str, ascii_only: bool = False) -> Column:
    """Distinct letter and number runs in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(bilingual_normalize(c, ascii_only), F.lit(r"([\p{L}\p{N}]+)"), 1))


def clean(c: Column | str) -> Column:
    """Without tags and the common entities, white space squeezed."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]*>", " ")
    for entity, text in (("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'")):
        x = F.regexp_replace(x, entity, text)
    return squeeze(x)


def folded_normalize(c: Column | str, ascii_only: bool = False) -> Column:
    """Lower case without accents; everything but letters and numbers is a space."""
    x = clean(c)
    return F.trim(F.regexp_replace(F.lower(x if ascii_only else _folded(x)), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column | str, generic: bool = False, ascii_only: bool = False) -> Column:
    """Distinct words of two characters or more, without stopwords and, unless asked for, generic words."""
    drop = STOPWORDS if generic else [*STOPWORDS, *GENERIC_TOKENS]
    words = F.array_distinct(F.split(folded_normalize(c, ascii_only), " "))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), F.array(*map(F.lit, drop)))


def field_tokens(c: Column | str, domain: Column | str, ascii_only: bool = False) -> Column:
    """Tokens without those of the product's own brand and without sizes."""
    own = tokens(F.split_part(col(domain), F.lit("."), F.lit(1)), generic=True, ascii_only=ascii_only)
    return F.filter(F.array_except(tokens(c, ascii_only=ascii_only), own), lambda w: ~w.rlike(SIZE_PATTERN))


def family_name(c: Column | str) -> Column:
    """A name without what is in parentheses or follows a dash or bar."""
    x = F.regexp_replace(clean(c), r"\s*\([^)]*\)\s*", " ")
    return squeeze(F.regexp_replace(x, r"\s+(?:-|–|—|\|)\s+.+$", ""))


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal, or both of five characters or more and one substitution, insertion or deletion apart."""
    near = F.levenshtein(a, b, 1)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (near >= 0))


def edit_signatures(c: Column | str) -> Column:
    """A token and, if it has five characters or more, all it becomes without one of them; tokens one edit apart share one."""
    t = col(c)
    shorter = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    return F.when(F.length(t) < 5, F.array(t)).otherwise(F.array_distinct(F.concat(F.array(t), shorter)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two sets of tokens; two empty sets share nothing."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(0.0)


#: Scripts that decide whether two names can be compared word by word.
SCRIPTS = "Latin Arabic Cyrillic Greek Han Hangul Hebrew Devanagari".split()


def writing_systems(c: Column | str) -> Column:
    return F.array_compact(F.array(*(F.when(col(c).rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in SCRIPTS)))


def disjoint_scripts(a: Column | str, b: Column | str) -> Column:
    x, y = writing_systems(a), writing_systems(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def fnv_hash(text: str | None) -> str:
    """The short id of a text: FNV-1a over UTF-16 units, base 36, six digits."""
    h = 2166136261
    data = (text or "").encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    digits = ""
    while True:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        if not h:
            return digits[:6]


@F.pandas_udf(T.StringType())
def short_id(s: pd.Series) -> pd.Series:
    return s.map(fnv_hash)


def slug(c: Column | str, ascii_only: bool = False) -> Column:
    x = F.substring(F.regexp_replace(folded_normalize(c, ascii_only), r"\s+", "-"), 1, 48)
    return F.when(x == "", F.lit("unnamed")).otherwise(x)


def bounded_text(c: Column | str, n: int) -> Column:
    return F.substring(squeeze(F.coalesce(col(c), F.lit(""))), 1, n)


def numbers_in(c: Column | str) -> Column:
    """Numbers of a text for the check that a draft is grounded: commas removed, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(col(c), r"(\d),(?=\d)", "$1"), F.lit(r"(\d+(?:\.\d+)?)"), 1))


def domains_in(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"), 1))
