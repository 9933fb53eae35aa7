"""Admission of leads, offerings of pages, validation of findings, facts of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions.numbers import bound


def admission(candidate_domain: Column, primary_domain: Column, evidence_url: Column, product_url: Column, product_lane: Column) -> Column:
    """The first reason not to admit a candidate; null if it is admitted.

    A company needs a public domain of its own and evidence that is no listing; a product lead
    also needs a product page on that domain.
    """
    own = U.canonical_host(candidate_domain)
    there = F.coalesce(product_url != "", F.lit(False))
    return (
        F.when(~U.is_public_host(own), "no-public-domain")
        .when((own == U.canonical_host(primary_domain)) | F.endswith(own, F.concat(F.lit("."), U.canonical_host(primary_domain))), "own-domain")
        .when(U.is_listing_route(evidence_url), "listing-evidence")
        .when(there & (U.canonical_host(U.page_host(product_url)) != own), "foreign-product-page")
        .when(product_lane & ~there, "no-product-page")
        .when(product_lane & ~U.is_detail_url(product_url), "no-product-detail")
    )


def matched_tokens(name: Column, source: Column) -> Column:
    """Tokens of a product name that a source text has too, a plural s on either side aside."""

    def both(t: Column) -> Column:
        a, b = t["a"], t["b"]
        return F.filter(a, lambda x: F.array_contains(b, x) | F.array_contains(b, F.concat(x, F.lit("s"))) | (F.endswith(x, F.lit("s")) & F.array_contains(b, F.regexp_replace(x, "s$", ""))))

    return bound(F.struct(X.bilingual_tokens(name).alias("a"), X.bilingual_tokens(source).alias("b")), both)


def offerings(headings: DataFrame, most: int = 12) -> DataFrame:
    """domain, name of the first `most` distinct offerings among headings (domain, ord, heading): two to fourteen words, no repeated half, no slogan."""
    h = headings.withColumn("name", F.regexp_replace(X.clean("heading"), r"(?i)^(.+) \1$", "$1"))
    words = F.size(F.filter(F.split(X.folded_normalize("name"), " "), lambda w: w != ""))
    fit = words.between(2, 14) & (F.length("name") <= 120) & ~F.col("name").rlike(r"[.!?]\s+[\p{L}\p{N}]")
    first = h.filter(fit).withColumn("key", X.folded_normalize("name")).groupBy("domain", "key").agg(F.min(F.struct("ord", "name")).alias("f"))
    order = Window.partitionBy("domain").orderBy("f.ord", "key")
    return first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("domain", "f.name")


def validated(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """run, finding, errors of findings (run, finding, code, subject, ids) against a run's evidence (run, id, type, subject).

    Errors: an id that is not there, a code that came before, a subject that no cited row has.
    """
    again = F.row_number().over(Window.partitionBy("run", "code").orderBy("finding")) > 1
    f = findings.withColumn("again", again)
    cited = f.select("run", "finding", F.col("subject").alias("wanted"), F.explode_outer("ids").alias("id")).join(evidence, ["run", "id"], "left")
    seen = cited.groupBy("run", "finding").agg(F.max((F.col("id").isNotNull() & F.col("type").isNull())).alias("unknown"), F.max(F.coalesce(F.col("subject") == F.col("wanted"), F.lit(False))).alias("matched"))
    errors = F.array_compact(F.array(F.when(F.col("again"), F.lit("duplicate-code")), F.when(F.col("unknown"), F.lit("unknown-evidence")), F.when(~F.col("matched"), F.lit("subject-mismatch"))))
    return f.join(seen, ["run", "finding"]).select("run", "finding", errors.alias("errors"))


def facts(crawled: DataFrame, compared: DataFrame, *keys: str) -> DataFrame:
    """Facts of both sources by key; the compared copy wins."""
    return crawled.join(compared.select(*keys), list(keys), "left_anti").unionByName(compared)


def marked_price(html: Column) -> Column:
    """The current amount of a product's markup: struck and earlier prices, instalments and unit prices are left out; null unless exactly one amount is left."""
    struck = r"(?is)<(del|s|strike)\b[^>]*>.*?</\1\s*>"
    other = r"(?is)<(\w+)\b[^>]*class\s*=\s*[\"'][^\"']*\b(?:was|old|compare|list|regular|instal?lments?|unit)[^\"']*[\"'][^>]*>.*?</\1\s*>"
    rest = F.regexp_replace(F.regexp_replace(html, struck, " "), other, " ")
    inside = F.regexp_extract_all(rest, F.lit(r"(?is)<\w+\b[^>]*class\s*=\s*[\"'][^\"']*\bprice\b[^\"']*[\"'][^>]*>([^<]*)<"), 1)
    amounts = F.array_distinct(F.filter(F.transform(inside, lambda t: F.translate(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")), lambda a: a.isNotNull()))
    return F.when(F.size(amounts) == 1, amounts[0])
