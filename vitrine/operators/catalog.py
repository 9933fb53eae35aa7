"""Identity, decisions and profiles of catalog records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions.constants import AGENCY_PATTERN, BUYING_PATTERN, GOODS_PATTERN, MARKET_QUERY_PATTERN, PARKING, PHASE_PATTERNS, REDIRECT_PATTERNS, SAAS_PATTERN
from ..functions.numbers import bound, clamp100, observed_score, percent_of, rounded_median


def identity_key(domain: Column, gtins: Column, source: Column, name: Column, quantity: Column, context: Column) -> Column:
    """What makes a product of a company the same product: its number, else its page, else its name; the market counts with a number, name and quantity with the others."""
    host = U.canonical_host(domain)
    size = F.coalesce(F.concat_ws("|", quantity["kind"], quantity["amount"].cast("string"), quantity["unit"]), F.lit(""))
    number = F.get(F.array_sort(gtins), 0)
    market = F.when(context != "", F.concat(F.lit("market|"), context, F.lit("|"))).otherwise("")
    by_number = F.concat(host, F.lit("|"), market, F.lit("gtin|"), number)
    by_page = F.when(source != "", F.concat_ws("|", host, F.lit("source"), source, X.bilingual_normalize(name), size))
    return F.coalesce(by_number, by_page, F.concat_ws("|", host, F.lit("name"), X.bilingual_normalize(name), size))


def exact_keys(products: DataFrame) -> DataFrame:
    """id, key of every exact blocking key of products (id, gtins, brand, sku, mpn, quantity): numbers, and codes within a brand."""
    brand = F.regexp_replace(X.bilingual_normalize("brand"), " ", "")
    code = lambda c, k: F.when((brand != "") & (F.coalesce(F.trim(c), F.lit("")) != ""), F.concat(F.lit(f"{k}|"), brand, F.lit("|"), X.bilingual_normalize(F.col(c))))
    keys = F.concat(F.transform("gtins", lambda g: F.concat(F.lit("gtin|"), g)), F.array_compact(F.array(code("sku", "sku"), code("mpn", "mpn"))))
    return products.select("id", F.explode(F.array_distinct(keys)).alias("key"))


def key_pairs(primary: DataFrame, rivals: DataFrame) -> DataFrame:
    """primary_id, rival_id of products that share a key, each pair once, of two tables of id, key.

    Products bring all their keys along, which are few, and a pair is made by the least key it
    shares. So pairs, which grow with the square of a key's rows, are never kept to be told apart.
    """
    p, r = (df.filter("id IS NOT NULL AND key IS NOT NULL").groupBy("id").agg(F.collect_set("key").alias(f"{x}_keys")).withColumn("key", F.explode(f"{x}_keys")).withColumnRenamed("id", f"{x}_id") for df, x in ((primary, "primary"), (rivals, "rival")))
    return p.join(r, "key").filter(F.col("key") == F.array_min(F.array_intersect("primary_keys", "rival_keys"))).select("primary_id", "rival_id")


def token_alignment(a: Column, b: Column) -> Column:
    """aligned, left, right of two token arrays: tokens that align one to one in order, and the shares of both sides.

    Tokens align if they are equal, differ by a plural s, or are one edit apart and long.
    """

    def aligns(x: Column, y: Column) -> Column:
        plural = (F.least(F.length(x), F.length(y)) >= 4) & ((F.concat(x, F.lit("s")) == y) | (F.concat(y, F.lit("s")) == x))
        return (x == y) | plural | ((F.length(x) >= 5) & (F.length(y) >= 5) & X.within_one_edit(x, y))

    # Each token of a takes the first token of b that is still free.
    left_over = F.aggregate(
        a,
        F.struct(b.alias("free"), F.lit(0).alias("n")),
        lambda s, x: bound(
            F.struct(s.alias("s"), F.get(F.filter(s["free"], lambda y: aligns(x, y)), 0).alias("hit")),
            lambda z: F.struct(
                F.when(z["hit"].isNull(), z["s"]["free"]).otherwise(F.array_remove(z["s"]["free"], z["hit"])).alias("free"),
                (z["s"]["n"] + F.when(z["hit"].isNull(), 0).otherwise(1)).alias("n"),
            ),
        ),
    )
    n = left_over["n"]
    return bound(n, lambda k: F.struct(k.alias("aligned"), (k / F.greatest(F.lit(1), F.size(a))).alias("left"), (k / F.greatest(F.lit(1), F.size(b))).alias("right")))


def page_strength(same_name: Column, same_page: Column, alignment: Column, conflict: Column, priced: Column, image: Column) -> Column:
    """How strongly a fetched product is the expected one; null if it is not."""
    enough = (alignment["aligned"] >= 2) & (alignment["left"] >= 0.5) & (alignment["right"] >= 0.5) & ~((alignment["left"] < 1) & (alignment["right"] < 1))
    base = F.when(conflict, F.lit(None)).when(same_name, 100_000.0).when(same_page & enough, alignment["aligned"] * 1000 + F.least(alignment["left"], alignment["right"]) * 100)
    return base + F.when(priced, 10).otherwise(0) + F.when(image, 1).otherwise(0)


def price_decision(primary: Column, rival: Column, primary_seen: Column, rival_seen: Column, exact: Column) -> Column:
    """verdict and comparable of a pair, of two comparable prices (currency, amount; null if there is none) and whether any price was seen."""
    same = F.coalesce(primary["currency"] == rival["currency"], F.lit(False))
    verdict = (
        F.when(~exact & primary_seen & rival_seen, "substitute")
        .when(same & (primary["amount"] == rival["amount"]), "equal")
        .when(same & (rival["amount"] < primary["amount"]), "rival-cheaper")
        .when(same, "primary-cheaper")
        .when(primary_seen & rival_seen, "unaligned")
        .when(rival_seen, "only-rival")
        .when(primary_seen, "only-primary")
        .otherwise("unknown")
    )
    return F.struct(verdict.alias("verdict"), (exact & same).alias("comparable"))


def redirect_retry(requested: Column, fetched: Column, country: Column) -> Column:
    """The URL to try once more when a shop put a locale of another market before the requested path; '' otherwise."""
    path = lambda c: F.regexp_replace(F.regexp_replace(U.url_path(c), "/{2,}", "/"), "(.)/$", "$1")
    locale = r"^/([A-Za-z]{2,3})-([A-Za-z]{2})(/.*)$"
    found = F.upper(F.regexp_extract(path(fetched), locale, 2))
    rest = F.regexp_extract(path(fetched), locale, 3)
    chosen = requested.rlike(MARKET_QUERY_PATTERN) | path(requested).rlike(locale)
    same = U.canonical_host(U.page_host(requested)) == U.canonical_host(U.page_host(fetched))
    retry = F.concat(F.regexp_extract(fetched, "(?i)^(https?://[^/?#]*)", 1), F.lit("/"), F.lower(F.regexp_extract(path(fetched), locale, 1)), F.lit("-"), F.lower(country), rest)
    return F.when(country.rlike("^[A-Z]{2}$") & same & ~chosen & (found != "") & (found != country) & (rest == path(requested)), retry).otherwise("")


def parking_provider(host: Column) -> Column:
    """The parking service that a host belongs to; '' if to none."""
    h = U.canonical_host(host)
    hit = F.when(F.lit(False), "")
    for name, domains in PARKING.items():
        hit = hit.when(F.array_contains(U.host_suffixes(h), domains[0]) if len(domains) == 1 else F.arrays_overlap(U.host_suffixes(h), F.array(*map(F.lit, domains))), name)
    return hit.otherwise("")


def static_redirect(html: Column, url: Column) -> Column:
    """Where a page sends its reader at once, by script or by a refresh element, as a full URL without fragment; '' if nowhere, to another site or not over http."""
    to = F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in REDIRECT_PATTERNS), F.lit(""))
    scheme = F.regexp_extract(url, "(?i)^(https?):", 1)
    folder = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "(?i)^(https?://[^/]*(?:/.*)?)/", 1)
    full = (
        F.when(to.rlike("(?i)^[a-z][a-z0-9+.-]*:"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(F.regexp_extract(url, "(?i)^(https?://[^/?#]*)", 1), to))
        .otherwise(F.concat(F.when(folder == "", url).otherwise(folder), F.lit("/"), to))
    )
    same = U.canonical_host(U.page_host(full)) == U.canonical_host(U.page_host(url))
    return F.when((to != "") & (U.page_host(full) != "") & same, F.regexp_replace(full, "#.*$", "")).otherwise("")


def safe_destination(url: Column) -> Column:
    """An http(s) URL of a public host without credentials; a link shim gives its target; '' otherwise."""
    target = F.when(U.canonical_host(U.page_host(url)) == "l.facebook.com", F.try_url_decode(F.regexp_extract(url, "[?&]u=([^&#]*)", 1))).otherwise(url)
    return F.when(U.is_public_host(U.page_host(target)) & ~target.rlike("^[a-z]+://[^/?#]*@"), target).otherwise("")


def business_type(product_count: Column, product_pages: Column, core: Column, text: Column) -> Column:
    """ecommerce, agency, saas or unknown, the surest sign first."""
    return (
        F.when((product_count >= 2) | (product_pages >= 2) | (text.rlike(GOODS_PATTERN) & text.rlike(BUYING_PATTERN)), "ecommerce")
        .when(core.rlike(AGENCY_PATTERN), "agency")
        .when(core.rlike(SAAS_PATTERN), "saas")
        .when(text.rlike(AGENCY_PATTERN), "agency")
        .when(text.rlike(SAAS_PATTERN), "saas")
        .when(product_count >= 3, "ecommerce")
        .otherwise("unknown")
    )


def page_medians(pages: DataFrame, key: str = "domain") -> DataFrame:
    """Median time and bytes of the responses of a domain; no score is made of them. What is negative or null was not observed."""
    seen = lambda c: F.when(F.col(c) >= 0, F.col(c))
    p = pages.select(key, seen("response_time_ms").alias("ms"), seen("response_bytes").alias("bytes"))
    return p.groupBy(key).agg(rounded_median("ms").alias("median_ms"), rounded_median("bytes").alias("median_bytes"), F.count("ms").alias("sample"))


def image_score(products: Column, with_image: Column, images: Column, with_alt: Column, responsive: Column) -> Column:
    """60 parts product images, 25 alternative texts, 15 responsive markup, over what was observed."""
    score = observed_score([(percent_of(with_image, products).cast("double"), 60), (percent_of(with_alt, images).cast("double"), 25), (percent_of(responsive, images).cast("double"), 15)])
    return F.when(score.isNotNull(), clamp100(score))


def gap_action(metric: Column, missing: Column) -> Column:
    """What would close the gap of a metric."""
    return (
        F.when((metric == "images") & (missing > 0), F.concat(F.lit("Add images to "), missing.cast("string"), F.lit(" products")))
        .when((metric == "information") & (missing > 0), F.concat(F.lit("Complete "), missing.cast("string"), F.lit(" public fields")))
        .when(metric == "productAccess", "Link products from the home page")
        .when(metric == "purchasePath", "Show the way to the checkout")
        .when(metric == "trust", "Show shipping, returns, contact, policies and company")
        .when(metric == "mobileAccessibility", "Declare viewport and language")
        .otherwise("Review the observed evidence")
    )


def explained_phases(phases: Column, reasons: Column) -> Column:
    """Phases that some reason explains."""
    rule = lambda p: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PHASE_PATTERNS.items() for x in kv)), p), p)
    return F.filter(phases, lambda p: F.exists(reasons, lambda r: F.call_function("rlike", F.lower(r), rule(p))))


def ad_comparison(companies: DataFrame) -> DataFrame:
    """company, headline of each company (run, company, is_primary, active) against the primary of its run."""
    primary = F.max(F.when(F.col("is_primary"), F.col("active"))).over(Window.partitionBy("run"))
    c = companies.withColumn("p", F.coalesce(primary, F.lit(False)))
    headline = F.when(F.col("active") & ~F.col("p"), "rival buys attention").when(F.col("active"), "both active").otherwise("no gap shown")
    return c.filter(~F.col("is_primary")).select("run", "company", headline.alias("headline"))


def replayed(pairs: DataFrame, verdicts: DataFrame, *fields: str) -> DataFrame:
    """Pairs with the cached verdict (plan_hash, verdict) of an equal plan, and whether a judge is still needed."""
    p = pairs.withColumn("plan_hash", F.sha2(F.to_json(F.struct(*fields)), 256))
    return p.join(verdicts, "plan_hash", "left").withColumn("pending", F.col("verdict").isNull())


def followed(pages: DataFrame, most: int = 1000) -> DataFrame:
    """Rows of cursor pages (cursor, next_cursor, rows) in the order in which cursors lead from '' on; a cursor that comes again ends the walk, as do `most` pages."""
    view = f"cursor_pages_{uuid.uuid4().hex}"  # of its own, so that two walks at once don't meet
    pages.createOrReplaceTempView(view)
    chain = pages.sparkSession.sql(f"""
        WITH RECURSIVE walk(step, cursor, next_cursor, seen) MAX RECURSION LEVEL {most} AS (
          SELECT 0, cursor, next_cursor, array(cursor) FROM {view} WHERE cursor = ''
          UNION ALL
          SELECT w.step + 1, p.cursor, p.next_cursor, array_append(w.seen, p.cursor) FROM walk w JOIN {view} p ON p.cursor = w.next_cursor
          WHERE NOT array_contains(w.seen, p.cursor) AND w.step < {most - 2})
        SELECT step, cursor FROM walk""")
    return chain.join(pages.select("cursor", "rows"), "cursor").select("step", F.posexplode("rows").alias("position", "row"))
