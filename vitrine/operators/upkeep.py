"""Small rules of the report's workers and store: plans, identities, currencies, projections, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import currencies
from ..functions.urls import canonical_host, page_host, registrable_label

#: Subscriptions that count, words of storefront domains, the mark of a replaced catalog record.
ACTIVE = ["active", "trialing"]
STORE_WORDS = ["eu", "global", "official", "online", "shop", "store", "uk", "us", "usa"]
REPLACED = "Previous sitemap identity:"
ANALYSIS_LIMITS, DEFAULT_ANALYSIS_LIMIT = [20, 50, 500, 1000], 20


def active_plan(plan: Column, status: Column, start: Column, end: Column, now: Column) -> Column:
    """The plan of a subscription that is active now, from its start up to but not including its end; null otherwise."""
    return F.when(F.coalesce(status.isin(ACTIVE) & (now >= start) & (now < end), F.lit(False)), plan)


def analysis_limit(value: Column) -> Column:
    """Products that a plan lets a run analyse; anything but a known limit is the default."""
    n = F.regexp_extract(F.trim(F.coalesce(value, F.lit(""))), r"^([+-]?\d+)", 1).try_cast("int")
    return F.when(n.isin(ANALYSIS_LIMITS), n).otherwise(DEFAULT_ANALYSIS_LIMIT)


def analysis_effort(limit: Column) -> Column:
    """Milliseconds and concurrency that a limit is worth."""
    pick = lambda a, b, c: F.when(limit <= 60, a).when(limit <= 500, b).otherwise(c)
    return F.struct(pick(90_000, 360_000, 720_000).alias("budget_ms"), pick(3, 6, 12).alias("concurrency"))


def pinned_pairs(pins: DataFrame, products: DataFrame, most: int = 6000) -> DataFrame:
    """request, primary_id, domain, rival_id of the pins of every request that is valid as a whole.

    pins has request, primary_id, domain, rival_id; products has request, domain, id,
    is_primary. A request with an unknown product, too many pins, or two pins that share a
    primary's domain or a rival is refused whole; repeated pins count once.
    """
    p = pins.withColumn("domain", canonical_host("domain"))
    known = products.withColumn("domain", canonical_host("domain"))
    own = known.filter("is_primary").select("request", F.col("id").alias("primary_id")).distinct().withColumn("p", F.lit(True))
    rival = known.filter("NOT is_primary").select("request", "domain", F.col("id").alias("rival_id")).distinct().withColumn("r", F.lit(True))
    met = p.join(own, ["request", "primary_id"], "left").join(rival, ["request", "domain", "rival_id"], "left")
    sound = met.groupBy("request").agg(F.min(F.coalesce("p", F.lit(False)) & F.coalesce("r", F.lit(False))).alias("known"), F.count(F.lit(1)).alias("n"))
    once = p.select("request", "primary_id", "domain", "rival_id").distinct()
    shared = [once.groupBy("request", *key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("request") for key in (("primary_id", "domain"), ("domain", "rival_id"))]
    good = sound.filter(F.col("known") & (F.col("n") <= most)).select("request")
    return once.join(good, "request", "left_semi").join(shared[0].union(shared[1]), "request", "left_anti")


def unavailable_state(first: Column, second: Column) -> Column:
    """The endpoint of two failed attempts that may be called unavailable: both without a network response, both over https to one origin; null otherwise.

    An attempt has kind and url.
    """
    origin = lambda a: F.lower(F.regexp_extract(a["url"], r"(?i)^(https://[^/?#]+)", 1))
    both = (first["kind"] == "network") & (second["kind"] == "network") & (origin(first) != "") & (origin(first) == origin(second))
    return F.when(F.coalesce(both, F.lit(False)), second["url"])


def reference_times(runs: DataFrame, products: DataFrame, clock: Column) -> DataFrame:
    """run, reference: the latest observation of a run's products that is not after the clock, or its creation if that is later, never after the clock.

    runs has run, created_at; products has run, observed_at.
    """
    seen = products.filter(F.col("observed_at") <= clock).groupBy("run").agg(F.max("observed_at").alias("seen"))
    start = F.least(F.coalesce("created_at", clock), clock)
    return runs.join(seen, "run", "left").select("run", F.greatest(start, F.coalesce("seen", start)).alias("reference"))


def domain_brand(domain: Column) -> Column:
    """The name that a domain stands for: the registrant's label without words of storefronts at its ends, in one piece; '' without a dot."""
    host = canonical_host(domain)
    words = F.filter(F.split(F.lower(registrable_label(host)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    store = lambda w: w.isin(STORE_WORDS)
    own = F.filter(words, lambda w: ~store(w))
    first, last = F.array_position(words, own[0]), F.size(words) - F.array_position(F.reverse(words), F.element_at(own, -1)) + 1
    # If all are words of storefronts, the last one stays.
    kept = F.when(F.size(own) > 0, F.slice(words, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(words, F.greatest(F.size(words), F.lit(1)), 1))
    return F.when(F.contains(host, F.lit(".")), F.array_join(kept, "")).otherwise("")


def confirmed_currency(html: Column, structured: bool = True) -> Column:
    """The one currency that a page's product metadata names, or else its structured data; '' if none or several.

    Of the metadata, the first namespace that has an amount or a currency decides.
    """
    text = F.coalesce(html, F.lit(""))

    def codes(found: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(found, lambda c: F.upper(F.trim(c))), lambda c: c.isin(*sorted(currencies()))))

    def metadata(key: str) -> Column:
        return F.regexp_extract_all(text, F.lit(rf"""(?i)<meta\b[^>]*(?:property|name|itemprop)\s*=\s*["']{key}["'][^>]*content\s*=\s*["']([^"']*)["']"""), 1)

    direct = F.array().cast("array<string>")
    for amount, currency in reversed([("product:price:amount", "product:price:currency"), ("og:price:amount", "og:price:currency"), ("price", "priceCurrency")]):
        direct = F.when((F.size(metadata(amount)) > 0) | (F.size(metadata(currency)) > 0), codes(metadata(currency))).otherwise(direct)
    inside = codes(F.regexp_extract_all(text, F.lit(r"""(?i)["']priceCurrency["']\s*:\s*["']([A-Za-z]{3})["']"""), 1))
    named = F.when(F.size(inside) == 1, inside[0]).otherwise("") if structured else F.lit("")
    return F.when(F.size(direct) > 1, "").when(F.size(direct) == 1, direct[0]).otherwise(named)


def ad_supports_identity(destination: Column, captions: Column, page_name: Column, slug: Column, domain: Column, brand: Column) -> Column:
    """Whether an ad record speaks for a company: its destination or captions name the domain, and its page has the profile's or the brand's name."""
    own = canonical_host(domain)
    host = canonical_host(page_host(F.coalesce(destination, F.lit(""))))
    named = (host == own) | F.endswith(host, F.concat(F.lit("."), own)) | F.contains(F.lower(F.array_join(F.coalesce(captions, F.array().cast("array<string>")), " ")), own)
    compact = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    page, profile = compact(page_name), compact(slug)
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    alike = (page != "") & (profile != "") & (F.contains(page, profile) | F.contains(profile, page))
    return named & (own != "") & (alike | F.arrays_overlap(words(page_name), words(brand)))


def is_replaced(attributes: Column) -> Column:
    """Whether a product's attributes tell that it took the place of another catalog record."""
    return F.exists(F.coalesce(attributes, F.array().cast("array<string>")), lambda a: F.startswith(a, F.lit(REPLACED)))


def replacement_attribute(previous: Column, url: Column) -> Column:
    name = F.substring(F.trim(F.regexp_replace(previous, r"\s+", " ")), 1, 180)
    return F.concat(F.lit(f"{REPLACED} "), name, F.lit(" ("), F.substring(url, 1, 260), F.lit(")"))


def feedback_items(items: Column) -> Column:
    """At most three items with an explanation, their texts bounded; items is an array of issue_code, subject_kind, subject_id, explanation, evidence_ids."""
    text = lambda c, n: F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, n)
    few = F.filter(F.slice(F.coalesce(items, F.array()), 1, 3), lambda i: text(i["explanation"], 240) != "")
    ids = lambda i: F.filter(F.transform(F.slice(F.coalesce(i["evidence_ids"], F.array().cast("array<string>")), 1, 5), lambda e: text(e, 120)), lambda e: e != "")
    return F.transform(
        few, lambda i: F.struct(text(i["issue_code"], 120).alias("issue_code"), text(i["subject_kind"], 40).alias("subject_kind"), text(i["subject_id"], 120).alias("subject_id"), text(i["explanation"], 240).alias("explanation"), ids(i).alias("evidence_ids"))
    )


def discovery_coverage(c: Column) -> Column:
    """How complete a discovery batch was, from a struct of searches_complete, found, investigated, verified (all settled and complete), stored, prior_complete, end_index, eligible."""
    truncated = c["found"] > c["investigated"]
    batch = c["searches_complete"] & ~truncated & c["verified"] & c["stored"]
    return F.struct(truncated.alias("truncated"), batch.alias("batch_complete"), (c["prior_complete"] & (c["end_index"] >= c["eligible"]) & batch).alias("complete"))


def recovered_products(checkpoints: DataFrame, targets: DataFrame) -> DataFrame:
    """The products of checkpoints (run, batch, key, ...) that a run still asks for (run, key), the latest batch's of each."""
    wanted = checkpoints.join(targets.select("run", "key").distinct(), ["run", "key"], "left_semi")
    rest = [c for c in checkpoints.columns if c not in ("run", "key")]
    return wanted.groupBy("run", "key").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("run", "key", "r.*")


def recovery_scope(requested: DataFrame, evaluations: DataFrame, open_states: list[str]) -> DataFrame:
    """id, scope of requested evaluations: recoverable, settled or unknown; evaluations has id, status."""
    met = requested.select("id").distinct().join(evaluations.select("id", "status"), "id", "left")
    return met.select("id", F.when(F.col("status").isNull(), "unknown").when(F.col("status").isin(open_states), "recoverable").otherwise("settled").alias("scope"))


def ungated_matches(matches: DataFrame) -> DataFrame:
    """run, n of matches (run, has_product, price_eligible) with a product, published or held back, that no publication gate has decided on (price_eligible is null)."""
    return matches.filter(F.col("has_product") & F.col("price_eligible").isNull()).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
