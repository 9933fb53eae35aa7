"""Queries over inputs that reach every rule of an operator.

A row's key, modulo the number of cases, picks its input from a list; the SQL joins the
expected values of the same list, so it doesn't repeat the operator's rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import catalog as C
from ..operators import evaluations as E
from ..operators import regions as R
from ..operators import similarity as S
from ..operators import upkeep as K
from ..operators import verification as V
from ..sources import html as H
from ..sources.tables import dealt, load
from .registry import query


def picked(key: Column | str, cases: list[tuple], *positions: int) -> list[Column]:
    """The inputs of a row, by position in its case."""
    n = (F.col(key) if isinstance(key, str) else key) % len(cases) + 1
    return [F.element_at(F.array(*(F.lit(c[i]) for c in cases)), n.cast("int")) for i in positions]


def expected(table: str, key: str, cases: list[tuple], positions: range, names: str) -> str:
    """SQL that gives the expected values of the case of each row."""

    def literal(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"

    rows = ", ".join(f"({k}, {', '.join(literal(c[i]) for i in positions)})" for k, c in enumerate(cases))
    return f"SELECT {key} AS id, {names} FROM {table} JOIN (VALUES {rows}) AS c(k, {names}) ON {key} % {len(cases)} = c.k"


MARKETS = [
    ("https://shop.com/products/x", "", "", False, False, ""),
    ("https://shop.com/products/x?country=us", "US", "", True, False, "country:US"),
    ("https://shop.com/products/x?country_code=MO&currency_code=mop", "MO", "MOP", True, False, "country:MO|currency:MOP"),
    ("https://shop.com/products/x?market=EU", "", "", False, False, ""),
    ("https://shop.com/products/x?region=Nowhere", "", "", True, False, "country:?"),
    ("https://shop.com/products/x?locale=en", "", "", True, False, "country:?"),
    ("https://shop.com/products/x?locale=en_GB", "GB", "", True, False, "country:GB"),
    ("https://shop.com/products/x?currency=JPY", "", "JPY", True, False, "currency:JPY"),
    ("https://shop.com/products/x?currencycode=ZZZ", "", "", True, False, "currency:?"),
    ("https://shop.com/products/x?currency=SEK&currency=TRY", "", "", True, True, "conflict"),
    ("https://shop.com/en-sa/products/x", "SA", "", True, False, "country:SA"),
    ("https://shop.com/gb-en/products/x", "GB", "", True, False, "country:GB"),
    ("https://shop.com/de/products/x", "", "", False, False, ""),
    ("https://shop.com/no/products/x", "NO", "", True, False, "country:NO"),
    ("https://shop.com/uk/products/x", "", "", True, False, "country:?"),
    ("https://shop.com/ca/shop/x", "CA", "", True, False, "country:CA"),
    ("https://www.shop.co.uk/x", "GB", "", False, False, "country:GB"),
    ("https://shop.de/products/x?country=US", "", "", True, True, "conflict"),
    ("https://shop.io/x", "", "", False, False, ""),
    ("https://shop.ky/x", "KY", "", False, False, "country:KY"),
    ("no url", "", "", False, False, ""),
]


@query(expected("pages", "page_id", MARKETS, range(1, 6), "country, currency, explicit, conflict, context"))
def page_markets(spark, sf_dir):
    """Markets that URLs select: query keys, path segments, country domains and conflicts."""
    p = dealt(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), U.market_context(picked("page_id", MARKETS, 0)[0]).alias("m"))
    return p.select("id", "m.country", "m.currency", "m.explicit", "m.conflict", "m.context")


PARKED = [
    ("www.sedoparking.com", "location.href='/a'", "https://shop.com/x/y", "Sedo", "https://shop.com/a"),
    ("x.sedo.com", "window.location = \"b\"", "https://shop.com/x/y?q=1", "Sedo", "https://shop.com/x/b"),
    ("forsale.godaddy.com", "location.replace( 'https://www.shop.com/c#top' )", "https://shop.com/", "GoDaddy/Afternic", "https://www.shop.com/c"),
    ("afternic.com", '<meta http-equiv="refresh" content="0; url=/d">', "http://shop.com", "GoDaddy/Afternic", "http://shop.com/d"),
    ("dan.com", "location.href = 'https://other.com/e'", "https://shop.com/", "Dan", ""),
    ("a.bodis.com", "location.href = 'javascript:void(0)'", "https://shop.com/", "Bodis", ""),
    ("notdan.com", "location = '//shop.com/f'", "https://www.shop.com/x", "", "https://shop.com/f"),
    ("godaddy.com", "no location here", "https://shop.com/", "", ""),
    ("parkingcrew.net", "location.href='/g'", "not a url", "", ""),
]


@query(expected("supplier", "s_suppkey", PARKED, range(3, 5), "provider, redirect"))
def parked_domains(spark, sf_dir):
    """Parking services, and static redirects within a site."""
    host, html, url = picked("s_suppkey", PARKED, 0, 1, 2)
    return dealt(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), C.parking_provider(host).alias("provider"), C.static_redirect(html, url).alias("redirect"))


#: domain, language, document, text, prices, then the signals as country:kind:weight in order.
REGIONS = [
    ("www.shop.co.uk", "en-GB", "", "", "£5", "GB:currency:3,GB:language:4,GB:tld:5"),
    ("shop.de", "de_DE", "", "", "5 €", "DE:currency:2,DE:language:4,DE:tld:5"),
    ("shop.com", "en", "<link hreflang='en_us'>", "Call +1 555 12", "US$ 3", "US:currency:3,US:language:4,US:phone:2"),
    ("shop.com", "", '{"addressCountry": {"@type": "Country", "name": "Egypt"}}', "made in Egypt", "", "EG:explicit-market:1,EG:structured-address:6"),
    ("shop.com", "", "'addressCountry':'UAE'", "+971 4 shipped within two days from our Dubai store", "", "AE:fulfillment-location:4,AE:phone:2,AE:structured-address:6"),
    ("shop.in", "hi-IN", "", "delivered fresh from Mumbai and shipping from London", "₹ 90", "GB:fulfillment-location:4,IN:currency:3,IN:fulfillment-location:4,IN:language:4,IN:tld:5"),
    ("shop.com", "fr", "", "trusted worldwide, in France too", "EUR 5", "FR:explicit-market:1,GLOBAL:global-market:4"),
    ("shop.com", "", "", "Saudi Arabia and the United Kingdom, +966 1 or +44 2", "", "GB:explicit-market:1,GB:phone:2,SA:explicit-market:1,SA:phone:2"),
    ("shop.sa", "", "", "across more than 30 countries", "", "GLOBAL:global-market:4,SA:tld:5"),
    ("shop.com", None, None, None, None, ""),
]


@query(expected("supplier", "s_suppkey", REGIONS, range(5, 6), "signals"))
def region_signals(spark, sf_dir):
    """Signals of the market that a page serves, of every kind."""
    signals = R.region_signals(*picked("s_suppkey", REGIONS, 0, 1, 2, 3, 4))
    shown = F.array_sort(F.transform(signals, lambda s: F.concat_ws(":", s["country"], s["kind"], s["weight"].cast("string"))))
    return dealt(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(shown, ",").alias("signals"))


LISTINGS = [
    ("https://s.com/products/blue-tea", False),
    ("https://s.com/products/blue-tea?variant=2&attribute_größe=1", False),
    ("https://s.com/products/blue-tea?sort=price", True),
    ("https://s.com/collections/tea", True),
    ("https://s.com/tienda/resultados-busqueda", True),
    ("https://s.com/a/b%C3%BAsqueda", True),
    ("https://s.com/blog/page/3", True),
    ("https://s.com/produkte/alle", True),
    ("https://s.com/tee/alle", False),
    ("https://s.com/商品/全部", True),
    ("https://s.com/", False),
    ("mailto:x@s.com", True),
]


@query(expected("supplier", "s_suppkey", LISTINGS, range(1, 2), "listing"))
def listing_urls(spark, sf_dir):
    """URLs that list products, in several languages."""
    return dealt(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), U.is_listing_url(picked("s_suppkey", LISTINGS, 0)[0]).alias("listing"))


FACTS = [("primary.name", "Blue Tea"), ("rival.domain", "sold at rival.com"), ("decision.priceVerdict", "primary costs 12.50 USD, tea price شاي")]
GOOD = dict(pair="k", action_en="Highlight the tea at 12.50", action_ar="أبرز شاي", rationale_en="Show rival.com tea", rationale_ar="شاي 12.50", lever="positioning", evidence="primary.name,decision.priceVerdict", comparable=True)
DRAFTS = [
    (GOOD, None),
    (GOOD | {"pair": None}, "invalid-object"),
    (GOOD | {"pair": "other"}, "pair-key-mismatch"),
    (GOOD | {"action_en": " "}, "text-fields"),
    (GOOD | {"rationale_en": "tea " * 60}, "text-fields"),
    (GOOD | {"action_ar": "tea"}, "arabic-missing"),
    (GOOD | {"lever": "magic"}, "lever"),
    (GOOD | {"evidence": "primary.name"}, "evidence-keys"),
    (GOOD | {"evidence": "primary.name,unknown.key"}, "evidence-keys"),
    (GOOD | {"evidence": "primary.name,rival.domain"}, "evidence-specificity"),
    (GOOD | {"action_en": "Highlight the tea at 13"}, "unsupported-number"),
    (GOOD | {"rationale_en": "Show other.com tea"}, "unsupported-domain"),
    (GOOD | {"action_en": "Highlight the Darjeeling tea"}, "proper-noun"),
    (GOOD | {"action_en": "Highlight the cheaper tea", "comparable": False}, "price-direction"),
    (GOOD | {"action_ar": "أبرز شاي أرخص", "comparable": False}, "price-direction"),
    (GOOD | {"action_en": "Improve it", "rationale_en": "Keep your lead"}, "grounding-overlap-en"),
    (GOOD | {"action_ar": "أبرز المنتج", "rationale_ar": "دليل محفوظ"}, "grounding-overlap-ar"),
]
DRAFT_ROWS = [(d["pair"], d["action_en"], d["action_ar"], d["rationale_en"], d["rationale_ar"], d["lever"], d["evidence"], d["comparable"], reason) for d, reason in DRAFTS]


@query(expected("supplier", "s_suppkey", DRAFT_ROWS, range(8, 9), "reason"))
def draft_verdicts(spark, sf_dir):
    """The first of thirteen reasons to refuse a drafted action, over drafts that reach each."""
    names = ("pair_key", "action_en", "action_ar", "rationale_en", "rationale_ar", "lever", "evidence", "comparable_price")
    values = dict(zip(names, picked("s_suppkey", DRAFT_ROWS, *range(8))))
    values["evidence"] = F.split(values["evidence"], ",")
    facts = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in FACTS))
    draft = F.struct(*(v.alias(n) for n, v in values.items()), F.lit("k").alias("own_key"), facts.alias("facts"))
    return dealt(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), V.draft_rejection(draft).alias("reason"))


FAILURES = [
    ("report-dispatch-failed", "queued", "dispatch"),
    ("crawl-timeout", "brief", "crawl"),
    ("edge-503", "brief", "crawl"),
    ("primary-page-unavailable", "brief", "crawl"),
    ("other", "crawl", "crawl"),
    ("worker-lost", "brief", "worker"),
    ("", "persistence", "persistence"),
    (None, None, "orchestration"),
    ("odd", "ads", "orchestration"),
]


@query(expected("orders", "o_orderkey", FAILURES, range(2, 3), "stage"))
def run_failures(spark, sf_dir):
    """Where failed runs failed."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), V.failure_stage(*picked("o_orderkey", FAILURES, 0, 1)).alias("stage"))


#: core_overlap, discovery_overlap, accessory, pair_score, locale_bridge, exact_confidence, mentions, evidence, direct, primary_region, region, require_overlap, then score, accepted, confidence, basis.
VERIFIED = [
    (5, 0, False, 0.5, False, None, 3, 1, True, "GB", "GB", True, 99, True, "High", "observed-core"),
    (2, 0, False, None, False, None, 1, 0, False, "", "US", False, 50, True, "Low", "observed-core"),
    (2, 0, False, None, False, None, 1, 0, False, "", "US", True, 50, False, "Low", "observed-core"),
    (2, 4, False, 0.32, False, None, 9, 9, True, "US", "DE", False, 78, False, "High", "observed-core"),
    (1, 2, False, 0.4, True, None, 2, 0, False, "US", "GLOBAL", False, 77, True, "Medium", "observed-locale-pair"),
    (0, 3, False, None, True, None, 0, 0, True, "US", "US", False, 27, False, "Low", "none"),
    (0, 1, False, 0.2, False, 0.9, 1, 2, True, "US", "", False, 76, True, "Medium", "verified-exact-product-pair"),
    (1, 0, True, 0.9, True, 0.95, 1, 1, True, "US", "US", False, 47, False, "Low", "verified-exact-product-pair"),
    (0, 9, False, None, False, 0.5, 0, 1, False, "US", "US", False, 41, False, "Low", "none"),
]


@query(expected("customer", "c_custkey", VERIFIED, range(12, 16), "score, accepted, confidence, basis"))
def competitor_verification(spark, sf_dir):
    """Verification of candidates by category, product, evidence, relation and region."""
    names = ("core_overlap", "discovery_overlap", "accessory", "pair_score", "locale_bridge", "exact_confidence", "mentions", "evidence", "direct", "primary_region", "region", "require_overlap")
    x = F.struct(*(c.alias(n) for n, c in zip(names, picked("c_custkey", VERIFIED, *range(12)))))
    c = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.verification(x).alias("v"))
    return c.select("id", "v.*")


#: status, then events as key:phase:status:message:limited:upstream, then the reason.
COVERAGE = [
    ("complete", "crawl-limited:crawl:limited:::", "ready"),
    ("limited", "crawl-limited:crawl:limited:::", "site-unavailable"),
    ("limited", "ads-skipped:ads:skipped::true:crawl", "site-unavailable"),
    ("limited", "ads-limited:ads:limited:::;facts-limited:persistence:limited:::", "facts-incomplete"),
    ("limited", "matching-complete:matching:complete::true:", "matching-stopped"),
    ("limited", "matching-complete:matching:complete:::;matching-limited:matching:limited:::", "matching-unavailable"),
    ("limited", "e:enrichment:done:a Coverage Limitation::", "details-missing"),
    ("limited", "b:brief:limited:::", "discovery-partial"),
    ("limited", "a:ads:limited:::", "ads-partial"),
    ("limited", "a:ads:complete:::", "unknown"),
    ("limited", None, "unknown"),
]


@query(expected("customer", "c_custkey", COVERAGE, range(2, 3), "coverage"))
def coverage_label(spark, sf_dir):
    """What a limited report could not cover, the gravest first."""
    status, events = picked("c_custkey", COVERAGE, 0, 1)
    part = lambda e, k: F.nullif(F.split_part(e, F.lit(":"), F.lit(k)), F.lit(""))
    names = ("key", "phase", "status", "message")
    event = lambda e: F.struct(*(part(e, k + 1).alias(n) for k, n in enumerate(names)), part(e, 5).cast("boolean").alias("limited"), part(e, 6).alias("upstream"))
    found = F.transform(F.split(events, ";"), event)
    return dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.coverage_reason(status, found).alias("coverage"))


#: status, attempts, owner, request, by, attempt, outcome, then the new status, attempts, owner and the reply.
STEPS = [
    ("deterministic", 0, None, "dispatch", None, None, None, "dispatching", 1, None, "applied"),
    ("dispatch_failed", 2, None, "dispatch", None, None, None, "dispatching", 3, None, "applied"),
    ("dispatch_failed", 3, None, "dispatch", None, None, None, "dispatch_failed", 3, None, "ineligible"),
    ("complete", 1, "w", "dispatch", None, None, None, "complete", 1, "w", "ineligible"),
    ("dispatching", 1, None, "fail", None, 1, None, "dispatch_failed", 1, None, "applied"),
    ("dispatching", 3, None, "fail", None, 3, None, "failed", 3, None, "applied"),
    ("dispatching", 2, None, "fail", None, 1, None, "dispatching", 2, None, "stale_attempt"),
    ("dispatching", 2, None, "reserve", "w", 2, None, "reserved", 2, "w", "applied"),
    ("reserved", 2, "w", "reserve", "v", 2, None, "reserved", 2, "w", "ineligible"),
    ("reserved", 2, "w", "callback", "w", 2, "complete", "complete", 2, "w", "applied"),
    ("reserved", 2, "w", "callback", "v", 2, "complete", "reserved", 2, "w", "binding_conflict"),
    ("reserved", 2, "w", "callback", "w", 2, "odd", "reserved", 2, "w", "binding_conflict"),
    ("complete", 2, "w", "callback", "w", 2, "agent_rejected", "complete", 2, "w", "ineligible"),
    ("dispatching", 1, None, None, None, None, None, "dispatching", 1, None, None),
]


@query(expected("orders", "o_orderkey", STEPS, range(7, 11), "status, attempts, owner, reply"))
def evaluation_steps(spark, sf_dir):
    """States of evaluations after a request each: dispatch, failure, reservation, callback, replays and stale attempts."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *(c.alias(n) for n, c in zip(("status", "attempts", "holder", "request", "by", "attempt", "outcome"), picked("o_orderkey", STEPS, *range(7)))))
    states = o.select("id", "status", F.col("attempts").cast("int").alias("attempts"), F.col("holder").alias("owner"))
    asked = o.filter("request IS NOT NULL").select("id", F.lit(1).alias("ord"), "request", F.col("by").alias("owner"), F.col("attempt").cast("int").alias("attempt"), "outcome")
    # The same request comes twice; the second must change nothing.
    return E.applied(states, asked.unionByName(asked.withColumn("ord", F.lit(2))))


#: status, attempts, minutes in it, dispatched, then the state after the watchdog and the queue's clock.
CLOCKS = [
    ("dispatching", 1, 4, True, "dispatching"),
    ("dispatching", 1, 6, True, "dispatch_failed"),
    ("dispatching", 3, 6, True, "failed"),
    ("reserved", 1, 9, True, "reserved"),
    ("reserved", 1, 11, True, "call_outcome_unknown"),
    ("queued", 0, 59, True, "queued"),
    ("queued", 0, 61, True, "failed"),
    ("queued", 0, 999, False, "queued"),
    ("complete", 1, 999, True, "complete"),
]


@query(expected("orders", "o_orderkey", CLOCKS, range(4, 5), "next_state"))
def watchdog_states(spark, sf_dir):
    """What a clock does to evaluations and queued runs that wait."""
    status, attempts, minutes, sent = picked("o_orderkey", CLOCKS, 0, 1, 2, 3)
    now = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    since = now - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    after = E.expired(status, attempts, since, now)
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), E.queued_timeout(after, F.when(sent, since), now).alias("next_state"))


#: The pair's names, numbers, amounts, kinds, tiers, categories, descriptions and images, then score, vetoes and eligibility.
PAIRS = [
    ("alpha one", "beta two", "4006381333931", "4006381333931", None, None, "Product", "Product", None, None, "", "", "", "", None, None, 0.0, "", True),
    ("blue tea", "blue tea", "4006381333931", "0012345678905", None, None, "Product", "Product", None, None, "", "", "", "", None, None, 0.58, "gtin", False),
    ("blue tea", "blue tea", "", "", 100.0, 200.0, "Product", "Product", None, None, "", "", "", "", None, None, 0.58, "quantity", False),
    ("blue pot", "green fan", "", "", None, None, "Product", "Service", None, None, "", "", "", "", None, None, 0.0, "product-service", False),
    ("alpha", "beta", "", "", None, None, "Service", "Service", "entry", "entry", "", "", "", "", None, None, 0.72, "", True),
    ("blue tea mug", "blue tea", "", "", None, None, "Product", "Product", None, None, "", "", "", "", None, None, 0.3867, "group", False),
    ("blue tea leaf", "blue tea pot", "", "", None, None, "Product", "Product", None, None, "tea", "tea", "", "", None, None, 0.47, "", True),
    ("blue tea leaf", "blue tea pot", "", "", 100.0, 100.0, "Product", "Product", None, None, "tea", "tea", "fresh leaf", "fresh", "x y", "x y", 0.64, "", True),
    ("blue tea", "blue tea pot large", "", "", None, None, "Product", "Product", None, None, "", "", "", "", "x", None, 0.58, "", True),
    ("matcha powder", "matchaa powders", "", "", None, None, "Product", "Product", None, None, "", "", "", "", None, None, 0.0, "", False),
    ("blue tea", "blue tea", "", "", None, None, "Service", "Service", "entry", None, "", "", "", "", None, None, 0.58, "", False),
]


@query(expected("part", "p_partkey", PAIRS, range(16, 19), "score, vetoes, eligible"))
def pair_rules(spark, sf_dir):
    """Scores, vetoes and eligibility of pairs: identifiers, quantities, kinds, tiers, groups, images, containment."""
    c = picked("p_partkey", PAIRS, *range(16))
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")

    def side(k: int):
        amount = F.when(c[4 + k].isNotNull(), F.struct(F.lit("mass").alias("kind"), c[4 + k].cast("double").alias("amount"), F.lit("g").alias("unit")))
        names = words(c[k])
        return F.struct(
            names.alias("name_tokens"), names.alias("family_tokens"), words(c[10 + k]).alias("category_tokens"), words(c[12 + k]).alias("description_tokens"), words(c[14 + k]).alias("image_tokens"),
            words(c[2 + k]).alias("gtins"), amount.alias("quantity"), c[6 + k].alias("kind"), c[8 + k].cast("string").alias("tier"),
        )

    s = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.pair_score(side(0), side(1)).alias("s"))
    return s.select("id", "s.score", F.array_join("s.vetoes", ",").alias("vetoes"), "s.eligible")


#: requested handle, currency, body, then name, amounts, image, sku and gap.
STORE = [
    ("tea", "USD", '{"title": "Tea", "handle": "tea", "type": "Drinks", "images": ["//cdn.com/a.jpg"], "variants": [{"price": 1250, "sku": "T1"}]}', "Tea", "12.5", "https://cdn.com/a.jpg", "T1", ""),
    ("tea", "USD", '{"title": "Tea", "handle": "tea", "variants": [{"price": 1250, "sku": "T1"}, {"price": 900}, {"price": 1250}]}', "Tea", "12.5,9.0", "", None, ""),
    ("tea", "USD", '{"title": "Tea", "handle": "tea", "variants": [{"price": 1250}, {"price": 0}]}', "Tea", "", "", None, "incomplete-prices"),
    ("tea", "", '{"title": "Tea", "handle": "tea", "featured_image": "https://cdn.com/b.jpg", "variants": [{"price": "100", "sku": " "}]}', "Tea", "", "https://cdn.com/b.jpg", None, "no-currency"),
    ("tea", "USD", '{"title": "Tea", "handle": "coffee", "variants": [{"price": 1}]}', None, None, None, None, "different-handle"),
    ("grüner tee", "EUR", '{"title": "Tee", "handle": "gr%C3%BCner%20tee", "variants": [{"price": 5, "featured_image": {"src": "https://cdn.com/c.jpg"}}]}', "Tee", "0.05", "https://cdn.com/c.jpg", None, ""),
    ("tea", "USD", '{"title": " ", "handle": "tea"}', None, None, None, None, "invalid-payload"),
    ("tea", "USD", "no json", None, None, None, None, "invalid-payload"),
    ("tea", "USD", '{"title": "Tea", "handle": "tea", "variants": []}', "Tea", "", "", None, "incomplete-prices"),
]


@query(expected("part", "p_partkey", STORE, range(3, 8), "name, amounts, image, sku, gap"))
def storefront_product(spark, sf_dir):
    """The product of a storefront's single-product payload, or what is missing."""
    names = ("requested", "currency", "body")
    p = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(c.alias(n) for n, c in zip(names, picked("p_partkey", STORE, 0, 1, 2))))
    return H.storefront_product(p).select("id", "name", F.array_join(F.transform("amounts", lambda a: a.cast("string")), ",").alias("amounts"), "image", "sku", "gap")


#: plan, status, start, end (days from now), analysis limit as given, then the active plan, limit, milliseconds and concurrency.
PLANS = [
    ("team", "active", -1, 1, "500", "team", 500, 360000, 6),
    ("team", "trialing", 0, 1, "1000", "team", 1000, 720000, 12),
    ("team", "active", -2, 0, "50", None, 50, 90000, 3),
    ("team", "past_due", -1, 1, "abc", None, 20, 90000, 3),
    ("team", "active", None, 1, "70", None, 20, 90000, 3),
    (None, "active", -1, 1, None, None, 20, 90000, 3),
]


@query(expected("customer", "c_custkey", PLANS, range(5, 9), "plan, analysis_limit, budget_ms, concurrency"))
def active_plans(spark, sf_dir):
    """Plans of subscriptions that are active, and what a plan lets a run analyse."""
    plan, status, start, end, given = picked("c_custkey", PLANS, *range(5))
    now = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    day = lambda d: now + F.make_dt_interval(d.cast("int"))
    limit = K.analysis_limit(given)
    c = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), K.active_plan(plan, status, day(start), day(end), now).alias("plan"), limit.alias("analysis_limit"), K.analysis_effort(limit).alias("e"))
    return c.select("id", "plan", "analysis_limit", "e.*")


#: html, then the currency with structured data and without.
MONEY = [
    ('<meta property="product:price:currency" content="usd">', "USD", "USD"),
    ('<meta property="product:price:amount" content="5"><meta property="og:price:currency" content="EUR">"priceCurrency":"GBP"', "GBP", ""),
    ('<meta property="og:price:currency" content="EUR"><meta itemprop="priceCurrency" content="USD">', "EUR", "EUR"),
    ('<meta itemprop="priceCurrency" content="SEK"><meta itemprop="priceCurrency" content="NOK">', "", ""),
    ('{"priceCurrency": "JPY", "offers": {"priceCurrency": "jpy"}}', "JPY", ""),
    ('{"priceCurrency": "JPY", "offers": {"priceCurrency": "KRW"}}', "", ""),
    ("nothing", "", ""),
    (None, "", ""),
]


@query(expected("part", "p_partkey", MONEY, range(1, 3), "currency, direct"))
def confirmed_currencies(spark, sf_dir):
    """The currency that a page confirms for its product."""
    html = picked("p_partkey", MONEY, 0)[0]
    return dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), K.confirmed_currency(html).alias("currency"), K.confirmed_currency(html, False).alias("direct"))


#: destination, caption, page name, slug, domain, brand, then support and the domain's brand.
ADS = [
    ("https://www.tea-shop.com/x", None, "Tea Shop", "teashop", "tea-shop.com", "Tea", True, "tea"),
    ("https://eu.tea.co.uk/x", None, "Other", "tea", "tea.co.uk", "Tea House", False, "tea"),
    ("https://other.com", "see TEA.COM today", "The tea people", "x", "www.tea.com", "tea", True, "tea"),
    ("https://other.com", "see us", "tea", "tea", "tea.com", "tea", False, "tea"),
    (None, "tea.com", "!!!", "tea", "tea.com", "Leaf", False, "tea"),
    ("https://nottea.com", None, "tea", "tea", "tea.com", "tea", False, "tea"),
    ("https://official-store.com", None, "Official Store", "official-store", "official-store.com", "x", True, "store"),
    ("https://my-blue-tea-online.de/", None, "Blue", "myblueteaonline", "my-blue-tea-online.de", "", True, "mybluetea"),
]


@query(expected("part", "p_partkey", ADS, range(6, 8), "supported, brand"))
def ad_identities(spark, sf_dir):
    """Whether ad records speak for a company, and the brand that its domain names."""
    destination, caption, page, slug, domain, brand = picked("p_partkey", ADS, *range(6))
    supported = K.ad_supports_identity(destination, F.array_compact(F.array(caption)), page, slug, domain, brand)
    return dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), supported.alias("supported"), K.domain_brand(domain).alias("brand"))


#: kinds and urls of two attempts, then the endpoint; flags of a discovery batch, then its completeness.
ATTEMPTS = [
    ("network", "https://a.com/x", "network", "https://A.com/y", True, 5, 5, True, True, True, 9, 9, "https://A.com/y", False, True, True),
    ("network", "https://a.com/x", "http", "https://a.com/y", True, 6, 5, True, True, True, 9, 9, None, True, False, False),
    ("network", "http://a.com/x", "network", "http://a.com/x", True, 5, 5, False, True, True, 9, 9, None, False, False, False),
    ("network", "https://a.com/", "network", "https://www.a.com/", True, 5, 5, True, True, False, 9, 9, None, False, True, False),
    (None, None, "network", "https://a.com", False, 0, 0, True, True, True, 9, 9, None, False, False, False),
    ("network", "https://a.com", "network", "https://a.com", True, 1, 2, True, False, True, 10, 9, "https://a.com", False, False, False),
    ("network", "https://a.com:1", "network", "https://a.com:2", True, 1, 2, True, True, True, 8, 9, None, False, True, False),
]


@query(expected("part", "p_partkey", ATTEMPTS, range(12, 16), "endpoint, truncated, batch_complete, complete"))
def unavailable_endpoints(spark, sf_dir):
    """Endpoints that two attempts prove unavailable, and how complete a discovery batch was."""
    v = picked("p_partkey", ATTEMPTS, *range(12))
    attempt = lambda k, u: F.struct(k.alias("kind"), u.alias("url"))
    names = ("searches_complete", "found", "investigated", "verified", "stored", "prior_complete", "end_index", "eligible")
    c = K.discovery_coverage(F.struct(*(x.alias(n) for n, x in zip(names, v[4:]))))
    p = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), K.unavailable_state(attempt(v[0], v[1]), attempt(v[2], v[3])).alias("endpoint"), c.alias("c"))
    return p.select("id", "endpoint", "c.*")
