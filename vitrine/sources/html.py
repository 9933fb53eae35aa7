"""Structured data of supplied pages: JSON-LD, metadata, headings, links, sitemaps, robots files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_host, page_host

_INERT = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|svg)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)(?:</\1\s*>|\Z)", re.S | re.I
)
_LD = re.compile(r"<script\b[^>]*application/ld\+json[^>]*>.*?</script\s*>", re.I | re.S)
_META = re.compile(r"<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
#: Fixed value: the schema.org types that are products here.
PRODUCT_TYPES = ("Product", "SoftwareApplication", "Service")
PRODUCT = (
    "name string, description string, category string, kind string, currency string, price string, low string, high string, "
    "gtin string, sku string, mpn string, brand string, image string, url string"
)


def strip_inert(html: str | None) -> str:
    """Markup without comments and without the bodies of scripts, styles, templates and the like; quoted > signs do not end a tag."""
    return _INERT.sub(" ", html or "")


def attributes(tag: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(tag)}


def metadata(html: str | None) -> dict[str, str]:
    """First content of each property, name or itemprop of active meta elements."""
    out: dict[str, str] = {}
    for m in _META.finditer(strip_inert(html)):
        a = attributes(m[1])
        key = a.get("property") or a.get("name") or a.get("itemprop")
        if key and a.get("content"):
            out.setdefault(key, a["content"])
    return out


def nodes(value) -> list[dict]:
    """All records of a JSON-LD value: lists, graphs, main entities and list elements, from the outside in."""
    if isinstance(value, list):
        return [n for v in value for n in nodes(v)]
    if not isinstance(value, dict):
        return []
    return [value, *(n for key in ("@graph", "mainEntity", "itemListElement") for n in nodes(value.get(key)))]


def json_ld(html: str | None) -> tuple[list[dict], int]:
    """Records of the page's JSON-LD blocks, and how many blocks could not be read."""
    found, broken = [], 0
    for m in _INERT.finditer(html or ""):
        if m[1] and m[1].lower() == "script" and attributes(m[2]).get("type", "").lower() == "application/ld+json":
            try:
                found += nodes(json.loads(m[3]))
            except ValueError:
                broken += 1
    return found, broken


def text_of(value) -> str | None:
    """A text, number or name of a record; the first of a list."""
    if isinstance(value, list):
        return next((t for t in map(text_of, value) if t), None)
    if isinstance(value, dict):
        return text_of(value.get("name") or value.get("url"))
    return None if value is None or isinstance(value, bool) else " ".join(re.sub("<[^>]*>", " ", str(value)).split()) or None


def product(node: dict) -> tuple | None:
    kinds = node.get("@type")
    kind = next((k for k in (kinds if isinstance(kinds, list) else [kinds]) if k in PRODUCT_TYPES), None)
    name = text_of(node.get("name"))
    if kind is None or not name:
        return None
    offers = node.get("offers")
    offer = next((o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)), {})
    gtin = next((t for k in ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "isbn") if (t := text_of(node.get(k)))), None)
    fields = [name, text_of(node.get("description")), text_of(node.get("category")), kind]
    fields += [text_of(offer.get(k)) for k in ("priceCurrency", "price", "lowPrice", "highPrice")]
    return (*fields, gtin, text_of(node.get("sku")), text_of(node.get("mpn")), text_of(node.get("brand")), text_of(node.get("image")), text_of(node.get("url")))


def extract_products(pages: DataFrame) -> DataFrame:
    """page_id, position, the fields of PRODUCT and broken (unreadable blocks of the page) of every product in the pages' JSON-LD; a page without one gives its metadata product, if it has a title and a price there."""
    names = [f.split()[0] for f in PRODUCT.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for page_id, html in zip(b["page_id"], b["html"]):
                records, broken = json_ld(html)
                found = [p for p in map(product, records) if p]
                if not found:
                    m = metadata(html)
                    title, price = m.get("og:title"), m.get("product:price:amount") or m.get("og:price:amount")
                    if title and price:
                        currency = m.get("product:price:currency") or m.get("og:price:currency")
                        found = [(title, m.get("og:description"), None, "PageSignal", currency, price, *[None] * 6, m.get("og:image"), m.get("og:url"))]
                out += [(page_id, k, *p, broken) for k, p in enumerate(found)]
            yield pd.DataFrame(out, columns=["page_id", "position", *names, "broken"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, position int, {PRODUCT}, broken int")


def sitemap_urls(sitemaps: DataFrame, most: int = 1000) -> DataFrame:
    """domain, position, url and truncated of the first `most` locations on the domain's own hosts."""
    urls = F.regexp_extract_all("document", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</loc>"), 1)
    host, own = page_host("url"), canonical_host("domain")
    rows = sitemaps.select("domain", F.posexplode(urls).alias("at", "url")).filter((canonical_host(host) == own) | F.endswith(host, F.concat(F.lit("."), own)))
    order = Window.partitionBy("domain").orderBy("at")
    rows = rows.withColumn("position", F.row_number().over(order) - 1)
    more = F.max(F.col("position") >= most).over(Window.partitionBy("domain"))
    return rows.withColumn("truncated", more).filter(F.col("position") < most).select("domain", "position", "url", "truncated")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """domain, allow, pattern of the rules that hold for an agent: those of all groups that name it best; `*` is the weakest name.

    Lines are numbered; a group starts at a User-agent line that follows a rule.
    """
    line = F.trim(F.regexp_replace(F.col("line"), "#.*$", ""))
    rows = files.select("domain", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line")).withColumn("line", line)
    rows = rows.withColumn("field", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))).withColumn("value", F.trim(F.regexp_replace("line", "^[^:]*:", "")))
    rows = rows.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("domain").orderBy("n")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("rule")) != "user-agent")
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    named = F.lower(F.col("value"))
    strength = F.when(named == "*", 0).when(F.contains(F.lit(agent.lower()), named) & (named != ""), F.length(named))
    groups = rows.filter("field = 'user-agent'").groupBy("domain", "group").agg(F.max(strength).alias("s")).filter("s IS NOT NULL")
    best = groups.withColumn("top", F.max("s").over(Window.partitionBy("domain"))).filter("s = top").select("domain", "group")
    rules = rows.filter("field <> 'user-agent' AND value <> ''").join(best, ["domain", "group"])
    return rules.select("domain", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is anything, $ at the end is the end."""
    quoted = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (domain, path) with allowed: the longest matching pattern decides, allow wins ties, no rule allows."""
    specific = F.length(F.regexp_replace("pattern", r"[*$]", ""))
    hits = urls.join(rules.withColumn("regex", pattern_regex(F.col("pattern"))), "domain").filter(F.expr("rlike(path, regex)"))
    verdict = hits.groupBy("domain", "path").agg(F.max_by("allow", F.struct(specific, F.col("allow"))).alias("allowed"))
    return urls.join(verdict, ["domain", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def storefront_products(payloads: DataFrame) -> DataFrame:
    """Products of storefront JSON: payloads has domain, body with products of id, title, vendor, product_type, variants of price, available, sku.

    The price is that of the only amount of the available variants, null if they differ.
    """
    schema = "products ARRAY<STRUCT<id: STRING, title: STRING, vendor: STRING, product_type: STRING, variants: ARRAY<STRUCT<price: STRING, available: BOOLEAN, sku: STRING>>>>"
    p = payloads.select("domain", F.explode(F.from_json("body", schema)["products"]).alias("p"))
    live = F.filter("p.variants", lambda v: F.coalesce(v["available"], F.lit(True)))
    amounts = F.array_distinct(F.transform(live, lambda v: v["price"].try_cast("double")))
    return p.select(
        "domain",
        F.col("p.id").alias("id"),
        F.col("p.title").alias("name"),
        F.col("p.vendor").alias("brand"),
        F.col("p.product_type").alias("category"),
        F.when(F.size(amounts) == 1, amounts[0]).alias("price"),
        F.get(F.filter(F.transform("p.variants", lambda v: v["sku"]), lambda s: s != ""), 0).alias("sku"),
    )


def storefront_product(payloads: DataFrame) -> DataFrame:
    """The product of a storefront's single-product JSON, or why there is none or no price: key columns, name, category, amounts, image, sku, gap.

    payloads has requested (the handle asked for), currency ('' if the page names none), body.
    Prices are whole smallest units of two digits; they count only if every variant has a
    positive one. A variant's number and image count only if it is the only variant.
    """
    schema = "title STRING, handle STRING, type STRING, featured_image STRING, images ARRAY<STRING>, variants ARRAY<STRUCT<price: STRING, title: STRING, sku: STRING, featured_image: STRUCT<src: STRING>>>"
    keys = [c for c in payloads.columns if c not in ("requested", "currency", "body")]
    p = payloads.withColumn("p", F.from_json("body", schema))
    variants = F.filter(F.coalesce("p.variants", F.from_json(F.lit("[]"), "ARRAY<STRUCT<price: STRING, title: STRING, sku: STRING, featured_image: STRUCT<src: STRING>>>")), lambda v: v.isNotNull())
    p = p.withColumn("v", variants).withColumn("units", F.transform("v", lambda v: F.when(v["price"].rlike(r"^\d+$"), v["price"].try_cast("long"))))
    name, handle = F.trim(F.coalesce("p.title", F.lit(""))), F.coalesce(F.try_url_decode(F.trim(F.coalesce("p.handle", F.lit("")))), F.lit(""))
    priced = (F.size("v") > 0) & F.forall("units", lambda u: F.coalesce(u > 0, F.lit(False)))
    named = F.coalesce("currency", F.lit("")) != ""
    sound = (name != "") & (handle != "") & (handle == F.col("requested"))
    gap = (
        F.when((name == "") | (handle == ""), "invalid-payload")
        .when(handle != F.col("requested"), "different-handle")
        .when(~priced, "incomplete-prices")
        .when(~named, "no-currency")
        .otherwise("")
    )
    only = F.when(F.size("v") == 1, F.col("v")[0])
    images = F.concat(F.array(only["featured_image"]["src"], F.col("p.featured_image")), F.coalesce("p.images", F.array().cast("array<string>")))
    image = F.get(F.filter(F.transform(images, lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)), lambda u: F.coalesce(F.startswith(F.lower(u), F.lit("https://")), F.lit(False))), 0)
    amounts = F.when(priced & named, F.array_distinct(F.transform("units", lambda u: u / 100))).otherwise(F.array().cast("array<double>"))
    kept = lambda c: F.when(sound, c)
    return p.select(
        *keys, kept(name).alias("name"), kept(F.col("p.type")).alias("category"), kept(amounts).alias("amounts"), kept(F.coalesce(image, F.lit(""))).alias("image"), kept(F.nullif(F.trim(only["sku"]), F.lit(""))).alias("sku"), gap.alias("gap")
    )


def bounded_document(html: str, limit: int) -> str:
    """A document of at most `limit` bytes (1024 at least): three parts of its head, one of its tail, and between them the structured data that would be lost, up to 0.4 of the limit."""
    limit, raw = max(1024, limit), html.encode()
    if len(raw) <= limit:
        return html
    kept, used = [], 0
    for block in _LD.findall(html):
        size = len(block.encode()) + 1
        if used + size <= limit * 0.4:
            kept.append(block)
            used += size
    middle = "\n<!-- omitted -->\n" + "".join(f"{block}\n" for block in kept)
    room = max(0, limit - len(middle.encode()))
    head = room * 3 // 4
    return raw[:head].decode(errors="ignore") + middle + raw[len(raw) - (room - head) :].decode(errors="ignore")


def search_results(payloads: DataFrame) -> DataFrame:
    """url, title, query of nested search payloads, the first of each url."""
    schema = "queries ARRAY<STRUCT<query: STRING, results: ARRAY<STRUCT<url: STRING, title: STRING>>>>"
    q = payloads.select(F.posexplode(F.from_json("body", schema)["queries"]).alias("i", "q"))
    r = q.select("i", F.col("q.query").alias("query"), F.posexplode("q.results").alias("j", "r"))
    first = r.groupBy(F.col("r.url").alias("url")).agg(F.min(F.struct("i", "j", F.col("r.title").alias("title"), "query")).alias("f"))
    return first.filter("url IS NOT NULL").select("url", "f.title", "f.query")


def ad_concepts(records: DataFrame) -> DataFrame:
    """Concepts of ad records (id, page, message, headline, cta, destination, start, stop, media, platforms): placements, first start, last stop, up to six platforms, first media."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    last = records.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("page", "message", "headline", "cta", "destination", "start", "stop", "media", "platforms", "ord"), "ord").alias("r")).select("id", "r.*")
    key = F.concat_ws("|", *(plain(c) for c in ("page", "message", "headline", "cta")), F.regexp_extract(F.coalesce("destination", F.lit("")), r"^https?://([^?#]*)", 1))
    keyed = last.withColumn("key", key)
    shown = keyed.select("key", F.explode("platforms").alias("platform")).filter("platform IS NOT NULL").groupBy("key").agg(F.slice(F.array_sort(F.collect_set("platform")), 1, 6).alias("platforms"))
    g = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("placements"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.min_by("media", F.when(F.coalesce("media", F.lit("")) != "", F.col("ord"))).alias("media"),
    )
    return g.join(shown, "key", "left")
