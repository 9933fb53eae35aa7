"""Products of pages in full: JSON-LD, plan cards and page signals, with metadata prices by namespace.

All of it is column expressions. JSON-LD becomes VARIANT; its records are found by a walk of bounded
depth in which each step gives a row's value and its children, so one scan with a few
narrow steps yields every record, and a container at the bound is reported rather than
followed. Metadata prices are counted per page, namespace and value first and per page then, so
no order of rows or merges matters and no page is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prices as P
from ..functions import text as X
from ..functions import urls as U
from ..functions.constants import (
    CONTACT_PATTERN,
    EXCLUDED_PAGE_PATTERN,
    GENERIC_PAGE_NAME_PATTERN,
    OLD_PRICE_PATTERN,
    PLAN_LABEL_PATTERN,
    PLAN_NAME_PATTERN,
    PRICING_PAGE_PATTERN,
    PRODUCT_HEADING_PATTERN,
    PRODUCT_PAGE_PATTERN,
)
from ..functions.numbers import bound
from .html import PRODUCT_TYPES

#: Containers of records, and how deep they are followed.
RECORD_KEYS, MOST_DEPTH = ("@graph", "mainEntity", "itemListElement"), 8
#: Price namespaces of metadata in order of precedence: amount key, currency key, scope.
NAMESPACES = [("product:sale_price", "product"), ("product:price", "product"), ("og:price", "og")]
LD = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
PRICE = "struct<currency:string,amount:double>"


def active(html: Column) -> Column:
    """Markup without comments and the bodies of elements that show nothing."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\z)", " ")


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def items(v: Column) -> Column:
    """Elements of a VARIANT that is an array, else null."""
    return v.try_cast("array<variant>")


def text(v: Column, key: str) -> Column:
    """A text or number of a record, or the name of a record there; the first of a list; null if there is none."""
    one = lambda x: F.coalesce(at(x, "$.name", "string"), F.when(x.try_cast("map<string,variant>").isNull() & items(x).isNull() & ~F.schema_of_variant(x).isin("BOOLEAN", "VOID"), at(x, "$", "string")))
    value = at(v, f"$['{key}']")
    found = F.coalesce(F.get(F.array_compact(F.transform(items(value), one)), 0), one(value))
    return F.nullif(X.clean(found), F.lit(""))


def children(v: Column, keys: tuple[str, ...]) -> Column:
    """Values inside a list, or under the keys of a record."""
    return F.coalesce(items(v), F.array_compact(F.array(*(at(v, f"$['{k}']") for k in keys))))


def walk(df: DataFrame, value: str, keys: tuple[str, ...], most_depth: int = MOST_DEPTH) -> DataFrame:
    """df's rows, once for each record reached from `value`, with `value` the record, `path` its place in document order, and `deep`: a container at the bound that was not followed.

    Lists and the given keys of records are followed, most_depth steps at most.
    """
    rest = [c for c in df.columns if c != value]
    rows = df.select(*rest, F.struct(F.col(value).alias("v"), F.array().cast("array<int>").alias("path"), F.lit(True).alias("open")).alias("__node"))

    def step(n: Column) -> Column:
        below = lambda k: F.struct(k["v"].alias("v"), F.concat(n["path"], F.array(k["i"])).alias("path"), F.lit(True).alias("open"))
        numbered = lambda c: F.transform(c, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        own = F.struct(n["v"].alias("v"), n["path"].alias("path"), F.lit(False).alias("open"))
        return F.when(n["open"], F.concat(F.array(own), F.transform(numbered(children(n["v"], keys)), below))).otherwise(F.array(n))

    for _ in range(most_depth):
        rows = rows.select(*rest, F.explode(step(F.col("__node"))).alias("__node"))
    deep = F.col("__node.open") & (F.size(children(F.col("__node.v"), keys)) > 0)
    found = rows.select(*rest, F.col("__node.v").alias(value), F.col("__node.path").alias("path"), F.coalesce(deep, F.lit(False)).alias("deep"))
    return found.filter(F.col(value).try_cast("map<string,variant>").isNotNull() | F.col("deep"))


def find_texts(df: DataFrame, value: str, key: str, most_depth: int = 8) -> DataFrame:
    """df's rows with `texts`: the distinct texts of every array under `key`, searched to most_depth containers; no row if there are none.

    A record that has the key as an array isn't searched further.
    """
    rest = [c for c in df.columns if c != value]
    rows = df.select(*rest, F.struct(F.col(value).alias("v"), F.array().cast("array<int>").alias("path"), F.lit(True).alias("open")).alias("__node"))

    def step(n: Column) -> Column:
        hit = items(at(n["v"], f"$['{key}']"))
        values = F.coalesce(items(n["v"]), F.map_values(n["v"].try_cast("map<string,variant>")), F.array().cast("array<variant>"))
        below = F.transform(values, lambda v, i: F.struct(v.alias("v"), F.concat(n["path"], F.array(i)).alias("path"), F.lit(True).alias("open")))
        own = F.array(F.struct(n["v"].alias("v"), n["path"].alias("path"), F.lit(False).alias("open")))
        return F.when(~n["open"], F.array(n)).when(hit.isNotNull(), own).otherwise(below)

    for _ in range(most_depth + 1):
        rows = rows.select(*rest, F.explode(step(F.col("__node"))).alias("__node"))
    said = F.transform(items(at(F.col("__node.v"), f"$['{key}']")), lambda v: at(v, "$", "string"))
    found = rows.filter("NOT __node.open").select(*rest, F.col("__node.path").alias("path"), F.array_distinct(F.filter(said, lambda t: F.coalesce(t, F.lit("")) != "")).alias("texts"))
    return found.filter("size(texts) > 0")


def ld_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, block, value (VARIANT; null if the block is not JSON) of the pages' JSON-LD."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", " ")
    blocks = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(html, F.lit(LD), 1)).alias("block", "body"))
    return blocks.select("page_id", "url", "block", F.try_parse_json(F.trim("body")).alias("value"))


def own_prices(o: Column, as_of: Column) -> Column:
    """live, prices, inner of one offer: if it counts now, the price or both ends of the range that it states, and the offers inside it."""
    label = F.concat_ws(" ", *(at(o, f"$.{k}", "string") for k in ("priceType", "name", "description")))
    label = F.lower(F.regexp_replace(F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1 $2"), "[^a-zA-Z0-9]+", " "))
    until = at(o, "$.priceValidUntil", "string")
    live = at(o, "$.priceValidUntil").isNull() | F.coalesce(until.try_cast("timestamp") >= as_of, F.lit(False))
    code = F.upper(F.trim(at(o, "$.priceCurrency", "string")))
    amount = lambda k: F.when(at(o, f"$.{k}", "string").rlike(r"^\s*\d+(,\d{3})*(\.\d+)?\s*$"), F.translate(at(o, f"$.{k}", "string"), ", ", "").try_cast("double"))
    price = lambda k: F.struct(code.alias("currency"), amount(k).alias("amount"))
    good = P.is_supported_currency(code)
    ranged = at(o, "$.lowPrice").isNotNull() | at(o, "$.highPrice").isNotNull()
    whole = good & (amount("lowPrice") > 0) & (amount("lowPrice") <= amount("highPrice"))
    prices = F.when(ranged & whole, F.array_distinct(F.array(price("lowPrice"), price("highPrice")))).when(~ranged & good & amount("price").isNotNull(), F.array(price("price")))
    return F.struct((live & ~label.rlike(OLD_PRICE_PATTERN)).alias("live"), F.coalesce(prices, F.array().cast(f"array<{PRICE}>")).alias("prices"), at(o, "$.offers").alias("inner"))


def with_prices(df: DataFrame, offers: Column, as_of: Column) -> DataFrame:
    """df with `prices`, the current prices of a VARIANT of offers: one price, or the two ends of one range, else none.

    An offer without a price of its own counts with what the offers inside it (an aggregate's) come to; deeper ones are left out.
    """
    none = F.array().cast(f"array<{PRICE}>")
    flat = lambda x: F.filter(F.coalesce(F.flatten(F.transform(items(x), lambda y: F.coalesce(items(y), F.array(y)))), F.array(x)), lambda o: o.try_cast("map<string,variant>").isNotNull())
    every = lambda groups: F.array_distinct(F.flatten(groups))
    settles = lambda groups, e: (F.size(e) <= 1) | ((F.size(e) == 2) & F.exists(groups, lambda g: (F.size(g) == 2) & (g == e)))
    rows = df.withColumn("__offers", flat(offers))
    rows = rows.withColumn("__offers", F.transform("__offers", lambda o: own_prices(o, as_of)))
    rows = rows.withColumn("__offers", F.filter("__offers", lambda o: o["live"]))
    rows = rows.withColumn("__inner", F.transform("__offers", lambda o: F.coalesce(flat(o["inner"]), F.array().cast("array<variant>"))))
    rows = rows.withColumn("__inner", F.transform("__inner", lambda g: F.transform(g, lambda o: own_prices(o, as_of))))
    rows = rows.withColumn("__inner", F.transform("__inner", lambda g: F.transform(F.filter(g, lambda o: o["live"]), lambda o: o["prices"])))
    rows = rows.withColumn("__inner", F.transform("__inner", lambda g: F.when(settles(g, every(g)), every(g)).otherwise(none)))
    rows = rows.withColumn("__groups", F.zip_with("__offers", "__inner", lambda o, g: F.when(F.size(o["prices"]) > 0, o["prices"]).otherwise(g)))
    rows = rows.withColumn("__every", every(F.col("__groups")))
    prices = F.when(settles(F.col("__groups"), F.col("__every")), F.col("__every"))
    return rows.withColumn("prices", F.coalesce(prices, none)).drop("__offers", "__inner", "__groups", "__every")


def ld_products(pages: DataFrame, as_of: Column, most_depth: int = MOST_DEPTH) -> DataFrame:
    """page_id, url, block, path, kind, name, category, sku, mpn, brand, prices of every product in JSON-LD."""
    v = F.col("value")
    records = walk(ld_blocks(pages), "value", RECORD_KEYS, most_depth).filter("NOT deep")
    types = F.coalesce(items(at(v, "$['@type']")), F.array(at(v, "$['@type']")))
    kind = F.get(F.filter(F.transform(types, lambda t: at(t, "$", "string")), lambda t: t.isin(*PRODUCT_TYPES)), 0)
    rows = records.withColumn("kind", kind).withColumn("name", F.coalesce(text(v, "name"), text(v, "headline"))).filter("kind IS NOT NULL AND name IS NOT NULL")
    category = F.coalesce(text(v, "category"), text(v, "applicationCategory"), text(v, "serviceType"))
    rows = with_prices(rows, at(v, "$.offers"), as_of)
    return rows.select(
        "page_id", "url", "block", "path", "kind", F.substring("name", 1, 160).alias("name"), F.substring(category, 1, 120).alias("category"),
        text(v, "sku").alias("sku"), text(v, "mpn").alias("mpn"), text(v, "brand").alias("brand"), "prices",
    )


def meta_rows(pages: DataFrame) -> DataFrame:
    """page_id, key, content of every active meta element, by property, name and itemprop."""
    tags = pages.select("page_id", F.explode(F.regexp_extract_all(active(F.col("html")), F.lit(r"(?is)<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), 1)).alias("tag"))
    value = lambda k: F.regexp_replace(F.regexp_extract("tag", rf"(?is)(?:^|\s){k}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")
    keys = F.array_distinct(F.filter(F.array(*map(value, ("property", "name", "itemprop"))), lambda k: k != ""))
    return tags.select("page_id", F.explode(keys).alias("key"), X.clean(value("content")).alias("content")).filter("content <> ''")


def namespace_offers(rows: DataFrame) -> DataFrame:
    """page_id, scope, amount, currency, state of each page's first price namespace, from rows of page_id, key, content.

    state is 'offer' if the namespace states one amount in one known currency; 'several' for two
    amounts; 'conflict' if an amount can't be read, there are more than two, or the currency isn't
    one known code; 'incomplete' if amount or currency is missing. A later namespace never
    makes up for an earlier one. Pages without a price namespace have no row.
    """
    place = F.coalesce(*(F.when(F.col("key").isin(f"{ns}:amount", f"{ns}:currency"), i) for i, (ns, _) in enumerate(NAMESPACES)))
    is_amount = F.endswith("key", F.lit(":amount"))
    plain = F.when(F.col("content").rlike(r"^[^\d-]*\d{1,3}(,\d{3})*(\.\d+)?[^\d]*$|^[^\d-]*\d+([.,]\d{1,2}|\.\d+)?[^\d]*$"), F.regexp_extract("content", r"(\d[\d,]*(?:\.\d+)?)", 1))
    number = F.when(plain.rlike(r"^\d{1,3}(,\d{3})+"), F.translate(plain, ",", "")).otherwise(F.translate(plain, ",", ".")).try_cast("double")
    known = rows.select("page_id", place.alias("place"), is_amount.alias("is_amount"), F.when(is_amount, F.lpad(F.when(number > 0, number.cast("decimal(24,6)").cast("string")), 26, "0")).otherwise(F.upper("content")).alias("value")).filter("place IS NOT NULL")
    # Distinct values first: counts and bounds of them are the same for any order of rows and merges.
    distinct = known.groupBy("page_id", "place", "is_amount", "value").agg(F.lit(1).alias("one"))
    amount = F.col("is_amount") & F.col("value").isNotNull()
    of = lambda f, c: f(F.when(c, F.col("value")))
    state = distinct.groupBy("page_id", "place").agg(
        F.count(F.when(F.col("is_amount"), 1)).alias("n_amounts"),
        F.count(F.when(F.col("is_amount") & F.col("value").isNull(), 1)).alias("n_bad"),
        F.count(F.when(~F.col("is_amount"), 1)).alias("n_currencies"),
        of(F.min, amount).alias("low"),
        of(F.max, amount).alias("high"),
        of(F.min, ~F.col("is_amount")).alias("code"),
    )
    first = state.groupBy("page_id").agg(F.min(F.struct(*("place", *(c for c in state.columns if c not in ("page_id", "place"))))).alias("s")).select("page_id", "s.*")
    kind = (
        F.when((F.col("n_amounts") == 0) | (F.col("n_currencies") == 0), "incomplete")
        .when((F.col("n_bad") > 0) | (F.col("n_amounts") > 2) | (F.col("n_currencies") != 1) | ~P.is_supported_currency("code"), "conflict")
        .when(F.col("n_amounts") == 2, "several")
        .otherwise("offer")
    )
    scope = F.array(*(F.lit(s) for _, s in NAMESPACES))[F.col("place")]
    rows = first.withColumn("state", kind)
    offer = F.col("state") == "offer"
    return rows.select("page_id", scope.alias("scope"), F.when(offer, F.col("low").cast("double")).alias("amount"), F.when(offer, F.col("code")).alias("currency"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "code", "state")


def integrity(signals: Column, selector: Column) -> Column:
    """If stored signals (raw, amount, currency) can be trusted: at least one, all re-parse to what is stored, one known currency, and the URL's currency ('' for none) is the same."""
    close = lambda a, b: F.abs(a - b) <= 16 * 2.0**-52 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))

    def sound(s: Column) -> Column:
        return bound(P.parse_price(F.concat_ws(" ", F.upper(s["currency"]), F.regexp_replace(s["raw"], r"(?i)\b[a-z]{3}\b|[$£€]", " "))), lambda p: F.coalesce(close(p["amount"], s["amount"].cast("double")) & (s["amount"] > 0) & P.is_supported_currency(s["currency"]), F.lit(False)))

    codes = F.array_distinct(F.transform(signals, lambda s: F.upper(F.trim(s["currency"]))))
    return F.coalesce((F.size(signals) > 0) & F.forall(signals, sound) & (F.size(codes) == 1) & ((F.coalesce(selector, F.lit("")) == "") | (F.upper(selector) == codes[0])), F.lit(False))


def plan_cards(pages: DataFrame) -> DataFrame:
    """page_id, name, tier, basis, period, commitment, amount, currency, contact of the plans on pricing pages: a heading that is a plan's name, with the section below it; the last priced card of a name counts."""
    whole = r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]>.*?)(?=<h[1-6]\b|\z)"
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|svg|template)\b[^>]*>.*?</\1\s*>", " ")
    cards = pages.filter(U.url_path("url").rlike(PRICING_PAGE_PATTERN)).select("page_id", F.posexplode(F.regexp_extract_all(shown, F.lit(whole), 1)).alias("at", "card"))
    heading = F.regexp_extract("card", r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1)
    cards = cards.select("page_id", "at", X.squeeze(F.regexp_replace(X.clean(heading), PLAN_LABEL_PATTERN, " ")).alias("name"), X.clean(F.col("card")).alias("section")).filter(F.col("name").rlike(PLAN_NAME_PATTERN))
    context = F.substring("section", 1, 1200)
    price = r"(?i)((?:[$£€]\s?\d+(?:[.,]\d{1,2})?(?:\s*(?:USD|GBP|EUR))?(?:\s*(?:/\s*|per\s+(?:(?:user|seat|channel|brand|workspace|social\s+set)\s*[,/]?\s*(?:per\s+)?)?)(?:month|mo|year|yr))?|\d+(?:[.,]\d{1,2})?\s*(?:USD|GBP|EUR)(?:\s*/\s*(?:month|mo|year|yr))?))"
    raws = F.regexp_extract_all(context, F.lit(price), 1)
    often = lambda r: F.lower(F.regexp_extract(r, r"(?i)(month|mo|year|yr)\s*$", 1))
    raw = F.coalesce(F.get(F.filter(raws, lambda r: often(r) != ""), 0), F.get(raws, 0))
    rows = cards.withColumn("raw", raw).filter(F.col("raw").isNotNull() | context.rlike(CONTACT_PATTERN))
    amount = F.regexp_replace(F.regexp_extract("raw", r"(\d+(?:[.,]\d{1,2})?)", 1), ",", ".").try_cast("double")
    rows = rows.withColumn("period", F.nullif(often(F.col("raw")), F.lit(""))).withColumn("amount", F.when(F.col("period").isNotNull() | (amount == 0), amount))
    tier = (
        F.when(F.col("name").rlike(r"(?i)\b(enterprise|custom)\b"), "enterprise")
        .when(F.col("name").rlike(r"(?i)\bfree\b") | (F.col("amount") == 0) | (F.col("name").rlike(r"(?i)\bpersonal\b") & F.col("amount").isNull()), "free")
        .when(F.col("name").rlike(r"(?i)\b(basic|essentials?|starter|standard|unlimited|personal)\b"), "entry")
        .otherwise("team")
    )
    basis = (
        F.when(F.col("amount").isNotNull() & F.col("raw").rlike(r"(?i)\bper\s+(?:user|seat)\b"), "user")
        .when(context.rlike(r"(?i)\bsocial\s+sets?\b"), "social-set")
        .when(context.rlike(r"(?i)\bchannels?\b"), "channel")
        .when(context.rlike(r"(?i)\bbrands?\b"), "brand")
        .when(context.rlike(r"(?i)\bworkspaces?\b"), "workspace")
        .when(context.rlike(r"(?i)\b(?:per\s+)?(?:user|seat)\b"), "user")
        .when(F.col("amount").isNotNull() & F.col("period").isNotNull(), "flat")
        .otherwise("unspecified")
    )
    commitment = (
        F.when(F.col("section").rlike(r"(?i)\b(?:billed|billing|paid|pay)\s+(?:yearly|annually|annual)\b|\bannual\s+(?:billing|commitment|contract)\b"), "annual")
        .when(F.col("section").rlike(r"(?i)\b(?:billed|billing|paid|pay)\s+monthly\b|\bmonth[- ]to[- ]month\b|\bmonthly\s+(?:billing|commitment|contract)\b"), "monthly")
        .otherwise("unspecified")
    )
    rows = rows.select(
        "page_id", "at", "name", tier.alias("tier"), basis.alias("basis"), "period", F.when(F.col("period").isNotNull(), commitment).alias("commitment"), "amount",
        F.when(F.col("amount").isNotNull(), F.coalesce(F.nullif(F.upper(F.regexp_extract("raw", "(?i)(USD|GBP|EUR)", 1)), F.lit("")), F.when(F.contains("raw", F.lit("£")), "GBP").when(F.contains("raw", F.lit("€")), "EUR").otherwise("USD"))).alias("currency"),
        (F.col("amount").isNull() & context.rlike(CONTACT_PATTERN) & ~context.rlike(r"(?i)\bfree forever\b")).alias("contact"),
    )
    best = Window.partitionBy("page_id", F.lower("name")).orderBy(F.col("amount").isNull(), F.when(F.col("amount").isNull(), F.col("at")).otherwise(-F.col("at")))
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "at")


def page_signals(pages: DataFrame, offers: DataFrame) -> DataFrame:
    """page_id, name, category, amount, currency of pages that look like a product's but state none: the heading that the title repeats, or the title, with the metadata's one offer."""
    path = U.url_path("url")
    shown = active(F.col("html"))
    title = X.clean(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    headings = F.filter(F.transform(F.regexp_extract_all(shown, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), 1), X.clean), lambda h: h != "")
    money = F.regexp_count(X.clean(shown), F.lit(r"(?i)[$€£]\s?\d{1,5}(?:[,.]\d{1,2})?|\d{1,5}(?:[,.]\d{1,2})?\s?(?:USD|EUR|GBP)"))
    rows = pages.select("page_id", path.alias("path"), title.alias("title"), headings.alias("headings"), money.alias("money"))
    rows = rows.join(offers.select(F.col("page_id").alias("pid"), "amount", "currency", "state"), F.col("page_id") == F.col("pid"), "left")
    like = F.when(F.col("path").rlike(EXCLUDED_PAGE_PATTERN), False).when(F.col("path").rlike(PRICING_PAGE_PATTERN), (F.col("money") > 0) & F.exists("headings", lambda h: h.rlike(r"(?i)\b(?:plan|tier|package)\b")))
    like = like.when(F.col("path").rlike(PRODUCT_PAGE_PATTERN), (F.col("money") > 0) | (F.size(F.filter("headings", lambda h: h.rlike(PRODUCT_HEADING_PATTERN))) >= 2)).otherwise(False)
    known = F.col("path").rlike(PRODUCT_PAGE_PATTERN) & F.col("state").isin("offer", "several")
    norm = lambda c: X.bilingual_normalize(c, ascii_only=True)
    head = F.get(F.filter("headings", lambda h: ~h.rlike(r"(?i)\b(?:logo|menu|skip navigation|home)\b")), 0)
    short = F.split("title", r"\s+[|—–-]\s+")[0]
    supported = (F.size(F.split(norm(head), " ")) >= 2) & F.contains(norm(F.col("title")), norm(head))
    name = F.when(F.coalesce(supported, F.lit(False)), head).when((short != "") & ~short.rlike(r"(?i)\b(?:logo|home)\b"), short).otherwise(F.coalesce(head, F.col("title")))
    rows = rows.filter(like | F.coalesce(known, F.lit(False))).withColumn("name", F.substring(name, 1, 160)).filter((F.col("name") != "") & ~F.col("name").rlike(GENERIC_PAGE_NAME_PATTERN))
    category = F.coalesce(F.nullif(F.regexp_extract("path", "^/+([^/]+)", 1), F.lit("")), F.lit("product page"))
    return rows.select("page_id", "name", category.alias("category"), "amount", "currency")


def page_products(pages: DataFrame, as_of: Column) -> DataFrame:
    """page_id, source, kind, name, category, amount, currency, low, high, audit of all products of pages (page_id, url, html).

    source is 'json-ld', 'plan' or 'page-signal'; a page signal counts only where the page states
    nothing else. Of JSON-LD records with one name on a page the last counts. A page's one
    Product record takes the metadata's offer if it has no price; if both contradict each other, or the
    metadata contradicts itself, it has none and says so in audit. Null html has no products.
    """
    offers = namespace_offers(meta_rows(pages))
    ld = ld_products(pages, as_of).withColumn("norm", F.lower(X.squeeze("name")))
    last = Window.partitionBy("page_id", "norm").orderBy(F.col("block").desc(), F.col("path").desc())
    ld = ld.withColumn("n", F.row_number().over(last)).filter("n = 1")
    one = ld.filter("kind = 'Product'").groupBy("page_id").agg(F.count(F.lit(1)).alias("products"))
    met = ld.join(one, "page_id", "left").join(offers.select(F.col("page_id").alias("pid"), F.col("amount").alias("m_amount"), F.col("currency").alias("m_currency"), F.col("low").alias("m_low"), F.col("high").alias("m_high"), "code", "state"), F.col("page_id") == F.col("pid"), "left")
    bound_ = (F.col("kind") == "Product") & (F.col("products") == 1) & F.col("state").isNotNull()
    codes = F.array_distinct(F.transform("prices", lambda p: p["currency"]))
    amounts = F.transform("prices", lambda p: p["amount"])
    other_code = (F.size(codes) > 0) & F.col("code").isNotNull() & ~F.forall(codes, lambda c: c == F.col("code"))
    fits = F.forall(amounts, lambda a: (a == F.col("m_low")) | (a == F.col("m_high"))) | F.array_contains(amounts, F.col("m_low")) & (F.col("m_low") == F.col("m_high"))
    other_amount = (F.size(amounts) > 0) & F.col("m_low").isNotNull() & ~fits
    audit = (
        F.when(F.col("state") == "conflict", "contradictory direct metadata namespace")
        .when(other_code & (F.col("state") == "incomplete"), "incomplete direct metadata contradicts structured evidence")
        .when(other_code, "direct metadata contradicts structured currency")
        .when(other_amount, "direct metadata contradicts structured amount")
    )
    met = met.withColumn("audit", F.when(bound_, audit))
    gone = F.col("audit").isNotNull()
    taken = bound_ & ~gone & (F.size("prices") == 0) & (F.col("state") == "offer")
    empty = F.array().cast(f"array<{PRICE}>")
    prices = F.when(gone, empty).when(taken, F.array(F.struct(F.col("m_currency").alias("currency"), F.col("m_amount").alias("amount")))).otherwise(F.col("prices"))
    low, high = F.array_min(F.transform(prices, lambda p: p["amount"])), F.array_max(F.transform(prices, lambda p: p["amount"]))
    none = F.lit(None)
    ld_rows = met.select("page_id", F.lit("json-ld").alias("source"), "kind", "name", "category", F.when(F.size(prices) == 1, low).alias("amount"), F.get(prices, 0)["currency"].alias("currency"), low.alias("low"), high.alias("high"), "audit")
    plans = plan_cards(pages).select("page_id", F.lit("plan"), F.lit("Service"), "name", F.concat(F.lit("saas-plan "), "tier"), "amount", "currency", "amount", "amount", none.cast("string"))
    said = ld_rows.union(plans)
    signals = page_signals(pages, offers).join(said.select("page_id").distinct(), "page_id", "left_anti")
    return said.union(signals.select("page_id", F.lit("page-signal"), F.lit("PageSignal"), "name", "category", "amount", "currency", "amount", "amount", none.cast("string")))
