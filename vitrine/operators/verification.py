"""How sure it is that a candidate is a competitor, and whether a drafted action is grounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import ACTION_WORDS, LEVERS, PRICE_DIRECTION_AR_PATTERN, PRICE_DIRECTION_PATTERN, UNGROUNDED_WORDS
from ..functions.numbers import bound, half_up


def verification(x: Column) -> Column:
    """score, accepted, confidence and basis of a candidate, from a struct of what was compared.

    x has core_overlap (terms that title, description and headings share), discovery_overlap,
    accessory (its own words name accessories), pair_score (the strongest product pair, null
    without one), locale_bridge (an alias of that pair is in another language), exact_confidence
    (of a verified exact pair, null without one), mentions, evidence, direct, primary_region,
    region (codes, '' if unknown), require_overlap.
    """
    exact = F.coalesce(x["exact_confidence"] >= 0.8, F.lit(False))
    pair = F.coalesce(x["exact_confidence"], x["pair_score"])
    bridge = pair.isNotNull() & x["locale_bridge"] & (x["discovery_overlap"] >= 2)
    core = x["core_overlap"] >= 2
    aligned = ~(x["accessory"] & ~core) & (core | bridge | exact)
    basis = F.when(core, "observed-core").when(bridge, "observed-locale-pair").when(exact, "verified-exact-product-pair").otherwise("none")
    known = (x["primary_region"] != "") & (x["region"] != "")
    same = ~known | (x["primary_region"] == x["region"]) | (x["primary_region"] == "GLOBAL") | (x["region"] == "GLOBAL")
    category = F.when(aligned, F.least(F.lit(45), 30 + x["core_overlap"] * 4)).otherwise(0)
    product = F.when(pair.isNotNull(), F.least(F.lit(25), 14 + half_up(pair * 20))).otherwise(F.least(F.lit(10), x["discovery_overlap"] * 3))
    evidence = F.least(F.lit(12), F.greatest(x["mentions"], x["evidence"]) * 4)
    relation = F.when(x["direct"], 8).otherwise(3)
    region = F.when(known, F.when(same, 10).otherwise(0)).otherwise(5)
    score = F.least(F.lit(100), category + product + evidence + relation + region).cast("int")
    accepted = aligned & same & (score >= 50) & (~x["require_overlap"] | pair.isNotNull())
    confidence = F.when((score >= 78) & pair.isNotNull(), "High").when(score >= 55, "Medium").otherwise("Low")
    return F.struct(score.alias("score"), accepted.alias("accepted"), confidence.alias("confidence"), basis.alias("basis"))


def _numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"), F.lit(r"(\d+(?:[.,]\d+)*)"), 1)


def _domains(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"), 1), lambda d: F.regexp_replace(d, r"^www\.", ""))


def _words(c: Column) -> Column:
    """Words of three characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.length(w) >= 3)


def draft_rejection(x: Column) -> Column:
    """The first reason to refuse a drafted action; null if it may be published.

    x has pair_key, own_key (of the pair it was asked for), action_en, action_ar, rationale_en,
    rationale_ar, lever, evidence (keys), facts (array of key, text), comparable_price. A null
    pair_key stands for a draft that is no object.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    keys = F.slice(F.array_distinct(F.filter(F.coalesce(x["evidence"], F.array().cast("array<string>")), lambda k: F.trim(k) != "")), 1, 8)
    facts = F.coalesce(x["facts"], F.array().cast("array<struct<key:string,text:string>>"))
    fields = F.struct(
        x["pair_key"].alias("pair_key"), x["own_key"].alias("own_key"), x["lever"].alias("lever"), F.coalesce(x["comparable_price"], F.lit(False)).alias("comparable"),
        *(squeezed(x[c]).alias(c) for c in ("action_en", "action_ar", "rationale_en", "rationale_ar")),
        keys.alias("keys"), facts.alias("facts"), F.array_join(F.transform(facts, lambda f: f["text"]), " ").alias("known"),
    )
    return bound(fields, _rejection)


def _rejection(d: Column) -> Column:
    texts = [d[c] for c in ("action_en", "action_ar", "rationale_en", "rationale_ar")]
    english, arabic = F.concat_ws(" ", texts[0], texts[2]), F.concat_ws(" ", texts[1], texts[3])
    all_of_it = F.concat_ws(" ", *texts)
    length = [F.length(c) for c in texts]
    misfit = F.array_min(F.array(*length)) == 0
    for n, most in zip(length, (160, 160, 200, 200)):
        misfit |= n > most
    script = lambda c: c.rlike("[\u0600-\u06ff]")
    own = F.transform(d["facts"], lambda f: f["key"])
    told = F.array_join(F.transform(F.filter(d["facts"], lambda f: F.array_contains(d["keys"], f["key"])), lambda f: f["text"]), " ")
    names = F.transform(F.regexp_extract_all(F.concat_ws(" ", texts[0], texts[2], texts[1], texts[3]), F.lit(r"\b([A-Z][A-Za-z0-9'’_-]{2,})\b"), 1), lambda w: F.lower(w))
    common = F.array(*map(F.lit, ACTION_WORDS))
    empty = F.array(*map(F.lit, UNGROUNDED_WORDS))
    new = lambda said, known: F.size(F.array_except(said, known)) > 0

    def grounded(c: Column) -> Column:
        specific = F.arrays_overlap(F.array_except(_words(c), empty), F.array_except(_words(told), empty))
        return specific | F.arrays_overlap(_numbers(c), _numbers(told)) | F.arrays_overlap(_domains(c), _domains(told))

    direction = english.rlike(PRICE_DIRECTION_PATTERN) | arabic.rlike(PRICE_DIRECTION_AR_PATTERN)
    return (
        F.when(d["pair_key"].isNull(), "invalid-object")
        .when(d["pair_key"] != d["own_key"], "pair-key-mismatch")
        .when(misfit, "text-fields")
        .when(~(script(texts[1]) & script(texts[3])), "arabic-missing")
        .when(~F.coalesce(d["lever"].isin(LEVERS), F.lit(False)), "lever")
        .when((F.size(d["keys"]) < 2) | new(d["keys"], own), "evidence-keys")
        .when(~F.exists(d["keys"], lambda k: ~k.rlike(r"^(?:primary|rival)\.(?:name|domain|source)$")), "evidence-specificity")
        .when(new(_numbers(all_of_it), _numbers(d["known"])), "unsupported-number")
        .when(new(_domains(all_of_it), _domains(d["known"])), "unsupported-domain")
        .when(new(F.array_except(names, common), _words(d["known"])), "proper-noun")
        .when(~d["comparable"] & direction, "price-direction")
        .when(~grounded(english), "grounding-overlap-en")
        .when(~grounded(arabic), "grounding-overlap-ar")
    )


def failure_stage(code: Column, phase: Column) -> Column:
    """Where a failed run failed, by its error code and last phase."""
    c = F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit("report-run-failed"))
    return (
        F.when(F.contains(c, F.lit("dispatch")), "dispatch")
        .when(F.contains(c, F.lit("crawl")) | F.startswith(c, F.lit("edge-")) | (c == "primary-page-unavailable") | F.coalesce(phase == "crawl", F.lit(False)), "crawl")
        .when(F.contains(c, F.lit("worker")), "worker")
        .when(phase == "persistence", "persistence")
        .otherwise("orchestration")
    )


def coverage_reason(status: Column, events: Column) -> Column:
    """Which limitation a limited report tells of first; 'ready' if it is not limited.

    events is an array of structs: key, phase, status, message, limited (its own flag), upstream.
    """
    limited = F.filter(
        F.coalesce(events, F.array().cast("array<struct<key:string,phase:string,status:string,message:string,limited:boolean,upstream:string>>")),
        lambda e: F.coalesce((e["status"] == "limited"), F.lit(False)) | F.coalesce(F.endswith(e["key"], F.lit("-limited")), F.lit(False)) | F.coalesce(e["limited"], F.lit(False))
        | F.coalesce(F.lower(e["message"]).contains("coverage limitation"), F.lit(False)),
    )
    has = lambda test: F.exists(limited, lambda e: F.coalesce(test(e), F.lit(False)))
    return (
        F.when(status != "limited", "ready")
        .when(has(lambda e: (e["key"] == "crawl-limited") | (e["upstream"] == "crawl")), "site-unavailable")
        .when(has(lambda e: e["key"] == "facts-limited"), "facts-incomplete")
        .when(has(lambda e: (e["key"] == "matching-complete") & e["limited"]), "matching-stopped")
        .when(has(lambda e: e["key"] == "matching-limited"), "matching-unavailable")
        .when(has(lambda e: e["phase"] == "enrichment"), "details-missing")
        .when(has(lambda e: e["phase"].isin("competitors", "brief")), "discovery-partial")
        .when(has(lambda e: e["phase"] == "ads"), "ads-partial")
        .otherwise("unknown")
    )
