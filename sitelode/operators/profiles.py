"""Page profiles: type and task scorecards, content audit, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_key
from ..functions.measures import clamp, half_up
from ..functions.text import profile_tokens

TYPES = ("article", "category", "comparison", "faq", "guide", "hub", "legal", "location", "product", "service", "tool", "transactional", "utility")
TASKS = ("buy_or_hire", "calculate", "compare", "find", "learn", "navigate", "reference", "review", "troubleshoot")
# Words of a page that speak for a type, and for types and tasks the reason that they give and its points.
WORD_RULES = (
    (("faq", "questions", "answers"), {"faq": ("faq-structure", 44)}, {"troubleshoot": ("faq-troubleshoot", 28), "learn": ("faq-learn", 14), "reference": ("faq-reference", 14)}),
    (("guide", "tutorial", "how", "checklist"), {"guide": ("guide-signals", 34)}, {"learn": ("guide-learn", 28)}),
    (("blog", "article", "news", "story", "insights"), {"article": ("article-signals", 28)}, {"learn": ("article-learn", 20)}),
    (("hub", "resources", "library", "overview"), {"hub": ("hub-structure", 34)}, {"navigate": ("hub-navigate", 28)}),
    (("category", "collection", "catalog", "shop"), {"category": ("category-signals", 24)}, {"find": ("category-find", 20)}),
    (("service", "consulting", "agency", "book", "quote", "demo"), {"service": ("service-signals", 34)}, {"buy_or_hire": ("service-buy", 26)}),
    (("sku", "buy"), {"product": ("product-signals", 38)}, {"buy_or_hire": ("product-buy", 30)}),
    (("compare", "comparison", "versus", "vs", "alternatives", "best"), {"comparison": ("comparison-signals", 42)}, {"compare": ("comparison-task", 34)}),
    (("calculator", "estimator", "generator", "checker", "tool"), {"tool": ("tool-signals", 40)}, {"calculate": ("tool-calculate", 36)}),
    (("location", "office", "directions", "hours", "near"), {"location": ("location-signals", 40)}, {"find": ("location-find", 28), "navigate": ("location-navigate", 14)}),
    (("pricing", "plan", "checkout", "start", "trial"), {"transactional": ("transactional-signals", 34)}, {"buy_or_hire": ("transactional-buy", 32)}),
    (("support", "fix", "error", "troubleshoot", "repair"), {}, {"troubleshoot": ("support-signals", 26)}),
    (("docs", "documentation", "reference", "spec", "api"), {}, {"reference": ("reference-keywords", 22)}),
)
# Reasons and points of what is no word.
LEGAL = ({"legal": ("legal-path", 42)}, {"reference": ("legal-reference", 28)})
UTILITY = ({"utility": ("utility-path", 42)}, {"navigate": ("utility-navigation", 18)})
REVIEWS = ({}, {"review": ("review-signals", 18)})
COMPARED_REVIEWS = ({}, {"review": ("comparison-reviews", 14)})
STRUCTURED = ({}, {"reference": ("structured-reference", 10)})
REPEATED = ({"hub": ("template-heavy-hub", 10), "category": ("template-heavy-category", 10)}, {})
LONG = ({"article": ("longform-article", 12), "guide": ("longform-guide", 12)}, {})
# Structured types and calls to action that speak for a type as its words do.
TYPE_MARKS = {"article": ("article", "blogposting"), "product": ("product",), "location": ("localbusiness",)}
TYPE_CALLS = {"service": ("quote", "consultation", "demo"), "transactional": ("start", "trial")}
REFERENCE_MARKS = ("faqpage", "howto", "techarticle", "article")
# Paths.
LEGAL_PATH = r"/(privacy(?:-policy)?|terms(?:-of-service)?|cookie|cookies|gdpr|legal|impressum|disclaimer)(?:/|$)"
UTILITY_PATH = r"/(login|account|search|cart|checkout|thank-you|reset-password|signup|register)(/|$)"
# Region roles that speak for a type as its words do.
TYPE_REGIONS = {"faq": "faq", "comparison": "comparison", "category": "product_grid", "tool": "tool", "hub": "table_of_contents"}


def confidence(best: Column, second: Column) -> Column:
    return half_up(clamp(clamp(best / 100.0, 0, 1) * 0.55 + clamp((best - second) / 40.0, 0, 1) * 0.45, 0.05, 0.99), 3)


def label_of(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.58, "medium").otherwise("low")


def profiles(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``pages``: url, title, h1_text, word_count, h1_count, regions (array of struct with role), and where they are known
    structured_types, calls, has_price, has_ratings, blocks and repeated_share. page_type, primary_task and of each the
    score, its share of all points, confidence, label and reasons (array of struct of key and points, most points first);
    ties go to the lesser name, and a page without signals is an article to learn from, for the reason ``fallback``."""
    none = {"structured_types": F.array().cast("array<string>"), "calls": F.array().cast("array<string>"), "has_price": F.lit(False), "has_ratings": F.lit(False)}
    pages = pages.withColumns({k: v for k, v in none.items() if k not in pages.columns})
    text = F.concat_ws(" ", "title", "h1_text", page_key(F.col("url")))
    named = F.concat_ws(" ", "title", page_key(F.col("url")))  # what compares says so in its title or address
    rows = pages.withColumns({"_tokens": profile_tokens(text), "_named": profile_tokens(named), "_roles": F.transform("regions", lambda r: r["role"]), "_path": F.lower(page_key(F.col("url")))})
    types: dict[str, list[Column]] = {t: [] for t in TYPES}
    tasks: dict[str, list[Column]] = {t: [] for t in TASKS}

    def rule(when: Column, type_points: dict[str, tuple[str, int]], task_points: dict[str, tuple[str, int]]) -> None:
        for target, points in ((types, type_points), (tasks, task_points)):
            for name, (key, n) in points.items():
                target[name].append(F.when(when, F.struct(F.lit(-n).alias("minus"), F.lit(key).alias("key"))))

    rule(F.col("_path").rlike(LEGAL_PATH), *LEGAL)
    rule(F.col("_path").rlike(UTILITY_PATH), *UTILITY)
    for words, type_points, task_points in WORD_RULES:
        name = next(iter(type_points), None)
        here = F.arrays_overlap("_named" if name == "comparison" else "_tokens", F.array(*map(F.lit, words)))
        if name in TYPE_REGIONS:
            here |= F.array_contains("_roles", TYPE_REGIONS[name])
        for column, marks in (("structured_types", TYPE_MARKS), ("calls", TYPE_CALLS)):
            if name in marks:
                here |= F.arrays_overlap(column, F.array(*map(F.lit, marks[name])))
        if name == "product":
            here |= F.col("has_price") & F.array_contains("calls", "buy")
        if name == "transactional":
            here |= F.col("_path").contains("/pricing")
        if name == "comparison":
            compared = here
        rule(here, type_points, task_points)
    rule(F.col("has_ratings"), *REVIEWS)
    rule(compared & F.col("has_ratings"), *COMPARED_REVIEWS)
    rule(F.arrays_overlap("structured_types", F.array(*map(F.lit, REFERENCE_MARKS))), *STRUCTURED)
    if {"repeated_share", "blocks"} <= set(pages.columns):
        rule((F.size("blocks") >= 6) & (F.col("repeated_share") >= 0.45), *REPEATED)
    rule((F.col("word_count") >= 1200) & (F.col("h1_count") <= 1), *LONG)

    def ranked(target: dict[str, list[Column]]) -> Column:
        """Best first: most points, then the lesser name; each with its reasons."""
        given = lambda parts: F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()))
        held = F.array(*[F.struct(F.lit(n).alias("name"), given(p).alias("reasons")) for n, p in sorted(target.items())])
        total = lambda x: F.aggregate(x["reasons"], F.lit(0), lambda s, r: s + r["minus"])
        return F.array_sort(F.transform(held, lambda x: F.struct(total(x).alias("minus"), x["name"].alias("name"), x["reasons"].alias("reasons"))))

    rows = rows.withColumns({"_types": ranked(types), "_tasks": ranked(tasks)})
    out = [F.col(id_col), F.col("url")]
    for name, column, fallback in (("page_type", "_types", "article"), ("primary_task", "_tasks", "learn")):
        best, second = -F.col(column)[0]["minus"], -F.col(column)[1]["minus"]
        found, score = best > 0, F.greatest(best, F.lit(1))
        points = F.greatest(F.aggregate(column, F.lit(0), lambda s, x: s - x["minus"]), F.lit(1))
        sure = confidence(score, second)
        reasons = F.transform(F.col(column)[0]["reasons"], lambda r: F.struct(r["key"].alias("key"), (-r["minus"]).alias("points")))
        none_found = F.array(F.struct(F.lit("fallback").alias("key"), F.lit(1).alias("points")))
        out += [F.when(found, F.col(column)[0]["name"]).otherwise(fallback).alias(name), score.alias(f"{name}_score"), half_up(score / points, 3).alias(f"{name}_share")]
        out += [sure.alias(f"{name}_confidence"), label_of(sure).alias(f"{name}_label"), F.when(found, reasons).otherwise(none_found).alias(f"{name}_reasons")]
    return rows.select(*out)


# Penalties of the content audit.
PENALTIES = {"error_status": 22, "noindex": 22, "no_title": 14, "no_description": 12, "no_h1": 14, "many_h1": 8, "thin": 14, "few_links": 8, "long_title": 8, "long_description": 8, "canonical_elsewhere": 12}


def audit(pages: DataFrame) -> DataFrame:
    """page_key, issues and a score of 100 less the penalties of its issues."""
    none = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    found = {
        "error_status": F.coalesce(F.col("status_code") >= 400, F.lit(True)),
        "noindex": F.col("noindex"),
        "no_title": none("title"),
        "no_description": none("meta_description"),
        "no_h1": F.col("h1_count") == 0,
        "many_h1": F.col("h1_count") > 1,
        "thin": F.col("word_count") < 300,
        "few_links": F.coalesce("inbound", F.lit(0)) <= 2,
        "long_title": F.length("title") > 60,
        "long_description": F.length("meta_description") > 160,
        "canonical_elsewhere": F.col("raw_key") != F.col("resolved_key"),
    }
    held = {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}
    penalty = reduce(lambda a, b: a + b, [F.when(v, PENALTIES[k]).otherwise(0) for k, v in held.items()])
    issues = F.filter(F.array(*[F.when(v, k) for k, v in held.items()]), lambda x: x.isNotNull())
    return pages.select("url", F.col("raw_key").alias("page_key"), F.array_join(issues, ",").alias("issues"), F.greatest(F.lit(0), 100 - penalty).alias("score"))


def with_search(pages: DataFrame, search: DataFrame) -> DataFrame:
    """Crawled pages (raw_key) with their clicks and impressions; 0 where search has none."""
    sums = search.filter("page_key <> ''").groupBy("page_key").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return pages.join(sums, F.col("raw_key") == F.col("page_key"), "left").drop("page_key").fillna(0, ["clicks", "impressions"])


def readiness(pages: Column, with_blocks: Column, profiled: Column, templated: Column, running: Column, failed: Column) -> Column:
    """State of the content evidence of a site."""
    share = lambda n: F.when(pages > 0, n / pages).otherwise(0.0)
    ready = (share(with_blocks) >= 0.9) & (share(profiled) >= 0.9) & (share(templated) >= 0.75)
    return F.when(pages == 0, "no_crawl").when(running, "pending").when(failed, "failed").when(ready, "ready").otherwise("partial")
