"""Rules that label rows: ordered tables of (condition, label), the first match winning."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of a lower-cased user agent, in order.
BOTS = (
    (("googlebot",), "Googlebot"),
    (("bingbot",), "Bingbot"),
    (("applebot",), "Applebot"),
    (("ahrefsbot",), "AhrefsBot"),
    (("semrushbot",), "SemrushBot"),
    (("yandexbot",), "YandexBot"),
    (("baiduspider",), "Baiduspider"),
    (("facebookexternalhit",), "FacebookBot"),
    (("linkedinbot",), "LinkedInBot"),
    (("twitterbot",), "TwitterBot"),
    (("chatgpt-user", "gptbot", "openai"), "ChatGPT / OpenAI"),
    (("anthropic-ai", "claudebot"), "Claude / Anthropic"),
    (("perplexitybot",), "Perplexity"),
    (("cohere-ai",), "Cohere"),
    (("omgili", "ccbot"), "Generic LLM / Scraper"),
    (("bot", "crawler", "spider"), "Generic Bot"),
)
# Patterns of a lower-cased referral source, in order.
ASSISTANTS = (
    ("chatgpt|openai", "ChatGPT"),
    ("claude|anthropic", "Claude"),
    ("perplexity", "Perplexity"),
    (r"copilot|bing\.com/chat", "Copilot"),
    (r"gemini|bard|ai\.google|google.*ai|ai.*google", "Gemini"),
    (r"you\.com", "You.com"),
    ("phind", "Phind"),
    ("mistral", "Mistral"),
    ("meta.*ai|ai.*meta", "Meta AI"),
    ("grok", "Grok"),
)
# Words of a lower-cased query that tell its intent, in order.
INTENTS = (
    ("Navigational", "login|signin|sign up|contact|support|dashboard|portal"),
    ("Commercial", "buy|price|cheap|software|tool|review|vs|compare|best|top|discount|coupon|order|purchase|hire|services|cost|pricing|deal|app|platform"),
    ("Informational", "how|what|guide|tutorial|why|when|where|who|tips|ideas|examples|learn|meaning|definition|can|is|does|ways|benefits|history|news|free"),
)
QUESTION_WORDS = ("who", "what", "where", "when", "why", "how", "is", "are", "do", "does", "can", "could", "should", "would")


def first_match(rules: Iterable[tuple[Column, object]], default: object) -> Column:
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, label)
    return chain.otherwise(default)


def bot_type(agent: Column) -> Column:
    ua = F.lower(agent)
    named = [(reduce(lambda a, b: a | b, [ua.contains(x) for x in marks]), label) for marks, label in BOTS]
    return first_match([(F.coalesce(agent, F.lit("")) == "", "Unknown"), *named], "Human")


def assistant_source(source: Column) -> Column:
    low = F.lower(source)
    return first_match([(low.rlike(p), label) for p, label in ASSISTANTS], F.coalesce(F.nullif(source, F.lit("")), F.lit("Other")))


def query_intent(query: Column, site: str) -> Column:
    low = F.lower(query)
    brand = site.replace("sc-domain:", "").replace("https://", "").replace("http://", "").replace("www.", "").split(".")[0].lower()
    rules = [(low.rlike(words), label) for label, words in INTENTS]
    if brand:
        rules.append((low.contains(brand) | low.contains(brand.replace("-", " ")), "Navigational"))
    return first_match(rules, "Informational")


def is_question(query: Column) -> Column:
    low = F.lower(query)
    return F.split(F.trim(low), r"\s+")[0].isin(*QUESTION_WORDS) | low.contains("?")


def error_class(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return first_match([(low.rlike("401|403|auth|token|permission"), "AUTH"), (low.rlike("429|quota|rate limit"), "QUOTA"), (low.rlike("sqlite|postgres|database|deadlock"), "DB"), (low.rlike("50[0-9]|timeout|fetch|network"), "PROVIDER")], "UNKNOWN")


def blend_insight(r: dict[str, Column] | None = None) -> Column:
    """struct<label, severity> of a blended page; the first of eleven rules that holds. Thresholds are fixed values."""
    c = F.col
    search, traffic, crawled = c("has_search"), c("has_traffic"), c("has_crawl")
    demand = (c("impressions") >= 100) | (c("clicks") > 0) | (c("sessions") >= 20)
    wanted = (c("impressions") >= 100) | (c("clicks") > 0)
    pair = lambda label, severity: F.struct(F.lit(label).alias("label"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    graded = lambda cond: F.when(cond, "high").otherwise("medium")
    return first_match(
        [
            (~crawled & (search | traffic), pair("Find in crawl", graded(demand))),
            (crawled & c("crawl_error"), pair("Fix crawl error", graded(demand))),
            (crawled & c("noindex") & (search | traffic), pair("Resolve noindex conflict", graded(wanted))),
            (crawled & (c("canonical_variants") > 0), pair("Resolve canonical mismatch", graded(demand))),
            (crawled & c("metadata_gap") & ((c("impressions") >= 100) | (c("sessions") >= 20)), pair("Fix page metadata", "medium")),
            ((c("impressions") >= 500) & (c("ctr") < 0.02), pair("Improve CTR", "medium")),
            (crawled & (c("impressions") >= 250) & (c("inbound") <= 2), pair("Add internal links", "medium")),
            ((c("clicks") >= 20) & (c("sessions") >= 20) & (c("bounce_rate") >= 0.7), pair("Improve engagement", "medium")),
            ((c("sessions") >= 25) & (c("impressions") < 250), pair("Build search visibility", "low")),
            (search & ~traffic, pair("Check analytics match", "low")),
            ((traffic | crawled) & ~search, pair("Review search coverage", "low")),
        ],
        pair("No priority issue", "none"),
    )


def topic_status(position: Column) -> Column:
    return first_match([(position <= 3, "leading"), (position <= 10, "established"), (position <= 20, "emerging")], "gap")


def index_status(state: Column, days: Column) -> Column:
    low = F.lower(F.coalesce(state, F.lit("")))
    return first_match([(low.contains("indexed") & ~low.contains("not indexed") & (F.coalesce(days, F.lit(0)) > 30), "at-risk"), (low.contains("indexed") & ~low.contains("not indexed"), "indexed")], "not-indexed")


def opportunity_type(inbound: Column, position: Column, sessions: Column, impressions: Column) -> Column:
    return first_match([(inbound <= 1, "orphan-risk"), (position.between(4, 20), "striking-distance"), ((sessions > 0) & (impressions < 250), "visibility-gap")], "link-gap")


def confidence_label(score: Column, high: float = 84, medium: float = 66) -> Column:
    return first_match([(score >= high, "high"), (score >= medium, "medium")], "low")


# Words of a page's lower-cased title, heading and text that tell its type, in order.
QUICK_TYPES = (
    (r"\bfaq\b|frequently asked|common questions", "faq"),
    (r"\bcompare\b|\bcomparison\b|\bversus\b|\bvs\b", "comparison"),
    (r"\bcalculator\b|\bestimator\b|\btool\b|\bconfigurator\b", "tool"),
    (r"\bproducts\b|\bcollection\b|\bcatalog\b|shop all", "category"),
    (r"\bpricing\b|\bbook demo\b|\bget started\b|\brequest quote\b", "landing"),
)


def quick_page_type(title: Column, heading: Column, body: Column, has_article: Column, subheadings: Column) -> Column:
    """A page's type from its words, then from its structure."""
    low = F.lower(F.concat_ws(" ", title, heading, body))
    return first_match([*((low.rlike(p), label) for p, label in QUICK_TYPES), (has_article | (subheadings >= 2), "article"), (low.rlike(r"\bproduct\b"), "product")], "unknown")


def crawl_issue() -> Column:
    """Nine reasons that put a crawled page on the list of issues."""
    none = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    elsewhere = (F.coalesce("canonical_url", F.lit("")) != "") & (F.col("canonical_url") != F.col("normalized_url"))
    return F.col("status_code").isNull() | (F.col("status_code") >= 400) | F.coalesce("noindex", F.lit(False)) | none("title") | none("meta_description") | elsewhere | (F.coalesce("inbound", F.lit(0)) == 0)
