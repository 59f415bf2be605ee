"""Text functions: hashes, tokens, sentences, phrases, compatibility forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode_forms import unaccented

# Common words that no tokeniser keeps.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "you", "your", "our", "how", "what", "why", "when", "who", "can", "best", "near", "into", "about")


def clean(x: Column, most: int | None = None) -> Column:
    """White space collapsed and trimmed; beyond ``most`` characters cut, with an ellipsis for the last."""
    tidy = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    return tidy if most is None else F.when(F.length(tidy) > most, F.concat(F.rtrim(F.substring(tidy, 1, most - 1)), F.lit("…"))).otherwise(tidy)


def block_hash(x: Column) -> Column:
    return F.sha1(F.encode(F.lower(x), "UTF-8"))


def cache_hash(x: Column) -> Column:
    return F.sha2(F.encode(F.lower(clean(x)), "UTF-8"), 256)


def words(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def approximate_tokens(x: Column) -> Column:
    return F.ceil(F.size(words(F.coalesce(x, F.lit("")))) * 1.35).cast("long")


def sentences(x: Column, most_text: int | None = None, most_sentence: int | None = None) -> Column:
    """Split behind . ! ? before a capital, digit or quote; of 55 characters and 8 words at least. By default of the whole
    text and whole; the bounds clip the text and each sentence."""
    parts = F.transform(F.split(clean(x, most_text), r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"), lambda s: clean(s, most_sentence))
    return F.filter(parts, lambda s: (F.length(s) >= 55) & (F.size(F.split(s, r"\s+")) >= 8))


def topic_tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits without accents, light stems, three characters or more."""
    found = F.regexp_extract_all(F.lower(unaccented(x)), F.lit(r"([\p{L}\p{N}]+)"), 1)

    def stem(t: Column) -> Column:
        n = F.length(t)
        return F.when((n > 5) & t.endswith("ing"), F.substring(t, F.lit(1), n - 3)).when((n > 4) & t.endswith("es"), F.substring(t, F.lit(1), n - 2)).when((n > 3) & t.endswith("s"), F.substring(t, F.lit(1), n - 1)).otherwise(t)

    return F.filter(F.transform(found, stem), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def topic_key(x: Column) -> Column:
    """The first four distinct tokens in order; without any, the text itself."""
    key = F.array_join(F.slice(F.array_sort(F.array_distinct(topic_tokens(x))), 1, 4), "|")
    return F.when(key != "", key).otherwise(F.trim(F.lower(x)))


def profile_tokens(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(clean(x)), r"[^\p{L}\p{N}\s/-]", " "), r"[\s/:-]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def link_tokens(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(clean(x)), r"[^\p{L}\p{N}\s-]", " "), r"[\s-]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def phrase_at(x: Column, phrase: str) -> Column:
    """Position of a phrase between word boundaries, whatever its case; 0 if absent."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)
    return F.regexp_instr(x, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])"))
