"""Compatibility decomposition (NFKD) without marks, as a column expression.

The tables come from the standard library's Unicode data. A character that leaves one character or none is a ``translate``;
one that leaves several is found by its code point in an array, 64 slots a page, so that its cost does not grow with the
table; syllables of Hangul follow the standard's arithmetic. Texts in ASCII skip all of it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Unicode standard: where syllables and their three parts begin, and how many there are.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
N_LEADS, N_VOWELS, N_TAILS = 19, 21, 28
PAGE = 64
SEPARATOR = "\x00"


def without_marks(text: str) -> str:
    """The same in plain Python."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[int, str]]:
    """Characters to translate, their replacements (the rest is deleted), and those that become several."""
    one, to, none, several = [], [], [], {}
    last = SYLLABLES + N_LEADS * N_VOWELS * N_TAILS
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        left = c if SYLLABLES <= code < last else without_marks(c)
        if left == "":
            none.append(c)
        elif len(left) > 1:
            several[code] = left
        elif left != c:
            one.append(c)
            to.append(left)
    return "".join(one + none), "".join(to), several


@lru_cache(maxsize=1)
def _pages() -> tuple[str, str, str]:
    """The place of each page among the written ones (nothing if it has none), their slots, and a class of the characters."""
    several = _tables()[2]
    pages = sorted({code // PAGE for code in several})
    at = {page: i for i, page in enumerate(pages)}
    slots = [several.get(page * PAGE + i, "") for page in pages for i in range(PAGE)]
    runs: list[list[int]] = []
    for code in sorted(several):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    found = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in [*runs, [SYLLABLES, SYLLABLES + N_LEADS * N_VOWELS * N_TAILS - 1]])
    return SEPARATOR.join(str(at.get(p, "")) for p in range(pages[-1] + 1)), SEPARATOR.join(slots), f"[{found}]"


def unaccented(x: Column) -> Column:
    """NFKD of ``x`` without combining marks, equal to ``without_marks``; null stays null."""
    matching, replace, _ = _tables()
    places, slots, found = _pages()

    def syllable(s: Column) -> Column:
        part = lambda first, n, i: F.substring(F.lit("".join(map(chr, range(first, first + n)))), i.cast("int") + 1, F.lit(1))
        tail = s % N_TAILS
        return F.concat(part(LEADS, N_LEADS, F.floor(s / (N_VOWELS * N_TAILS))), part(VOWELS, N_VOWELS, F.floor(s % (N_VOWELS * N_TAILS) / N_TAILS)), F.when(tail > 0, part(TAILS, N_TAILS, tail)).otherwise(""))

    def expanded(c: Column) -> Column:
        code = F.ascii(c)
        page = F.try_element_at(F.split(F.lit(places), SEPARATOR), F.floor(code / PAGE).cast("int") + 1).try_cast("int")
        slot = F.try_element_at(F.split(F.lit(slots), SEPARATOR), page * PAGE + code % PAGE + 1)
        own = code - SYLLABLES
        return F.when(code < 0x80, c).when(own.between(0, N_LEADS * N_VOWELS * N_TAILS - 1), syllable(own)).otherwise(F.coalesce(F.nullif(slot, F.lit("")), c))

    wide = F.when(x.rlike(found), F.array_join(F.transform(F.split(x, ""), expanded), "")).otherwise(x)
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(wide, matching, replace)).otherwise(x)
