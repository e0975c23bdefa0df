"""Text functions as columns: pixel widths, graphemes, normal forms, token sets, similarities."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Arial advance widths in 1/1000 em of the printable ASCII characters, from the space on.
ARIAL = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
THAI, CJK, OTHER = 540, 1000, 556
TITLE_MAX_PX = 600


def js_round(c: Column) -> Column:
    """Half up, also below zero: floor(x + 0.5)."""
    return F.floor(c + 0.5)


def glyph_width(ch: Column) -> Column:
    """Width of one character in 1/1000 em; Thai marks that stack take none."""
    cp = F.ascii(ch)  # the code point of the first character
    table = F.array(*[F.lit(w) for w in ARIAL])
    mark = (cp == 0x0E31) | cp.between(0x0E34, 0x0E3A) | cp.between(0x0E47, 0x0E4E)
    return (
        F.when(cp.between(32, 126), F.element_at(table, (cp - 31).cast("int")))
        .when(mark, 0)
        .when(cp.between(0x0E00, 0x0E7F), THAI)
        .when(cp.between(0x3000, 0x9FFF) | cp.between(0xAC00, 0xD7A3) | cp.between(0xF900, 0xFAFF), CJK)
        .otherwise(OTHER)
    )


def text_px(text: Column, font_px: int = 20) -> Column:
    """Estimated width of a text in pixels, rounded half up; 0 for null."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    units = F.aggregate(chars, F.lit(0), lambda a, c: a + glyph_width(c))
    return js_round(units * F.lit(font_px) / F.lit(1000.0)).cast("int")


def grapheme_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\X"))


def nfc(text: Column) -> Column:
    """Unicode normal form C, for which Spark has no function."""
    return F.arrow_udf(_nfc, "string")(text)


def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([None if not t.is_valid else unicodedata.normalize("NFC", t.as_py()) for t in text], pa.string())


_ZERO_WIDTH = "[​-‍﻿]"
_SPACE = "[\\s   -     　﻿]+"


def collapse(text: Column) -> Column:
    """White space, also that beyond ASCII, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def norm_dup(text: Column, composed: bool = False) -> Column:
    """The form in which titles, descriptions and headings are compared; '' for null."""
    text = F.coalesce(text, F.lit(""))
    return collapse(F.regexp_replace(F.lower(text if composed else nfc(text)), _ZERO_WIDTH, ""))


def token_set(text: Column, least: int = 3) -> Column:
    """Distinct lower-case runs of letters and digits of at least ``least`` characters."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, shared / F.size(F.array_union(a, b)))


def bigrams(text: Column) -> Column:
    """Distinct character pairs."""
    n = F.length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))))


def title_h1_similarity(title: Column, h1: Column) -> Column:
    """1 if one contains the other, else the Jaccard similarity of their bigrams to two places; null if either is empty."""
    squeeze = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s|·\-–—_:,.!?()\[\]]+", "")
    a, b = squeeze(title), squeeze(h1)
    j = F.coalesce(jaccard(bigrams(a), bigrams(b)), F.lit(0.0))
    return F.when((a == "") | (b == ""), None).when(a.contains(b) | b.contains(a), 1.0).otherwise(js_round(j * 100) / 100)


def truncate(text: Column, n: int = 80) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def lead_clause(text: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(text, "—", 1), " · ", 1))
