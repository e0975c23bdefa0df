"""URL filters: rules by host and path, and a blocked Bloom filter before an exact hash join.

The filter is a table: one row for each block of 512 bits, held as eight longs that ``bit_or``
fills with partial aggregation.  A listed URL hashes to one block and to eight bits, one in each
long.  A probed URL looks up its block; only possible hits go on to the exact join, which removes
false positives.  All of it is DataFrame functions.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and
is allowed unless the empty canonical URL is listed (it never is).  Repeated rows and repeated
page ids each keep a row.  An empty list allows everything that no rule blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, scratch

#: (verdict, host, path) of the production rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BITS_PER_URL = 16
#: Bytes of a row of the filter: its block and eight longs.
_FILTER_ROW = 72
#: Query parameters that a canonical URL goes without.
TRACKING = ("ref", "fbclid", "gclid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _AFTER, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without its last slash, and the sorted parameters that do not track; '' for none."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    query = F.substring(F.coalesce(F.regexp_extract(url, _AFTER, 3), F.lit("")), 2, 1 << 30)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.when(url_host(url) == "", F.lit("")).otherwise(
        F.concat(host, F.regexp_replace(url_path(url), "/$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    )


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, nulls where none does; of equal lengths the first in order of text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _words(block: Column, hashed: Column) -> list[Column]:
    """For each of a block's eight longs, the one bit that this hash sets in it: six bits of the hash pick it."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {6 * i}) & 63L as int))") for i in range(8)]


def build_filter(keys: DataFrame, column: str, n: int, bits_per_key: int = BITS_PER_URL) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the n distinct keys, and the number of blocks.  Blocks without a key have no row."""
    blocks = max(1, math.ceil(n * bits_per_key / 512))
    hashed = keys.select(F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block"), F.xxhash64(F.lit("bits"), F.col(column)).alias("_h"))
    bits = _words(F.col("block"), "_h")
    return hashed.groupBy("block").agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(bits)]), blocks


def listed_flag(rows: DataFrame, key: str, listed: DataFrame, flag: str = "listed") -> DataFrame:
    """rows with two booleans: whether ``key`` is in ``listed`` (one column of the same name, any repeats), and ``bloom_hit``.

    Columns of rows with these two names are replaced.  A block of the filter, or a URL, that a third
    of all rows share is dealt over many tasks.
    """
    keys = scratch(listed.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("key")).distinct(), "listed")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    bloom, blocks = build_filter(keys, "key", n)
    hits = F.lit(True)
    for i, b in enumerate(_words(F.col("block"), "h")):
        hits = hits & ((F.col(f"w{i}").bitwiseAND(b)) == b)
    kept = rows.drop(flag, "bloom_hit")
    probe = kept.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(*kept.columns).alias("salt"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.xxhash64(F.lit("bits"), F.col(key)).alias("h"))
    possible = join_spread(probe, bloom, ["block"], F.col("salt"), min(blocks, n), "left", _FILTER_ROW).select("row", "salt", "key", F.coalesce(hits & (F.col("key") != ""), F.lit(False)).alias("hit"))
    # What the filter rules out looks for a key that nothing has, each row another.
    asked = possible.withColumn("key", F.when(F.col("hit"), F.col("key")).otherwise(F.concat(F.lit("\0"), F.col("salt").cast("string"))))
    exact = join_spread(asked, keys.withColumn("found", F.lit(True)), ["key"], F.col("salt"), n, "left", 50 + 4 * (total // max(1, n)))
    return exact.select("row.*", F.col("hit").alias("bloom_hit"), F.coalesce("found", F.lit(False)).alias(flag))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, bloom_hit, listed for every row of pages(page_id, url).

    ``listed`` has a column ``canonical``.  A rule decides where one fits; else listed URLs are blocked.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical_url(F.col("url")).alias("canonical"))
    judged = listed_flag(rows, "canonical", listed)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise("allow")).alias("verdict"), "canonical", "bloom_hit", "listed"
    )


def junk_title_list(pages: DataFrame) -> DataFrame:
    """The production list: canonical URLs of pages whose title carries runs of decoration marks."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.where(title.rlike(r"%%%|\*\*\*|###|\$\$\$")).select(canonical_url(F.col("url")).alias("canonical"))
