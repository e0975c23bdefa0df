"""Competitors from search results: admission, scores, merging with picks; costs of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U

SUGGESTED_BONUS = 12
KEEP_SCORE = 25
# Parts of hosts that are never a competitor: portals, social networks, marketplaces, news, directories, dictionaries.
BLOCKED = (
    "google.", "facebook.", "youtube.", "linkedin.", "instagram.", "twitter.", "x.com", "wikipedia.", "wiktionary.", "pantip.", "shopee.", "lazada.", "tiktok.", "line.me", "apple.com", "medium.com", "blogspot.", "wordpress.", "wix.com", "pinterest.", "reddit.",
    "duckduckgo.", "bing.com", "yahoo.", "amazon.", "play.google", "github.", "canva.", "glassdoor", "jobsdb", "jobthai", "indeed.", "tripadvisor", "booking.com", "agoda.", "sanook.", "kapook.", "thairath.", "matichon.", "bangkokpost.", "posttoday.", "prachachat.",
    "mgronline.", "dailynews.", "khaosod.", "springnews.", "thansettakij.", "moneybuffalo.", "finnomena.", "longtunman.", "youtu.be", "archive.org", "slideshare", "scribd.", "refrens.", "contactout.", "zoominfo.", "crunchbase.", "dnb.com", "rocketreach.", "kompass.",
    "yellowpages", "dataforthai.", "creden.co", "opencorporates.", "similarweb.", "owler.", "signalhire.", "apollo.io", "lusha.", "leadiq.", "b2bhint.", "globaldata.", "bloomberg.", "reuters.", "set.or.th", "sec.or.th", "trustpilot.", "clutch.co", "g2.com", "beamstart.",
    "techinasia.", "dealstreetasia.", "startupblink.", "f6s.com", "pitchbook.", "longdo.", "wiktionary.", "hujiang.", "enghero.", "thaijob.", "jobbkk.", "workventure.", "dict.",
)


def relevant(query: Column, title: Column, url: Column) -> Column:
    """Whether any word of the query of more than two characters comes in the title or URL."""
    hay = F.lower(F.concat_ws(" ", title, url))
    return F.exists(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 2) & hay.contains(w))


def admitted(own: Column, domain: Column, host: Column, blocked=BLOCKED) -> Column:
    """Not the own domain, not blocked, not of the same brand (one name's core inside the other's)."""
    core, mine = F.substring_index(domain, ".", 1), F.substring_index(F.regexp_replace(own, r"^www\.", ""), ".", 1)
    out = (domain != U.registrable_domain(own)) & ~((F.length(core) >= 5) & (mine.contains(core) | core.contains(mine)))
    for b in blocked:
        out = out & ~host.contains(b) & ~domain.contains(b)
    return out


def serp_scores(results: DataFrame, suggestions: DataFrame | None = None, blocked=BLOCKED) -> DataFrame:
    """(own, domain, score, titles, suggested) of results(own, query, idx, url, title), idx from 0; the first twenty count."""
    host = U.host(F.col("url"))
    rows = results.where("idx < 20").withColumns({"host": host, "domain": U.registrable_domain(host)}).where(F.col("host") != "")
    rows = rows.where(admitted(F.col("own"), F.col("domain"), F.col("host"), blocked)).select("own", "domain", F.greatest(F.lit(1), 20 - F.col("idx")).alias("points"), F.substring("title", 1, 90).alias("title"), F.lit(False).alias("suggested"))
    if suggestions is not None:
        d = F.regexp_replace(F.lower("domain"), r"^https?://|^www\.", "")
        more = suggestions.select("own", F.substring_index(F.regexp_replace(d, r"^www\.", ""), "/", 1).alias("domain"), F.lit(SUGGESTED_BONUS).alias("points"), F.substring("reason", 1, 90).alias("title"), F.lit(True).alias("suggested"))
        rows = rows.union(more.where(F.col("domain").contains(".") & admitted(F.col("own"), F.col("domain"), F.col("domain"), blocked)))
    return rows.groupBy("own", "domain").agg(F.sum("points").alias("score"), F.sort_array(F.collect_set("title")).alias("titles"), F.bool_or("suggested").alias("suggested"))


def top_competitors(scores: DataFrame, k: int = 10) -> DataFrame:
    w = W.partitionBy("own").orderBy(F.desc("score"), "domain")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_picks(live: DataFrame, picked: DataFrame, k: int = 6) -> DataFrame:
    """Picks that are live in their order, then live ones with a score of 25 or more that were not picked; k of them."""
    first = picked.join(live.select("own", "domain", "score"), ["own", "domain"]).select("own", "domain", "score", F.lit(0).alias("part"), F.col("ord").alias("at"))
    rest = live.where(F.col("score") >= KEEP_SCORE).join(picked, ["own", "domain"], "left_anti").select("own", "domain", "score", F.lit(1).alias("part"), (-F.col("score")).alias("at"))
    w = W.partitionBy("own").orderBy("part", "at", "domain")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("part", "at")


def cached_or_fresh(fresh: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Fresh rows, and cached ones for the keys that have none."""
    return fresh.unionByName(cached.join(fresh.select(key).distinct(), key, "left_anti"))


def usd(calls: DataFrame, prices: DataFrame, default_in: float, default_out: float) -> DataFrame:
    """calls(model, tokens_in, tokens_out) with usd by prices(model, price_in, price_out) a million tokens."""
    p = calls.join(F.broadcast(prices), "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(default_in)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(default_out))) / 1_000_000
    return p.withColumn("usd", cost).drop("price_in", "price_out")
