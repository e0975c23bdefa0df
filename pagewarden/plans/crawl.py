"""Views of the driver's tables as crawl snapshots and audits, and the same views as SQL.

pages become a crawl of many sites: the host is the site, titles, headings, links and languages come
from the HTML by pattern; states, final URLs and part of the link targets are derived from page_id
by arithmetic, as the pages link to nothing that was crawled.  events become audits: user_id is the
site and ts the time, findings are derived from event_id by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..storage import materialize

TITLE = "(?s)<title>(.*?)</title>"
H1 = "(?s)<h1>(.*?)</h1>"
LINK = '<a href="([^"]*)">([^<]*)</a>'

#: (id, category, severity) of the findings that the audit view makes up.
FINDINGS = (
    ("title-missing", "onpage", "high"), ("desc-missing", "onpage", "med"), ("canonical-missing", "index", "high"), ("img-alt", "images", "med"), ("https", "security", "high"), ("sitemap-exists", "index", "med"),
    ("og-tags", "schema", "med"), ("orphan-pages", "links", "med"), ("geo-eeat", "geo", "med"), ("spa-shell", "rendering", "high"), ("html-size", "performance", "med"), ("charset-not-utf8", "technical", "low"),
)
STATES = ("pass", "pass", "warn", "fail", "info")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, page_id, page_ord (from 1, by page_id): nothing else of a site meets in one task."""
    p = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("site_id"), "page_id")
    return p.withColumn("page_ord", F.row_number().over(W.partitionBy("site_id").orderBy("page_id")))


def crawl(spark: SparkSession, sf_dir: str, ordered: bool = True, html: bool = False) -> DataFrame:
    """site_id, page_id, url, final_url, title, h1_text, lang, status; page_ord and html if they are asked for."""
    p = table(spark, sf_dir, "pages")
    site = U.host(F.col("url"))
    decoded = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    rows = p.select(
        site.alias("site_id"), "page_id", "url",
        F.when(F.col("page_id") % 7 == 3, U.strip_locale(F.col("url"))).otherwise(F.col("url")).alias("final_url"),
        decoded(F.regexp_extract("html", TITLE, 1)).alias("title"), decoded(F.regexp_extract("html", H1, 1)).alias("h1_text"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"),
        F.when(F.col("page_id") % 23 == 5, 404).when(F.col("page_id") % 29 == 7, 503).otherwise(200).alias("status"), *["html"] * html,
    )
    return rows.join(numbered(spark, sf_dir), ["site_id", "page_id"]) if ordered else rows


CRAWL_SQL = f"""
crawl0 AS (
  SELECT lower(regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2), ':[0-9]*$', '')) AS site_id, page_id, url,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) = '' THEN '/' ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) END AS path,
         regexp_extract(url, '^[^#]*?([?][^#]*)', 1) AS search,
         replace(regexp_extract(html, '{TITLE}', 1), '&amp;', '&') AS title, replace(regexp_extract(html, '{H1}', 1), '&amp;', '&') AS h1_text,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         CASE WHEN page_id % 23 = 5 THEN 404 WHEN page_id % 29 = 7 THEN 503 ELSE 200 END AS status, html
  FROM pages
), crawl1 AS (
  SELECT *, scheme || '://' || site_id || CASE WHEN regexp_replace(path, '(?i)^/[a-z][a-z](-[a-z][a-z])?(/|$)', '/') = '' THEN '/' ELSE regexp_replace(path, '(?i)^/[a-z][a-z](-[a-z][a-z])?(/|$)', '/') END AS bare FROM crawl0
), crawl AS (
  SELECT *, CASE WHEN page_id % 7 = 3 THEN bare ELSE url END AS final_url, row_number() OVER (PARTITION BY site_id ORDER BY page_id) AS page_ord FROM crawl1
)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, page_id, url, k (from 0), href, text, rel, internal, target of each link of the crawl view, written once.

    Every third link points at another page of its site, every seventh leaves the site, the others
    keep the address in the HTML.
    """
    href, text = F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), F.regexp_extract_all("html", F.lit(LINK), F.lit(2))
    found = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("site_id"), "page_id", "url", F.posexplode(F.arrays_zip(href.alias("h"), text.alias("t"))).alias("k", "x"))
    order = materialize(numbered(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id"), "page-order")
    sizes = order.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    each = found.join(order.select("page_id", "page_ord"), "page_id").join(sizes, "site_id").withColumn("to", (F.col("page_ord") + F.col("k")) % F.col("n") + 1)
    rows = each.join(order.select("site_id", F.col("page_ord").alias("to"), F.col("url").alias("to_url")), ["site_id", "to"])
    mix = (F.col("page_id") + F.col("k")) % 21
    target = F.when(mix % 3 == 0, F.col("to_url")).when(mix % 7 == 1, F.lit("https://elsewhere.example/")).otherwise(F.concat(U.origin(F.col("url")), F.col("x.h")))
    out = rows.select("site_id", "page_id", "url", "k", F.col("x.h").alias("href"), F.col("x.t").alias("text"), F.when(mix % 5 == 2, "nofollow").otherwise("").alias("rel"), ((mix % 3 == 0) | (mix % 7 != 1)).alias("internal"), target.alias("target"))
    return materialize(out, "links")


LINKS_SQL = f"""
link0 AS (
  SELECT site_id, page_id, page_ord, url, scheme, regexp_extract_all(html, '{LINK}', 1) AS hs, regexp_extract_all(html, '{LINK}', 2) AS ts FROM crawl
), link1 AS (
  SELECT site_id, page_id, page_ord, url, scheme, unnest(range(len(hs))) AS k, unnest(hs) AS href, unnest(ts) AS text FROM link0
), links AS (
  SELECT l.site_id, l.page_id, l.url, l.k, l.href, l.text, CASE WHEN (l.page_id + l.k) % 21 % 5 = 2 THEN 'nofollow' ELSE '' END AS rel,
         ((l.page_id + l.k) % 21 % 3 = 0 OR (l.page_id + l.k) % 21 % 7 <> 1) AS internal,
         CASE WHEN (l.page_id + l.k) % 21 % 3 = 0 THEN o.url WHEN (l.page_id + l.k) % 21 % 7 = 1 THEN 'https://elsewhere.example/' ELSE l.scheme || '://' || l.site_id || l.href END AS target
  FROM link1 l JOIN (SELECT site_id, count(*) AS n FROM crawl GROUP BY site_id) s ON l.site_id = s.site_id
  JOIN crawl o ON o.site_id = l.site_id AND o.page_ord = (l.page_ord + l.k) % s.n + 1
)"""


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_id, site_id, url, created_at, engine_version, pages_analyzed, overall, render_failed."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("audit_id"), F.col("user_id").alias("site_id"), F.concat(F.when(i % 2 == 0, "https://www.s").otherwise("http://s"), F.col("user_id").cast("string"), F.lit(".example.com/a/")).alias("url"), F.col("ts").alias("created_at"),
        F.when(i % 11 != 0, (F.lit(13) + F.floor(i / 4000)).cast("int")).alias("engine_version"), (F.lit(6) + i % 17).cast("int").alias("pages_analyzed"), (F.lit(40) + (i * 7) % 61).cast("int").alias("overall"), (i % 37 == 0).alias("render_failed"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_id, emit_ord, id, category, severity, status of the audit view; some findings are missing."""
    e = table(spark, sf_dir, "events").select("event_id")
    each = e.select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("id"), F.lit(b).alias("category"), F.lit(c).alias("severity")) for k, (a, b, c) in enumerate(FINDINGS)])).alias("x"))
    i, k = F.col("event_id"), F.col("x.k")
    status = F.element_at(F.array(*[F.lit(s) for s in STATES]), ((i * (k + 3) + F.floor(i / 7)) % 5 + 1).cast("int"))
    return each.where((i + k) % 9 != 4).select(i.alias("audit_id"), k.alias("emit_ord"), "x.id", "x.category", "x.severity", status.alias("status"))


AUDITS_SQL = """
audits AS MATERIALIZED (
  SELECT event_id AS audit_id, user_id AS site_id, 's' || CAST(user_id AS VARCHAR) || '.example.com/a' AS nurl, ts AS created_at,
         CASE WHEN event_id % 11 <> 0 THEN 13 + event_id // 4000 END AS engine_version, 6 + event_id % 17 AS pages_analyzed, 40 + (event_id * 7) % 61 AS overall, event_id % 37 = 0 AS render_failed
  FROM events
)"""
FINDINGS_SQL = f"""
spec(k, id, category, severity) AS (VALUES {", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(FINDINGS))}),
findings AS MATERIALIZED (
  SELECT event_id AS audit_id, k AS emit_ord, id, category, severity, [{", ".join(f"'{s}'" for s in STATES)}][CAST((event_id * (k + 3) + event_id // 7) % 5 + 1 AS INTEGER)] AS status
  FROM events, spec WHERE (event_id + k) % 9 <> 4
)"""
PREVIOUS_SQL = """
moments AS MATERIALIZED (SELECT nurl, created_at, max(audit_id) AS last FROM audits GROUP BY nurl, created_at),
previous AS MATERIALIZED (SELECT a.*, m.prev_id FROM audits a JOIN (SELECT nurl, created_at, lag(last) OVER (PARTITION BY nurl ORDER BY created_at) AS prev_id FROM moments) m ON a.nurl = m.nurl AND a.created_at = m.created_at)"""
