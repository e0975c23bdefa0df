"""Tables from documents that other tools wrote: sitemaps, PageSpeed and Lighthouse results, stored audits."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SITEMAP_CHARS, SITEMAP_URLS, SITEMAP_CHILDREN, SITEMAP_DEPTH = 2_000_000, 2000, 10, 2
#: Audits of Lighthouse by our dimension.
LIGHTHOUSE = {
    "title": "document-title", "description": "meta-description", "canonical": "canonical", "hreflang": "hreflang", "imageAlt": "image-alt", "viewport": "viewport", "lang": "html-has-lang", "crawlable": "is-crawlable", "robotsTxt": "robots-txt",
    "httpStatus": "http-status-code", "linkText": "link-text",
}


def sitemap_urls(sitemaps: DataFrame, roots: DataFrame) -> DataFrame:
    """(site_id, url, lastmod) of the pages that sitemaps list, at most 2000 a site, in order.

    sitemaps(url, xml) is what was fetched; roots(site_id, url) are where each site starts.  An index
    leads to its first ten children, two levels down.
    """
    x = F.substring("xml", 1, SITEMAP_CHARS)
    locs = F.regexp_extract_all(x, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    docs = sitemaps.select("url", locs.alias("locs"), x.rlike("(?i)<sitemapindex").alias("index"), x.rlike("(?i)<lastmod>").alias("lastmod")).dropDuplicates(["url"])
    level = roots.select("site_id", "url", F.array(F.lit(0)).alias("at")).dropDuplicates(["site_id", "url"])
    found = None
    for _ in range(SITEMAP_DEPTH + 1):
        read = level.join(docs, "url")
        each = read.where("NOT index").select("site_id", "lastmod", "at", F.posexplode("locs").alias("k", "loc")).select("site_id", F.col("loc").alias("url"), "lastmod", F.concat("at", F.array("k")).alias("at"))
        found = each if found is None else found.union(each)
        level = read.where("index").select("site_id", "at", F.posexplode(F.slice("locs", 1, SITEMAP_CHILDREN)).alias("k", "loc")).select("site_id", F.col("loc").alias("url"), F.concat("at", F.array("k")).alias("at"))
    first = found.groupBy("site_id", "url").agg(F.min("at").alias("at"), F.bool_or("lastmod").alias("lastmod"))
    w = W.partitionBy("site_id").orderBy("at", "url")
    return first.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= SITEMAP_URLS).drop("_k", "at")


def sitemap_pages(sitemaps: DataFrame, roots: DataFrame, persist) -> DataFrame:
    """(site_id, url, lastmod, depth) of all pages that the sitemaps of roots(site_id, url) lead to, each once.

    sitemaps(url, xml) is what was fetched.  Indices are followed to any depth; what a site has opened is
    not opened again, so an index that names itself or one above it ends.  A round appends what it opened
    and what that lists; ``persist`` writes a table and reads it back.  ``sitemap_urls`` is the same within limits.
    """
    both = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), _unescaped)
    docs = sitemaps.select("url", locs.alias("locs"), F.col("xml").rlike("(?i)<sitemapindex").alias("index"), F.col("xml").rlike("(?i)<lastmod>").alias("lastmod")).dropDuplicates(["url"])
    opened, listed = [persist(roots.select("site_id", "url").distinct())], []
    while not opened[-1].isEmpty():
        each = opened[-1].join(docs, "url").select("site_id", "index", "lastmod", F.explode("locs").alias("url"))
        listed.append(persist(each.withColumn("depth", F.lit(len(listed) + 1))))
        new = listed[-1].where("index").select("site_id", "url").distinct()
        opened.append(persist(new.join(both(opened), ["site_id", "url"], "left_anti")))
    if not listed:
        return opened[0].select("site_id", "url", F.lit(False).alias("lastmod"), F.lit(0).alias("depth"))
    return both(listed).where("NOT index").groupBy("site_id", "url").agg(F.bool_or("lastmod").alias("lastmod"), F.min("depth").alias("depth"))


def _unescaped(loc: F.Column) -> F.Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        loc = F.replace(loc, F.lit(name), F.lit(char))
    return loc


def llms_txt(text: F.Column) -> F.Column:
    """The file's first 5000 characters, or null if it is an HTML page in its place."""
    return F.when(~F.substring(F.trim(text), 1, 200).rlike(r"(?i)<!doctype|<html") & (F.trim(text) != ""), F.substring(text, 1, 5000))


def pagespeed(raw: DataFrame) -> DataFrame:
    """raw(site_id, json) with psi: struct(skip, ok, perf_score, overall), lab and field values and the five largest savings."""
    v = F.try_parse_json("json")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    lab = {"lcp_ms": "largest-contentful-paint", "cls": "cumulative-layout-shift", "tbt_ms": "total-blocking-time", "fcp_ms": "first-contentful-paint", "ttfb_ms": "server-response-time"}
    audits = F.from_json(F.get_json_object("json", "$.lighthouseResult.audits"), "map<string,struct<title:string,numericValue:double,details:struct<type:string>>>")
    saving = F.filter(F.map_values(audits), lambda a: (a["details"]["type"] == "opportunity") & (a["numericValue"] > 150))
    ranked = F.array_sort(F.transform(saving, lambda a: F.struct((-a["numericValue"]).alias("minus"), a["title"].alias("title"))))
    ok = v.isNotNull() & get("$.lighthouseResult", "variant").isNotNull()
    score = F.floor(F.coalesce(get("$.lighthouseResult.categories.performance.score", "double"), F.lit(0.0)) * 100 + 0.5).cast("int")
    return raw.select(
        "site_id",
        F.struct(F.lit(False).alias("skip"), F.coalesce(ok, F.lit(False)).alias("ok"), score.alias("perf_score"), get("$.loadingExperience.overall_category", "string").alias("overall")).alias("psi"),
        *[get(f"$.lighthouseResult.audits['{a}'].numericValue", "double").alias(n) for n, a in lab.items()],
        *[get(f"$.loadingExperience.metrics.{m}.percentile", "double").alias(n) for n, m in (("field_lcp_ms", "LARGEST_CONTENTFUL_PAINT_MS"), ("field_inp_ms", "INTERACTION_TO_NEXT_PAINT"), ("field_cls_100", "CUMULATIVE_LAYOUT_SHIFT_SCORE"))],
        F.transform(F.slice(ranked, 1, 5), lambda a: F.struct(a["title"].alias("title"), F.floor(0.5 - a["minus"]).alias("saving_ms"))).alias("opportunities"),
    )


def lighthouse(raw: DataFrame) -> DataFrame:
    """(audit_id, dim, verdict) of raw(audit_id, json): pass from a score of 0.9, n/a without one."""
    scores = F.from_json(F.get_json_object("json", "$.lighthouseResult.audits"), "map<string,struct<score:double>>")
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(a).alias("audit")) for d, a in LIGHTHOUSE.items()])
    each = raw.select("audit_id", scores.alias("s"), F.explode(dims).alias("x"))
    score = F.try_element_at("s", F.col("x.audit"))["score"]
    return each.select("audit_id", "x.dim", F.when(score.isNull(), "n/a").when(score >= 0.9, "pass").otherwise("fail").alias("verdict"))


#: What is read of a stored audit; older documents lack some of it.
STORED = "id string, url string, createdAt string, engineVersion int, pagesAnalyzed int, score struct<overall:int,grade:string,categoryScores:map<string,int>>, checks array<struct<id:string,category:string,severity:string,status:string,title:string,affectedCount:bigint>>"


def stored_audits(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON document below a path."""
    return spark.read.schema(STORED).option("multiLine", True).json(path)


def audit_tables(stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(audits, checks, categories) of stored audits, as the comparison operators take them."""
    a = stored.select(F.col("id").alias("audit_id"), F.col("url").alias("site_id"), "url", F.to_timestamp("createdAt").alias("created_at"), F.col("engineVersion").alias("engine_version"), F.coalesce("pagesAnalyzed", F.lit(0)).alias("pages_analyzed"), F.col("score.overall").alias("overall"), F.lit(False).alias("render_failed"))
    c = stored.select(F.col("id").alias("audit_id"), F.posexplode("checks").alias("emit_ord", "c")).select("audit_id", "emit_ord", "c.id", "c.category", "c.severity", "c.status", "c.title", F.col("c.affectedCount").alias("affected_count"))
    k = stored.select(F.col("id").alias("audit_id"), F.explode("score.categoryScores").alias("category", "score"))
    return a, c, k


def typed_documents(df: DataFrame, text: str, versions: dict[int, dict[str, tuple[str | None, str]]], key: str = "version", first: int = 1) -> DataFrame:
    """df with version, the fields of its JSON documents by that version's paths, and fault, without the text.

    ``versions`` names for each version every field's path (None: not in it) and type.  The text is
    parsed once, to a variant.  A document without ``key`` has version ``first``.  fault is null, or
    ``unreadable`` (no JSON object) or ``unknown_version``; the fields of such a row are null.  A value that does
    not fit its type is null.
    """
    v = F.try_parse_json(text)
    rows = df.withColumn("_v", v)
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("version", F.when(is_object, F.coalesce(F.try_variant_get("_v", f"$.{key}", "int"), F.lit(first))))
    fields = list(dict.fromkeys(f for paths in versions.values() for f in paths))
    columns = {}
    for f in fields:
        out = F.lit(None)
        for n, paths in versions.items():
            path, kind = paths[f]
            if path:
                out = F.when(F.col("version") == n, F.try_variant_get("_v", path, kind)).otherwise(out)
        columns[f] = out
    fault = F.when(~is_object, "unreadable").when(~F.col("version").isin(*versions), "unknown_version")
    return rows.withColumns({**columns, "fault": fault}).drop("_v", text)
