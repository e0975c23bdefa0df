"""What to do about findings: issues of single pages, files that fix them, and which files a site needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import _meta, _n

# The file that answers a check.
FIX_FOR_CHECK = {
    "robots-missing": "robots", "robots-blocks-all": "robots", "robots-blocks-section": "robots", "geo-bot-access": "robots", "robots-sitemap": "robots", "sitemap-exists": "sitemap", "sitemap-coverage": "sitemap", "schema-org": "org-schema",
    "jsonld-missing": "org-schema", "geo-entity": "org-schema", "geo-faq-schema": "faq-schema", "geo-qa-content": "faq-schema", "geo-llms-txt": "llms-txt", "canonical-missing": "canonical", "security-headers": "headers", "compression": "headers",
    "spa-shell": "ssr", "geo-spa-risk": "ssr", "title-missing": "meta", "desc-missing": "meta", "title-length": "meta", "title-duplicate": "meta", "hreflang": "hreflang",
}
#: Crawlers that a generated robots.txt names, and paths that it closes.
WELCOME = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "PerplexityBot", "Google-Extended")
CLOSED = ("/admin/", "/wp-admin/", "/cart", "/checkout")


def page_issues(pages: DataFrame) -> DataFrame:
    """(site_id, url, issue, severity) of each page by itself: a checklist that is stricter than the audit."""
    title, desc, view = F.coalesce("title", F.lit("")), _meta("description"), _meta("viewport")
    h1 = _n("headings", lambda h: h["tag"] == "h1")
    levels = F.transform("headings", lambda h: F.substring(h["tag"], 2, 1).cast("int"))
    jump = F.exists(F.zip_with(F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), levels, lambda b, a: b - a), lambda d: d > 1)
    ld = F.transform("json_ld", lambda j: F.try_parse_json(j).isNull())
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = (
        ("doctype", "low", ~F.col("has_doctype")), ("title", "high", title == ""), ("title-length", "med", (title != "") & ~F.length(title).between(10, 65)), ("desc", "high", desc == ""), ("desc-length", "low", (desc != "") & ~F.length(desc).between(40, 175)),
        ("viewport", "high", view == ""), ("charset", "med", empty(F.col("charset"))), ("lang", "med", empty(F.col("lang"))), ("canonical", "high", empty(F.col("canonical"))), ("canonical-multi", "high", ~empty(F.col("canonical")) & (F.col("canonical_count") > 1)),
        ("h1", "high", h1 == 0), ("h1-multi", "low", h1 > 1), ("og-title", "med", _meta("og:title") == ""), ("og-image", "med", _meta("og:image") == ""), ("og-image-rel", "low", (_meta("og:image") != "") & ~_meta("og:image").rlike("^https?://")),
        ("jsonld", "high", F.size("json_ld") == 0), ("jsonld-invalid", "high", F.exists(ld, lambda x: x)), ("img-alt", "med", _n("images", lambda i: (i["src"] != "") & (F.coalesce(i["alt"], F.lit("")) == "")) > 0), ("noindex", "high", _meta("robots").rlike("(?i)noindex")),
        ("heading-order", "low", jump), ("og-desc", "low", _meta("og:description") == ""), ("twitter-card", "low", _meta("twitter:card") == ""), ("viewport-noscale", "low", view.rlike(r"maximum-scale\s*=\s*1(\.0)?\b|user-scalable\s*=\s*no")),
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    return pages.select("site_id", "url", F.explode(found).alias("x")).select("site_id", "url", "x.*")


def needed_fixes(checks: DataFrame, *keys: str) -> DataFrame:
    """(keys, fix, checks): the files that a site's failed or warned checks ask for."""
    fix = F.element_at(F.create_map(*[F.lit(x) for pair in FIX_FOR_CHECK.items() for x in pair]), F.col("id"))
    rows = checks.where(F.col("status").isin("fail", "warn") & F.col("id").isin(*FIX_FOR_CHECK)).withColumn("fix", fix)
    return rows.groupBy(*keys, "fix").agg(F.sort_array(F.collect_set("id")).alias("checks"))


def robots_file(origin: Column, sitemaps: Column) -> Column:
    """A robots.txt that lets search and answer engines in, with the sitemaps that the site declares."""
    maps = F.when(F.size(F.coalesce(sitemaps, F.array().cast("array<string>"))) > 0, F.array_distinct(sitemaps)).otherwise(F.array(F.concat(origin, F.lit("/sitemap.xml"))))
    lines = ["User-agent: *", *[f"Disallow: {p}" for p in CLOSED], "Allow: /", ""] + [x for b in WELCOME for x in (f"User-agent: {b}", "Allow: /", "")]
    return F.concat(F.lit("\n".join(lines) + "\n"), F.array_join(F.transform(maps, lambda m: F.concat(F.lit("Sitemap: "), m)), "\n"), F.lit("\n"))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sitemap_entries(pages: DataFrame) -> DataFrame:
    """(site_id, entry_ord, entry): the lines of a sitemap, one for each final URL; files are written by partition, not in one row."""
    urls = pages.select("site_id", F.coalesce("final_url", "url").alias("u"), "page_ord").groupBy("site_id", "u").agg(F.min("page_ord").alias("entry_ord"))
    return urls.select("site_id", "entry_ord", F.concat(F.lit("  <url><loc>"), xml_escape(F.col("u")), F.lit("</loc></url>")).alias("entry"))
