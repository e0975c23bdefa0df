"""Views of single pages for reports: signals, titles by URL, brands, pages that a finding affects, routing, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import js_round
from .rules import ok_pages

TITLE_CHARS, BRAND_CHARS, DRAFT_CHARS = 60, 40, 55
# Checks whose pages have code to copy, so that effort goes by pages.
PER_PAGE = ("h1-missing", "title-missing", "title-duplicate", "desc-missing", "desc-duplicate", "canonical-missing", "image-alt")
# The field of a page that a check's id points at, by the first pattern that fits.
FOCUS = (
    ("^title-h1", "titleh1"), ("^title", "title"), ("^h1|^heading|empty-headings", "h1"), ("desc|description", "desc"), ("canonical", "canonical"), ("noindex|robots", "robots"), ("^img|image", "images"), ("schema|jsonld", "schema"), ("content-thin|text-ratio", "content"),
    ("lang", "lang"),
)


def page_signals(pages: DataFrame, types: Column) -> DataFrame:
    """What a page's evidence shows: heading texts and counts, images without alt, numbers of links and words."""
    images = F.filter("images", lambda i: F.coalesce(i["src"], F.lit("")) != "")
    h1 = F.filter(F.transform(F.filter("headings", lambda h: h["tag"] == "h1"), lambda h: h["text"]), lambda t: t != "")
    tags = F.array_sort(F.array_distinct(F.transform("headings", lambda h: h["tag"])))
    counts = F.transform(tags, lambda t: F.concat(t, F.lit(":"), F.size(F.filter("headings", lambda h: h["tag"] == t)).cast("string")))
    meta = lambda k: F.coalesce(F.try_element_at("metas", F.lit(k)), F.lit(""))
    return pages.select(
        "site_id", "page_ord", "url", "status", F.coalesce("title", F.lit("")).alias("title"), h1.alias("h1"), counts.alias("heading_counts"), meta("description").alias("description"), F.coalesce("canonical", F.lit("")).alias("canonical"), meta("robots").alias("robots"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.size(images).alias("images"), F.size(F.filter(images, lambda i: i["alt"].isNull())).alias("missing_alt"), F.size(F.filter(images, lambda i: i["alt"] == "")).alias("empty_alt"), types.alias("types"),
        F.coalesce("word_count", F.lit(0)).alias("words"), F.size("links").alias("links"),
    )


def persisted(pages: DataFrame) -> DataFrame:
    """What an audit keeps of a page: no final URL, no texts."""
    h1 = F.transform(F.filter("headings", lambda h: h["tag"] == "h1"), lambda h: h["text"])
    return pages.select("site_id", "url", "status", "title", F.coalesce(F.try_element_at("metas", F.lit("description")), F.lit("")).alias("description"), h1.alias("h1"), "canonical", "word_count", "html_bytes", "elapsed", "empty_root")


def spa_sites(pages: DataFrame) -> DataFrame:
    """(site_id, is_spa): whether half of a site's pages are empty shells."""
    return ok_pages(pages).groupBy("site_id").agg((F.avg(F.coalesce("empty_root", F.lit(False)).cast("int")) >= 0.5).alias("is_spa"))


def bare_url(url: Column) -> Column:
    """Lower case, without scheme and last slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/+$", ""))


def titles_of(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """asked(site_id, asked) with the title of the page of that URL, else of that URL without its query; '' for none.

    Of pages with one key the last counts, for keys without a query the first.
    """
    title = F.trim(F.regexp_replace(F.replace("title", F.lit("�"), F.lit("")), r"\s+", " "))
    each = pages.select("site_id", "page_ord", title.alias("title"), F.posexplode(F.array("url", "final_url")).alias("k", "u")).where("title <> '' AND u IS NOT NULL").withColumn("key", bare_url(F.col("u")))
    exact = each.groupBy("site_id", "key").agg(F.max_by("title", F.struct("page_ord", "k")).alias("exact"))
    stripped = each.withColumn("key", F.regexp_replace("key", r"\?.*$", "")).groupBy("site_id", "key").agg(F.min_by("title", F.struct("page_ord", "k")).alias("stripped"))
    rows = asked.withColumns({"key": bare_url(F.col("asked"))}).withColumn("short", F.regexp_replace("key", r"\?.*$", ""))
    rows = rows.join(exact, ["site_id", "key"], "left").join(exact.select("site_id", F.col("key").alias("short"), F.col("exact").alias("exact_short")), ["site_id", "short"], "left")
    rows = rows.join(stripped.select("site_id", F.col("key").alias("short"), "stripped"), ["site_id", "short"], "left")
    return rows.select("site_id", "asked", F.coalesce("exact", "exact_short", "stripped", F.lit("")).alias("title"))


def affected_pages(pages: DataFrame) -> DataFrame:
    """(id, site_id, url) of all pages that lack a field or share it, without a cap on their number."""
    ok = ok_pages(pages).withColumns({"u": F.coalesce("final_url", "url"), "descr": F.coalesce(F.try_element_at("metas", F.lit("description")), F.lit(""))})
    lacks = {"canonical-missing": F.coalesce("canonical", F.lit("")) == "", "title-missing": F.coalesce("title", F.lit("")) == "", "desc-missing": F.col("descr") == "", "h1-missing": ~F.exists("headings", lambda h: h["tag"] == "h1")}
    out = ok.select("site_id", F.col("u").alias("url"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in lacks.items()]))).alias("id"))
    for id_, field in (("title-duplicate", "title"), ("desc-duplicate", "descr")):
        keyed = ok.select("site_id", F.col("u").alias("url"), F.trim(field).alias("key")).where("key <> ''")
        shared = keyed.groupBy("site_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(keyed.join(shared, ["site_id", "key"]).select("site_id", "url", F.lit(id_).alias("id")))
    return out.select("id", "site_id", "url")


def title_case(text: Column) -> Column:
    """Each word's first letter in upper case; the rest stays."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def words_from_path(url: Column) -> Column:
    """The last path segment that names no language, as words; Home for none."""
    parts = F.filter(F.split(U.path(url), "/"), lambda s: (s != "") & ~s.isin("en", "th"))
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("Home"))
    return title_case(F.regexp_replace(F.coalesce(F.try_url_decode(last), last), "[-_]+", " "))


def is_home(url: Column) -> Column:
    p = F.regexp_replace(U.path(url), "/+$", "")
    return (p == "") | p.rlike("^/(en|th)$") | p.rlike("/home$")


def brands(pages: DataFrame) -> DataFrame:
    """(site_id, brand): the last part of the home page's title if it is short, else the first, else the host's first label."""
    home = F.struct((U.path(F.coalesce("final_url", "url")) != "/").alias("other"), "page_ord")
    one = pages.groupBy("site_id").agg(F.min_by(F.struct(F.coalesce(F.nullif("rendered_title", F.lit("")), "title", F.lit("")).alias("title"), "url"), home).alias("h"))
    parts = F.filter(F.transform(F.split("h.title", r"[|\-–—:·]"), lambda s: F.trim(s)), lambda s: s != "")
    last = F.get(parts, F.size(parts) - 1)
    host = F.substring_index(F.regexp_replace(U.host(F.col("h.url")), r"^www\.", ""), ".", 1)
    return one.select("site_id", F.when(F.size(parts) > 0, F.when(F.length(last) <= BRAND_CHARS, last).otherwise(F.get(parts, F.lit(0)))).otherwise(title_case(host)).alias("brand"))


def page_titles(pages: DataFrame) -> DataFrame:
    """(site_id, page_ord, draft): a title of at most sixty characters, from the brand and the path."""
    rows = pages.join(brands(pages), "site_id")
    own = F.nullif(F.trim(F.coalesce("rendered_title", F.lit(""))), F.lit(""))
    t = F.when(is_home(F.col("url")), F.coalesce(own, F.concat("brand", F.lit(" — IR Website / นักลงทุนสัมพันธ์")))).otherwise(F.concat(words_from_path(F.col("url")), F.lit(" | "), "brand"))
    return rows.select("site_id", "page_ord", F.when(F.length(t) > TITLE_CHARS, F.concat(F.rtrim(F.substring(t, 1, TITLE_CHARS - 3)), F.lit("…"))).otherwise(t).alias("draft"))


def meta_draft(h1: Column, url: Column) -> Column:
    """A title made of a page's heading and the first label of its host; '' without a heading."""
    label = F.substring_index(F.regexp_replace(U.host(url), r"^www\.", ""), ".", 1)
    text = F.concat(F.trim(F.substring(h1, 1, DRAFT_CHARS)), F.when(label != "", F.concat(F.lit(" | "), label)).otherwise(""))
    return F.when(F.coalesce(h1, F.lit("")) != "", F.substring(text, 1, TITLE_CHARS)).otherwise("")


def route(audits: DataFrame, routes: DataFrame) -> DataFrame:
    """audits(audit_id, url) with the target of the first route(ord, part, target) whose part the host contains, else that of ``_default``.

    ``routes`` is a small table of settings.
    """
    first = F.struct("ord", "target")
    table = routes.where("part <> '_default'").agg(F.array_sort(F.collect_list(F.struct("ord", "part", "target"))).alias("routes"))
    default = routes.where("part = '_default'").agg(F.min(first)["target"].alias("fallback"))
    rows = audits.crossJoin(F.broadcast(table)).crossJoin(F.broadcast(default))  # one row each
    hit = F.get(F.filter("routes", lambda r: U.host(F.col("url")).contains(r["part"])), F.lit(0))
    return rows.select("audit_id", F.coalesce(hit["target"], F.col("fallback")).alias("target"), hit.isNotNull().alias("matched"))


def error_sources(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(site_id, source, url, status) of pages with an error; the source is the last page of links(site_id, page_ord, url, target) that links to it, else '(crawl)'."""
    last = links.groupBy("site_id", F.col("target").alias("url")).agg(F.max_by("source_url", "source_ord").alias("source"))
    return pages.where("status >= 400").join(last, ["site_id", "url"], "left").select("site_id", F.coalesce("source", F.lit("(crawl)")).alias("source"), "url", "status")


def evidence_of(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """labels(site_id, label) with the URL of the page that a label such as 'https://x/ (3 images)' begins with; null for none."""
    url = F.regexp_extract("label", r"^(\S+)", 1)
    known = pages.select("site_id", "url").distinct()
    return labels.withColumn("url", url).join(known.withColumn("known", F.lit(True)), ["site_id", "url"], "left").select("site_id", "label", F.when(F.col("known"), F.col("url")).alias("evidence"))


def focus(id_: Column) -> Column:
    """The field of a page's evidence that a check points at."""
    out = F.lit("")
    for pattern, field in reversed(FOCUS):
        out = F.when(id_.rlike(pattern), field).otherwise(out)
    return out


def page_effort(id_: Column, category: Column, affected: Column) -> Column:
    """Minutes of work: by pages where there is code to copy, three days for rendering, else half an hour."""
    pages = F.when(F.coalesce(affected, F.lit(0)) > 0, affected).otherwise(1)
    return F.when(id_.isin(*PER_PAGE), F.greatest(F.lit(15), js_round(pages * 1.5))).when(category == "rendering", 3 * 8 * 60).otherwise(30).cast("int")


def site_socials(pages: DataFrame, most: int = 10) -> DataFrame:
    """(site_id, rank, url) of pages(site_id, page_ord, url, final_url, socials): a site's profiles, the first on each host, ``most`` of them.

    The first page whose path is a root comes first, then all pages in their order; a page's profiles in its own.
    """
    root = U.path(F.coalesce("final_url", "url")) == "/"
    home = pages.where(root).groupBy("site_id").agg(F.min("page_ord").alias("home"))
    each = pages.select("site_id", "page_ord", F.posexplode("socials").alias("at", "profile")).join(home, "site_id", "left")
    place = F.struct((~F.coalesce(F.col("page_ord") == F.col("home"), F.lit(False))).alias("later"), "page_ord", "at", F.col("profile").alias("url"))
    host = F.regexp_replace(U.host(F.col("profile")), r"^www\.", "")
    first = each.where(host != "").groupBy("site_id", host.alias("host")).agg(F.min(place).alias("p"))
    order = W.partitionBy("site_id").orderBy("p")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("site_id", "rank", "p.url")
