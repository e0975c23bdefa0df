"""How sure a finding is: kinds of checks, agreement with an outside verdict, where in the source it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import dealt
from .scoring import case

# Checks that a parser decides, that a threshold decides, that need judgement; other checks by category.
DETERMINISTIC = (
    "title-missing", "desc-missing", "h1-missing", "canonical-missing", "jsonld-missing", "schema-org", "schema-breadcrumb", "geo-faq-schema", "geo-entity", "robots-missing", "robots-blocks-all", "robots-blocks-section", "sitemap-exists", "sitemap-coverage",
    "sitemap-lastmod", "viewport-missing", "viewport-noscale", "lang-missing", "favicon-missing", "hreflang", "og-tags", "twitter-card", "geo-llms-txt", "geo-bot-access", "security-headers", "charset-not-utf8", "spa-shell", "soft-404", "noscript-fallback",
    "jsonld-invalid", "schema-incomplete", "robots-meta-invalid",
)
RULE = (
    "title-length", "title-duplicate", "desc-length", "desc-duplicate", "content-thin", "near-duplicate", "text-ratio", "h1-multiple", "h1-hidden", "heading-order", "img-alt", "broken-links", "internal-links-few", "orphan-pages", "cwv-score", "render-diff",
    "copyright-stale",
)
JUDGED = ("geo-eeat", "geo-citable", "geo-qa-content", "geo-trust-pages", "geo-spa-risk")
BY_CATEGORY = {"schema": "deterministic", "index": "deterministic", "security": "deterministic", "geo": "ai"}
BASE = {"deterministic": 0.97, "rule": 0.88, "ai": 0.65}
# The dimension of an outside verdict that a check can be held against.
DIMENSION = {"title-missing": "title", "title-length": "title", "title-duplicate": "title", "desc-missing": "description", "desc-length": "description", "desc-duplicate": "description", "canonical-missing": "canonical", "img-alt": "imageAlt"}


def check_type(id_: Column, category: Column) -> Column:
    return F.when(id_.isin(*DETERMINISTIC), "deterministic").when(id_.isin(*RULE), "rule").when(id_.isin(*JUDGED), "ai").otherwise(case(category, BY_CATEGORY, "rule"))


def annotate(checks: DataFrame, verified: DataFrame) -> DataFrame:
    """checks with type, sure (percent) and needs_verify, by verified(audit_id, dim, agree).

    Agreement makes a finding at least 99 % sure, disagreement 50 % and to be looked at.
    """
    rows = checks.withColumns({"type": check_type(F.col("id"), F.col("category")), "_dim": case(F.col("id"), DIMENSION, None)})
    v = verified.select(F.col("audit_id").alias("_a"), F.col("dim").alias("_d"), "agree")
    both = rows.join(dealt(v), (F.col("audit_id") == F.col("_a")) & (F.col("_dim") == F.col("_d")), "left")
    base = case(F.col("type"), BASE, 0.85)
    sure = F.when(F.col("agree").isNull(), base).when(F.col("agree"), F.greatest(base, F.lit(0.99))).otherwise(0.5)
    return both.withColumns({"sure": F.floor(sure * 100 + 0.5).cast("int"), "needs_verify": F.coalesce(~F.col("agree"), F.lit(False))}).drop("_dim", "_a", "_d", "agree")


def type_counts(annotated: DataFrame) -> DataFrame:
    """(audit_id, deterministic, rule, ai, needs_verify)."""
    return annotated.groupBy("audit_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in BASE], F.count_if("needs_verify").alias("needs_verify"))


def explain_mismatch(text: Column) -> Column:
    """struct(dim, ours, theirs) of 'dim(ours:x/theirs:y)'; nulls where the text is none."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(\w+)\(ours:(\w+)/theirs:(\w+)\)", k), F.lit(""))
    return F.struct(part(1).alias("dim"), part(2).alias("ours"), part(3).alias("theirs"))


def locate(html: Column, pattern: str) -> Column:
    """struct(count, snippet, line) of the elements that match a pattern in the source; line counts from 1, null for none."""
    first = F.regexp_substr(html, F.lit(pattern))
    line = F.size(F.split(F.substr(html, F.lit(1), F.position(first, html)), "\n"))
    return F.struct(F.regexp_count(html, F.lit(pattern)).alias("count"), F.substring(first, 1, 300).alias("snippet"), F.when(first.isNotNull(), line).alias("line"))


def shown_confidence(own: Column, sure: Column) -> Column:
    """The finding's own confidence in percent, else the annotated one."""
    return F.coalesce(F.floor(own * 100 + 0.5).cast("int"), sure)


def page_of_label(label: Column) -> Column:
    """The URL at the begin of a page label such as 'https://x/ (3 images)' or 'https://x/ ↔ https://y/'."""
    return F.regexp_extract(label, r"^(\S+)", 1)


# Statuses of a firewall or a limit of requests; network errors.
WAF_STATUSES = (403, 429, 503, 401)
NETWORK_ERROR = r"(?i)fetch.failed|timeout|ECON|ETIMED"


def all_statuses(error_statuses: Column, page_statuses: Column) -> Column:
    """The distinct statuses of fetch errors, and those of pages other than 200, in order."""
    some = F.filter(F.coalesce(error_statuses, F.array().cast("array<int>")), lambda s: s.isNotNull() & (s != 0))
    other = F.filter(F.coalesce(page_statuses, F.array().cast("array<int>")), lambda s: s.isNotNull() & (s != 200))
    return F.array_sort(F.array_union(some, other))


def unreachable_reason(host: Column, statuses: Column, reasons: Column, robots_blocked: Column, proxy: bool = False) -> Column:
    """Why a site has no page: geo_block, robots, firewall, limited (other statuses) or network, in this order.

    ``statuses`` are all_statuses, ``reasons`` the messages of fetch errors, of which the first three distinct ones count.
    """
    said = F.slice(F.array_distinct(F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != ""))), 1, 3)
    silent = F.size(statuses) == 0
    geo = host.rlike(r"\.th$") & silent & F.exists(said, lambda r: r.rlike(NETWORK_ERROR)) & F.lit(not proxy)
    waf = F.exists(statuses, lambda s: s.isin(*WAF_STATUSES))
    return (
        F.when(F.coalesce(geo, F.lit(False)), "geo_block").when((robots_blocked > 0) & silent & (F.size(said) == 0), "robots").when(waf, "firewall").when(~silent, "limited").otherwise("network")
    )
