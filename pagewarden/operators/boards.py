"""Lists of findings in the orders of dashboards and reports, boards over many audits, and what is known of each check's standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audits import bad, confusion_matrix, effective_rank
from .joins import dealt
from .scoring import case

FLAGGED, NEEDS, HEALTH, KEY_FINDINGS, SALES_PASSES, ASKED, PRIORITIES, QUICK_WINS, BATTLES = 25, 8, 13, 6, 27, 6, 7, 4, 5
# Tier and confidence (percent) of the standard behind each check.
STANDARDS = {
    "title-missing": (1, 100), "title-length": (3, 75), "title-duplicate": (2, 85), "desc-missing": (2, 85), "desc-length": (3, 75), "desc-duplicate": (3, 75), "h1-missing": (1, 95), "h1-multiple": (3, 75), "h1-duplicate": (3, 70), "h1-hidden": (2, 80),
    "heading-order": (1, 90), "empty-headings": (1, 90), "content-thin": (2, 85), "lang-missing": (1, 95), "viewport-missing": (2, 85), "viewport-noscale": (1, 90), "favicon-missing": (2, 75), "favicon-file": (2, 70), "doctype-missing": (1, 100),
    "charset-not-utf8": (1, 95), "meta-keywords": (2, 85), "deprecated-tags": (1, 90), "url-hygiene": (2, 80), "copyright-stale": (3, 60), "canonical-missing": (1, 100), "canonical-multiple": (2, 90), "canonical-relative": (2, 80), "crawl-blocked": (2, 90),
    "error-pages": (1, 95), "host-variants": (2, 85), "hreflang": (1, 90), "meta-refresh": (2, 85), "near-duplicate": (2, 80), "no-pages": (1, 100), "noindex": (1, 95), "redirect-chain": (1, 95), "robots-blocks-all": (1, 95), "robots-blocks-section": (2, 85),
    "robots-meta-invalid": (1, 90), "robots-missing": (1, 100), "robots-sitemap": (2, 80), "sitemap-coverage": (2, 80), "sitemap-exists": (1, 95), "sitemap-lastmod": (2, 80), "soft-404": (2, 90), "trailing-slash": (2, 80), "broken-links": (1, 90),
    "broken-links-soft": (2, 80), "empty-anchor": (1, 85), "generic-anchor": (3, 70), "internal-links-few": (3, 70), "orphan-pages": (3, 70), "jsonld-missing": (1, 100), "jsonld-invalid": (1, 100), "schema-org": (2, 85), "schema-breadcrumb": (2, 85),
    "schema-incomplete": (2, 85), "og-tags": (3, 80), "og-image-relative": (3, 80), "twitter-card": (3, 70), "https": (1, 100), "mixed-content": (1, 100), "security-headers": (2, 85), "ssl-chain-incomplete": (1, 95), "ttfb-slow": (2, 90), "compression": (2, 85),
    "html-size": (2, 80), "inline-bloat": (3, 70), "script-count": (3, 70), "head-blocking": (2, 85), "third-party": (2, 80), "text-ratio": (3, 60), "img-alt": (1, 100), "img-dimensions": (2, 80), "img-lazy": (3, 75), "render-diff": (2, 85), "spa-shell": (2, 85),
    "noscript-fallback": (2, 80), "geo-llms-txt": (4, 60), "geo-bot-access": (4, 75), "geo-faq-schema": (4, 60), "geo-qa-content": (4, 55), "geo-eeat": (2, 80), "geo-citable": (4, 55), "geo-entity": (4, 55), "geo-trust-pages": (4, 65), "geo-spa-risk": (4, 70),
    "cwv-score": (2, 90), "cwv-field": (2, 90),
}


def severity_rank(severity: Column, other: int = 3) -> Column:
    return case(severity, {"high": 0, "med": 1, "low": 2}, other)


def ranked(rows: DataFrame, *order: Column | str, k: int | None = None, name: str = "rank") -> DataFrame:
    """rows with their place in each audit by an order, equal ones in the order of the report; the first k."""
    out = rows.withColumn(name, F.row_number().over(W.partitionBy("audit_id").orderBy(*order, "emit_ord", "id")))
    return out if k is None else out.where(F.col(name) <= k)


def dashboard(checks: DataFrame, status: str | None = None, category: str | None = None) -> DataFrame:
    """Findings of a status and a category (all by default): failures, warnings, notes, passes, each by severity."""
    rows = checks
    for column, value in (("status", status), ("category", category)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return ranked(rows, case(F.col("status"), {"fail": 0, "warn": 1, "info": 2, "pass": 3}, 4), severity_rank(F.col("severity"), 1))


def category_badges(checks: DataFrame) -> DataFrame:
    """(audit_id, category, issues): failures and warnings of each category that has a finding."""
    return checks.groupBy("audit_id", "category").agg(F.count_if(bad(F.col("status"))).alias("issues"))


def health_table(checks: DataFrame) -> DataFrame:
    """The first thirteen findings that are not minor, not notes and not about answer engines: failures, warnings, passes."""
    rows = checks.where("severity <> 'low' AND status <> 'info' AND category <> 'geo'")
    return ranked(rows, case(F.col("status"), {"fail": 0, "warn": 1, "pass": 2}, 3), k=HEALTH)


def key_findings(checks: DataFrame) -> DataFrame:
    return ranked(checks.where("status = 'fail' AND severity = 'high'"), k=KEY_FINDINGS)


def sales_issues(checks: DataFrame) -> DataFrame:
    """Issues by severity."""
    return ranked(checks.where(bad(F.col("status"))), severity_rank(F.col("severity")))


def sales_passes(checks: DataFrame) -> DataFrame:
    return ranked(checks.where("status = 'pass'"), k=SALES_PASSES)


def asked_first(checks: DataFrame) -> DataFrame:
    """The six failures that are asked about first."""
    return ranked(checks.where("status = 'fail'"), severity_rank(F.col("severity")), k=ASKED)


def issue_cards(checks: DataFrame, per_page: int = 2) -> DataFrame:
    """Issues other than those of answer engines as cards: bucket, place in it, slide of the bucket and a number that runs through all buckets."""
    rows = checks.where(bad(F.col("status")) & (F.col("category") != "geo")).withColumn("effective", effective_rank(F.col("severity"), F.col("status")))
    bucket = case(F.col("effective"), {0: "urgent", 1: "improve"}, "minor")
    place = F.row_number().over(W.partitionBy("audit_id", "effective").orderBy("emit_ord", "id"))
    number = F.row_number().over(W.partitionBy("audit_id").orderBy("effective", "emit_ord", "id"))
    return rows.select("audit_id", "id", bucket.alias("bucket"), place.alias("place"), F.floor((place - 1) / per_page).cast("int").alias("slide"), number.alias("number"))


def template_priorities(checks: DataFrame, fixable: Column) -> DataFrame:
    """Failures, severe ones first, the first seven, with the week of each; ``quick`` tells the first four that can be fixed."""
    rows = ranked(checks.where("status = 'fail'").withColumn("fixable", fixable), F.when(F.col("severity") == "high", 0).otherwise(1))
    nth = F.sum(F.col("fixable").cast("int")).over(W.partitionBy("audit_id").orderBy("rank"))
    out = rows.withColumns({"quick": F.col("fixable") & (nth <= QUICK_WINS), "timeline": F.when(F.col("rank") <= PRIORITIES, F.when(F.col("rank") <= 3, "week 1").otherwise("weeks 2-3"))})
    return out.where((F.col("rank") <= PRIORITIES) | F.col("quick")).select("audit_id", "rank", "id", "quick", "timeline")


def roadmap(priorities: DataFrame) -> DataFrame:
    """priorities with the part of the plan that each belongs to: the first if its time has a 1 in it."""
    return priorities.withColumn("part", F.when(F.coalesce("timeline", F.lit("")).contains("1"), "first").otherwise("later"))


def compare_sites(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(audit_id, diff, leads, losing, winning, battles) of pairs(audit_id, ours, theirs) and verdicts(audit_id, ord, flag, verdict)."""
    flags = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct("ord", "flag")))), lambda x: x["flag"])
    told = verdicts.groupBy("audit_id").agg(flags("lose").alias("losing"), flags("win").alias("winning"))
    none = F.array().cast("array<string>")
    out = pairs.join(dealt(told), "audit_id", "left").withColumns({n: F.coalesce(n, none) for n in ("losing", "winning")})
    return out.select("audit_id", (F.col("ours") - F.col("theirs")).alias("diff"), (F.col("ours") >= F.col("theirs")).alias("leads"), "losing", "winning", F.slice("losing", 1, BATTLES).alias("battles"))


def growth(overall: Column) -> Column:
    """struct(now, m3, m6): the score that a plan without a model reckons with."""
    return F.struct(overall.alias("now"), F.least(overall + 15, F.lit(80)).alias("m3"), F.least(overall + 25, F.lit(88)).alias("m6"))


def competitor_categories(ours: DataFrame, theirs: DataFrame, both_only: bool = False) -> DataFrame:
    """(audit_id, category, ours, theirs, diff) of scores(audit_id, category, score); diff is null if a side is missing."""
    a, b = ours.select("audit_id", "category", F.col("score").alias("ours")), theirs.select("audit_id", "category", F.col("score").alias("theirs"))
    return a.join(dealt(b), ["audit_id", "category"], "inner" if both_only else "full").withColumn("diff", F.col("ours") - F.col("theirs"))


# ---------------------------------------------------------------- over many audits


def audit_list(audits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k newest audits with their score, newest first; of one time the larger id."""
    newest = audits.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(k)
    place = F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("audit_id")))
    return newest.join(scores, "audit_id").withColumn("rank", place)


def quality_sites(latest: DataFrame, checked: DataFrame) -> DataFrame:
    """Of each site's latest audit that was cross-checked, confusion and flag, with its place on the board.

    checked(audit_id, kind, dim, ours, theirs).  Flagged ones come first, then those with more wrong
    verdicts, then newer ones.
    """
    rows = checked.join(dealt(latest.select("audit_id")), "audit_id", "left_semi")
    flag = rows.groupBy("audit_id").agg(F.bool_or((F.col("kind") == "fact") & (F.col("ours") != F.col("theirs"))).alias("flag"))
    each = flag.join(dealt(confusion_matrix(rows, "audit_id")), "audit_id", "left").join(dealt(latest.select("audit_id", "created_at")), "audit_id")
    wrong = F.coalesce(F.col("fp") + F.col("fn"), F.lit(0))
    # The board is one list of all sites: its order is a sort by ranges, numbered without gathering it.
    return each.withColumn("wrong", wrong)


def quality_order(board: DataFrame, k: int) -> DataFrame:
    """The first k rows of a quality board, in order."""
    order = (F.desc("flag"), F.desc("wrong"), F.desc("created_at"), F.desc("audit_id"))
    return board.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def quality_totals(audits: DataFrame, board: DataFrame, latest: DataFrame) -> DataFrame:
    """One row: audits, sites, sites with a cross-check, flagged sites."""
    return audits.agg(F.count(F.lit(1)).alias("total")).crossJoin(latest.agg(F.count(F.lit(1)).alias("sites"))).crossJoin(board.agg(F.count(F.lit(1)).alias("with_verify"), F.count_if("flag").alias("flagged")))


def needs_verify(annotated: DataFrame) -> DataFrame:
    """The eight checks that need a look most often."""
    return annotated.where("needs_verify").groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(NEEDS)


def cost_board(costs: DataFrame) -> DataFrame:
    """One row of costs(audit_id, usd, tokens_in, tokens_out): audits with a cost, sums, the average cost of such an audit."""
    with_cost = costs.where(F.col("usd").isNotNull())
    s = with_cost.agg(F.count(F.lit(1)).alias("audits"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    return s.withColumn("average", F.when(F.col("audits") > 0, F.col("usd") / F.col("audits")).otherwise(0.0))


# ---------------------------------------------------------------- standards


def authority(checks: DataFrame) -> DataFrame:
    """checks with tier and confidence of the standard behind each; nulls where there is none."""
    tier, sure = F.lit(None).cast("int"), F.lit(None).cast("int")
    table = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")).alias("v")) for k, (t, c) in STANDARDS.items()]))
    found = F.try_element_at(table, F.col("id"))
    return checks.withColumns({"tier": F.coalesce(found["t"], tier), "standard_confidence": F.coalesce(found["c"], sure)})


def reference_checks(references: DataFrame) -> DataFrame:
    """(url, ids) of references(id, url): the checks that a source stands behind."""
    return references.groupBy("url").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def reference_health(fetched: DataFrame) -> DataFrame:
    """fetched(url, status nullable, final) with its state: dead (an error, or 400 and more), moved (elsewhere but for query and fragment), ok."""
    bare = lambda c: F.regexp_replace(c, r"[?#].*$", "")
    dead = F.col("status").isNull() | (F.col("status") >= 400)
    moved = F.col("final").isNotNull() & (F.col("final") != "") & (bare("final") != bare("url"))
    return fetched.withColumn("state", F.when(dead, "dead").when(moved, "moved").otherwise("ok"))
