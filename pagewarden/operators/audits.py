"""Comparing audits: the previous one, deltas, history, verification, accuracy, work items, alerts.

Tables: audit(audit_id, site_id, url, created_at, engine_version, pages_analyzed, overall, render_failed),
check(audit_id, id, category, severity, status, affected_count, ...), category(audit_id, category, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import js_round
from .joins import dealt
from .scoring import case

# Checks whose state changes by itself.
UNSTABLE = ("cwv-score", "host-variants", "compression", "sitemap-exists", "robots-sitemap", "ssl-chain-incomplete", "favicon-file", "security-headers", "robots-missing")
# Dimensions of the comparison with an outside verdict; the first are facts, the others criteria.
FACT_DIMS = ("title", "description", "canonical", "imageAlt", "httpStatus")
CRITERIA_DIMS = ("hreflang", "robotsTxt", "crawlable", "viewport", "lang")
# Group and team of a category.
GROUPS = {
    "index": ("Indexing", "Technical SEO"), "schema": ("Schema", "Technical SEO"), "performance": ("Performance", "Dev / DevOps"), "onpage": ("On-page SEO", "Content / SEO"), "geo": ("AI Readiness", "SEO + Dev"),
    "links": ("Technical SEO", "Dev"), "images": ("Technical SEO", "Dev"), "rendering": ("Technical SEO", "Dev"), "security": ("Technical SEO", "Dev"),
}
ALERT_DROP = 3


def bad(status: Column) -> Column:
    return status.isin("fail", "warn")


def previous_audits(audits: DataFrame) -> DataFrame:
    """audits with prev_id: the latest earlier audit of the same normalised URL, or null."""
    rows = audits.withColumn("_key", U.norm_site_path(F.col("url")))
    # Audits of one moment have the same predecessor: the last of the moment before.
    moments = rows.groupBy("_key", "created_at").agg(F.max("audit_id").alias("last"))
    prev = moments.withColumn("prev_id", F.lag("last").over(W.partitionBy("_key").orderBy("created_at"))).drop("last")
    return rows.join(dealt(prev), ["_key", "created_at"], "left").drop("_key")


def latest_per_site(audits: DataFrame) -> DataFrame:
    """The newest audit of each site key (host, path and query)."""
    w = W.partitionBy(U.site_key(F.col("url"))).orderBy(F.desc("created_at"), F.desc("audit_id"))
    return audits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def history(audits: DataFrame) -> DataFrame:
    """audits with trend: the score less that of the next older audit of the same URL."""
    w = W.partitionBy(U.norm_site_path(F.col("url"))).orderBy("created_at", "audit_id")
    return audits.withColumn("trend", F.col("overall") - F.lag("overall").over(w))


def scope(prev_pages: Column, pages: Column, render_failed: Column) -> tuple[Column, Column, Column]:
    """(changed, grew, degraded) of the number of pages between two audits."""
    changed = F.abs(pages - prev_pages) > F.greatest(F.lit(4.0), prev_pages * 0.2)
    return changed, changed & (pages > prev_pages), ((prev_pages >= 8) & (pages < prev_pages * 0.5)) | F.coalesce(render_failed, F.lit(False))


def audit_delta(audits: DataFrame, checks: DataFrame) -> DataFrame:
    """(audit_id, prev_id, id, from_status, to_status, change, reason) of what changed since the previous audit.

    change is fixed, regressed, new or explained; reason of the last: unstable, scope or engine.  A
    check that is no longer there is not reported.
    """
    pairs = previous_audits(audits).where("prev_id IS NOT NULL")
    old = audits.select(F.col("audit_id").alias("prev_id"), F.col("pages_analyzed").alias("p_pages"), F.coalesce("engine_version", F.lit(0)).alias("p_engine"))
    pairs = pairs.join(dealt(old), "prev_id")
    changed, _, _ = scope(F.col("p_pages"), F.col("pages_analyzed"), F.col("render_failed"))
    pairs = pairs.select("audit_id", "prev_id", changed.alias("scope_changed"), (F.col("p_engine") != F.coalesce("engine_version", F.lit(0))).alias("engine_changed"))
    now = checks.select("audit_id", "id", F.col("status").alias("to_status"))
    before = checks.select(F.col("audit_id").alias("prev_id"), "id", F.col("status").alias("from_status"))
    both = pairs.join(dealt(now), "audit_id").join(dealt(before), ["prev_id", "id"], "left")
    f, t = F.col("from_status"), F.col("to_status")
    new = f.isNull() & bad(t)
    improved = (bad(f) & ~bad(t)) | ((f == "fail") & (t == "warn"))
    worse = (~bad(f) & bad(t)) | ((f == "warn") & (t == "fail"))
    reason = F.when(F.col("id").isin(*UNSTABLE), "unstable").when(F.col("scope_changed"), "scope").when(new & F.col("engine_changed"), "engine")
    kind = F.when(reason.isNotNull(), "explained").when(new, "new").when(improved, "fixed").otherwise("regressed")
    return both.where(new | F.coalesce(improved | worse, F.lit(False))).select("audit_id", "prev_id", "id", F.coalesce("from_status", F.lit("—")).alias("from_status"), "to_status", kind.alias("change"), reason.alias("reason"))


def category_deltas(audits: DataFrame, categories: DataFrame) -> DataFrame:
    """(audit_id, category, delta) of the scores of two audits; a missing category is 0."""
    pairs = previous_audits(audits).where("prev_id IS NOT NULL").select("audit_id", "prev_id")
    now = pairs.join(dealt(categories), "audit_id").select("audit_id", "category", F.col("score").alias("now"))
    before = pairs.join(dealt(categories.withColumnRenamed("audit_id", "prev_id")), "prev_id").select("audit_id", "category", F.col("score").alias("before"))
    return now.join(before, ["audit_id", "category"], "full").select("audit_id", "category", (F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def alerts(audits: DataFrame, deltas: DataFrame) -> DataFrame:
    """(audit_id, prev_score, score, regressed, new): audits that lost more than three points, got worse or have new issues."""
    prev = audits.select(F.col("audit_id").alias("prev_id"), F.col("overall").alias("prev_score"))
    pairs = previous_audits(audits).join(dealt(prev), "prev_id").select("audit_id", "prev_score", F.col("overall").alias("score"))
    counts = deltas.groupBy("audit_id").agg(F.count_if(F.col("change") == "regressed").alias("regressed"), F.count_if(F.col("change") == "new").alias("new"))
    rows = pairs.join(dealt(counts), "audit_id", "left").fillna(0, ["regressed", "new"])
    return rows.where((F.col("score") < F.col("prev_score") - ALERT_DROP) | (F.col("regressed") + F.col("new") > 0))


def watch_due(watch: DataFrame, running: DataFrame, now: Column) -> DataFrame:
    """watch(url, interval_days, last_run) that are due at ``now`` and for which no job of running(url) is under way."""
    key = U.norm_site_path(F.col("url"))
    busy = running.select(key.alias("_key")).distinct()
    due = F.col("last_run").isNull() | (F.unix_micros(now) - F.unix_micros(F.col("last_run").cast("timestamp")) > F.col("interval_days") * F.lit(86_400_000_000))
    return watch.where(due).withColumn("_key", key).join(dealt(busy), "_key", "left_anti").drop("_key")


def cross_check(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(audit_id, dim, kind, ours, theirs, agree) of verdicts (audit_id, dim, verdict), without those that are n/a."""
    kind = F.when(F.col("dim").isin(*FACT_DIMS), "fact").otherwise("criteria")
    a = ours.where("verdict <> 'n/a'").select("audit_id", "dim", F.col("verdict").alias("ours"))
    b = theirs.where("verdict <> 'n/a'").select("audit_id", "dim", F.col("verdict").alias("theirs"))
    return a.where(F.col("dim").isin(*FACT_DIMS, *CRITERIA_DIMS)).join(dealt(b), ["audit_id", "dim"]).select("audit_id", "dim", kind.alias("kind"), "ours", "theirs", (F.col("ours") == F.col("theirs")).alias("agree"))


def cross_check_summary(rows: DataFrame) -> DataFrame:
    """(audit_id, facts, fact_agree, fact_pct, mismatches, flag)."""
    fact = F.col("kind") == "fact"
    g = rows.groupBy("audit_id").agg(F.count_if(fact).alias("facts"), F.count_if(fact & F.col("agree")).alias("fact_agree"), F.sort_array(F.collect_list(F.when(fact & ~F.col("agree"), F.concat("dim", F.lit("(ours:"), "ours", F.lit("/theirs:"), "theirs", F.lit(")"))))).alias("mismatches"))
    return g.select("*", F.when(F.col("facts") > 0, js_round(F.col("fact_agree") / F.col("facts") * 100)).alias("fact_pct"), (F.size("mismatches") > 0).alias("flag"))


def confusion_matrix(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, tp, fp, fn, tn, and precision, recall, fpr, fnr in percent to one place (null for 0/0); a failing verdict is positive."""
    o, t = F.col("ours") == "fail", F.col("theirs") == "fail"
    cells = {"tp": o & t, "fp": o & ~t, "fn": ~o & t, "tn": ~o & ~t}
    g = rows.where("kind = 'fact'").groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    pct = lambda a, b: F.when(F.col(a) + F.col(b) > 0, js_round(F.col(a) / (F.col(a) + F.col(b)) * 1000) / 10)
    return g.select("*", pct("tp", "fp").alias("precision"), pct("tp", "fn").alias("recall"), pct("fp", "tn").alias("fpr"), pct("fn", "tp").alias("fnr"))


def priority(severity: Column, status: Column) -> Column:
    """1 urgent to 4 low."""
    return F.when((severity == "high") & (status == "fail"), 1).when(((severity == "high") & (status == "warn")) | ((severity == "med") & (status == "fail")), 2).when((severity == "med") & (status == "warn"), 3).otherwise(4)


def due_days(severity: Column, status: Column) -> Column:
    return case(priority(severity, status), {1: 3, 2: 7, 3: 14}, 30)


def effective_rank(severity: Column, status: Column) -> Column:
    """0 to 2: the severity, one step less for a warning."""
    return F.least(case(severity, {"high": 0, "med": 1, "low": 2}, 3) + (status == "warn").cast("int"), F.lit(2))


def work_items(checks: DataFrame, top: DataFrame) -> DataFrame:
    """(audit_id, rank, id, priority, due_days, is_top, group, team, issue_key) of each issue, in the order of work.

    top(audit_id, id) are the priorities that an analysis named; they move up by one.
    """
    marked = top.select("audit_id", "id", F.lit(True).alias("is_top")).distinct()
    rows = checks.where(bad(F.col("status"))).join(dealt(marked), ["audit_id", "id"], "left").withColumn("is_top", F.coalesce("is_top", F.lit(False)))
    base = priority(F.col("severity"), F.col("status"))
    rows = rows.withColumns({"priority": F.when(F.col("is_top") & (base > 1), base - 1).otherwise(base), "due_days": due_days(F.col("severity"), F.col("status"))})
    sev = case(F.col("severity"), {"high": 0, "med": 1, "low": 2}, 3)
    order = W.partitionBy("audit_id").orderBy("priority", F.desc("is_top"), (F.col("status") != "fail"), sev, "emit_ord", "id")
    group, team = F.lit("SEO"), F.lit("SEO")
    for k, (g, t) in GROUPS.items():
        group, team = F.when(F.col("category") == k, g).otherwise(group), F.when(F.col("category") == k, t).otherwise(team)
    return rows.select("audit_id", F.row_number().over(order).alias("rank"), "id", "priority", "due_days", "is_top", group.alias("group"), team.alias("team"), F.concat_ws(":", "audit_id", "id").alias("issue_key"))


def top_issues(checks: DataFrame, k: int = 5) -> DataFrame:
    """The k issues of each audit with the least effective rank, in the order of reports."""
    rows = checks.where(bad(F.col("status"))).withColumn("effective", effective_rank(F.col("severity"), F.col("status")))
    w = W.partitionBy("audit_id").orderBy("effective", "emit_ord", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("audit_id", "rank", "id", "effective")


def guardrail(named: DataFrame, checks: DataFrame) -> DataFrame:
    """named(audit_id, rank, id) with fate (kept, unknown, non_issue) and, of what is kept, its new rank."""
    known = checks.select("audit_id", "id", bad(F.col("status")).alias("issue"))
    rows = named.join(dealt(known), ["audit_id", "id"], "left").withColumn("fate", F.when(F.col("issue").isNull(), "unknown").when(F.col("issue"), "kept").otherwise("non_issue"))
    w = W.partitionBy("audit_id", "fate").orderBy("rank")
    return rows.select("audit_id", "id", "rank", "fate", F.when(F.col("fate") == "kept", F.row_number().over(w)).alias("new_rank"))


def flag_profile(checks: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One row for each audit with the states of the named checks as columns."""
    return checks.groupBy("audit_id").agg(*[F.max(F.when(F.col("id") == id_, F.col("status"))).alias(name) for name, id_ in flags.items()])


def verdict(ours: Column, theirs: Column) -> Column:
    """win, lose or tie by rank of state; – when one side is missing."""
    rank = lambda c: case(c, {"pass": 0, "info": 1, "warn": 2, "fail": 3}, 4)
    return F.when(ours.isNull() | theirs.isNull(), "–").when(rank(ours) < rank(theirs), "win").when(rank(ours) > rank(theirs), "lose").otherwise("tie")


def reaudit_step(links: DataFrame, subtasks: DataFrame, checks: DataFrame) -> DataFrame:
    """(parent_id, old_state, new_state, done, total, reopened) after a look at the tasks and the fresh audit.

    links(parent_id, audit_id, state); subtasks(parent_id, name, id nullable, done); a subtask without
    a check id is looked up by name.
    """
    open_ = links.where(F.col("state").isin("awaiting_fixes", "needs_more_work"))
    still = checks.where(bad(F.col("status"))).select("audit_id", F.col("id").alias("bad_id"), "title")
    each = open_.join(subtasks, "parent_id", "left")
    hit = each.join(still.select("audit_id", "bad_id"), (each["audit_id"] == still["audit_id"]) & (each["id"] == still["bad_id"]), "left").drop(still["audit_id"])
    names = still.select(F.col("audit_id").alias("n_audit"), F.col("title").alias("n_title")).distinct()
    hit = hit.join(names, (hit["audit_id"] == F.col("n_audit")) & (hit["name"] == F.col("n_title")), "left")
    broken = F.when(F.col("id").isNotNull(), F.col("bad_id").isNotNull()).otherwise(F.col("n_title").isNotNull())
    g = hit.groupBy("parent_id", F.col("state").alias("old_state")).agg(F.count("name").alias("total"), F.count_if("done").alias("done"), F.count_if(broken & F.col("name").isNotNull()).alias("broken"))
    ready = (F.col("total") > 0) & (F.col("done") == F.col("total"))
    state = F.when(~ready, F.col("old_state")).when(F.col("broken") > 0, "needs_more_work").otherwise("passed")
    return g.select("parent_id", "old_state", state.alias("new_state"), "done", "total", F.when(ready, F.col("broken")).otherwise(0).alias("reopened"))
