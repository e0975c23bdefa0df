"""robots.txt: rules as rows, and which paths a crawler may fetch.

The group of a crawler is the first whose agent is part of its name, else that of ``*``; groups are
not merged.  The longest matching rule decides, and of equal lengths an allow; ``*`` matches any
characters and ``$`` only itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of crawlers that feed answer engines.
AI_BOTS = (
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "PerplexityBot", "Perplexity-User", "Google-Extended", "Bingbot", "CCBot",
    "Applebot-Extended", "meta-externalagent", "Amazonbot", "Bytespider",
)
# Crawlers for which blocked sections count.
SECTION_BOTS = ("GPTBot", "ClaudeBot", "PerplexityBot", "OAI-SearchBot")
SECTION = r"(?i)^/(th|en|blog|product|service|news|article|category|shop)s?/?$"


def parse_robots(robots: DataFrame, text: str = "robots_txt") -> DataFrame:
    """(site_id, group_ord, agents, rule_ord, type, path) of each rule; a group without rules has one row of nulls.

    Consecutive user-agent lines name one group; a line of another kind ends the list of names.
    """
    lines = robots.select("site_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n|\r")).alias("n", "line"))
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    parts = lines.select("site_id", "n", F.lower(F.trim(F.regexp_extract(clean, "^([^:]+):", 1))).alias("field"), F.trim(F.regexp_extract(clean, "^[^:]+:(.*)$", 1)).alias("value"))
    used = parts.where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = W.partitionBy("site_id").orderBy("n")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = used.withColumn("group_ord", F.sum(begins.cast("int")).over(order)).where("group_ord > 0")
    agents = grouped.where("field = 'user-agent'").groupBy("site_id", "group_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.lower("value").alias("a")))), lambda x: x["a"]).alias("agents"))
    rules = grouped.where("field <> 'user-agent'").select("site_id", "group_ord", F.col("n").alias("rule_ord"), F.col("field").alias("type"), F.col("value").alias("path"))
    return agents.join(rules, ["site_id", "group_ord"], "left")


def sitemap_lines(robots: DataFrame, text: str = "robots_txt") -> DataFrame:
    """(site_id, sitemap) of each Sitemap line."""
    return robots.select("site_id", F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("sitemap"))


def rule_pattern(path: Column) -> Column:
    """A rule's path as a pattern: a prefix in which only ``*`` is special."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(path, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")))


def _each(bots) -> Column:
    return F.explode(F.array(*[F.lit(b) for b in bots]))


def chosen_group(rules: DataFrame, bots=AI_BOTS) -> DataFrame:
    """(site_id, ua, group_ord): the group that holds for each crawler on each site that has one."""
    agents = rules.select("site_id", "group_ord", F.explode("agents").alias("agent")).distinct().select("*", _each(bots).alias("ua"))
    fits = agents.where(F.lower("ua").contains(F.col("agent")) | (F.col("agent") == "*"))
    return fits.groupBy("site_id", "ua").agg(F.min(F.struct((F.col("agent") == "*").alias("star"), "group_ord")).alias("g")).select("site_id", "ua", F.col("g.group_ord").alias("group_ord"))


def access(rules: DataFrame, paths: DataFrame, bots=AI_BOTS) -> DataFrame:
    """(site_id, ua, path, allowed) for paths(site_id, path); a site without rules allows everything."""
    asked = paths.select("site_id", "path").distinct().select("*", _each(bots).alias("ua"))
    mine = chosen_group(rules, bots).join(rules.where(F.col("path").isNotNull() & (F.col("path") != "")).select("site_id", "group_ord", "type", F.col("path").alias("rule")), ["site_id", "group_ord"])
    hit = asked.join(mine, ["site_id", "ua"], "left").withColumn("fits", F.regexp_like("path", rule_pattern(F.col("rule"))))
    best = F.max(F.when(F.col("fits"), F.struct(F.length("rule").alias("len"), (F.col("type") == "allow").alias("allow"))))
    return hit.groupBy("site_id", "ua", "path").agg(best.alias("b")).select("site_id", "ua", "path", F.coalesce("b.allow", F.lit(True)).alias("allowed"))
