"""Severity-weighted scores of categories and sites, grades, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round
from .joins import dealt

# Weights of severities, penalties of states, weights of categories; another category weighs 5.
SEVERITY = {"high": 10, "med": 5, "low": 2}
PENALTY = {"fail": 1.0, "warn": 0.45, "pass": 0.0}
CATEGORY = {"onpage": 18, "index": 20, "schema": 12, "links": 8, "images": 5, "performance": 10, "security": 5, "rendering": 12, "geo": 10}
OTHER_CATEGORY = 5
# Least score of each grade; F below the last.
GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 45))


def case(value: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def category_scores(checks: DataFrame, *keys: str) -> DataFrame:
    """keys, category, score: 100 less the share of the weight that is lost; findings of state info do not count."""
    w = case(F.col("severity"), SEVERITY, 2)
    lost = w * case(F.col("status"), PENALTY, 0.0)
    rated = checks.where("status <> 'info'").groupBy(*keys, "category").agg(F.sum(w).alias("w"), F.sum(lost).alias("l"))
    return rated.select(*keys, "category", js_round((1 - F.col("l") / F.col("w")) * 100).cast("int").alias("score"))


def site_scores(checks: DataFrame, *keys: str) -> DataFrame:
    """keys, overall, grade, fails, warns, passes.  Categories that are not there do not count."""
    w = case(F.col("category"), CATEGORY, OTHER_CATEGORY)
    overall = category_scores(checks, *keys).groupBy(*keys).agg(js_round(F.sum(F.col("score") * w) / F.sum(w)).cast("int").alias("overall"))
    counts = checks.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("fail", "fails"), ("warn", "warns"), ("pass", "passes"))])
    rows = counts.join(dealt(overall), list(keys), "left").withColumn("overall", F.coalesce("overall", F.lit(0)))
    return rows.select(*keys, "overall", grade(F.col("overall")).alias("grade"), "fails", "warns", "passes")
