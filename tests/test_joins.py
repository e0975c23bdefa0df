"""Tables that grow with the input are not broadcast, however small their files are."""

import pytest
from conftest import SF

from pagewarden.operators import joins
from pagewarden.plans import queries, repairs

DEALT = ("audit_delta", "score_drop_alerts", "category_delta", "competitor_categories", "work_items", "guardrail_partition", "site_comparison")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", DEALT)
def test_sides_that_grow_are_dealt(spark, name):
    assert "BroadcastExchange" not in plan(queries.queries()[name](spark, SF))


def test_item_rows_are_dealt(spark):
    assert "BroadcastExchange" not in plan(repairs._item_rows(spark, SF))


def test_rows_among_keys_are_told_before_they_move(spark):
    """Only rows that the filter lets pass come to the join; those it lets pass wrongly are told by the join."""
    rows = spark.createDataFrame([("s" if k % 2 else None, k) for k in range(400)], "site_id string, page_ord int")
    keys = spark.createDataFrame([("s", 7), ("s", 9), ("t", 11), ("s", 7000)], "site_id string, page_ord long")
    found = joins.among(rows, keys, ["site_id", "page_ord"])
    assert sorted(tuple(r) for r in found.collect()) == [("s", 7), ("s", 9)]
    assert "_bits" in plan(found)
