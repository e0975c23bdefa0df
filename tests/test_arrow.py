"""Whole texts reach Python workers in batches that are bounded in rows and bytes."""

import pytest

from pagewarden.operators.glossary import annotate_terms
from pagewarden.sources.head_patch import patch_pages
from pagewarden.sources.html_page import decode_column, parse_pages

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("run", [lambda d: parse_pages(d.select("page_id", "html")), lambda d: annotate_terms(d.select("page_id", "text"), {"a": "b"}), lambda d: patch_pages(d.select("html", "fix")), lambda d: decode_column(d.select("content", "content_type"))])
def test_batches_of_whole_texts_are_small(spark, run):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    try:
        run(spark.createDataFrame([(1, "<p>", "a", {"title": "t"}, b"x", None)], "page_id long, html string, text string, fix struct<title:string>, content binary, content_type string"))
        assert int(spark.conf.get(ROWS)) <= 256
    finally:
        spark.conf.set(ROWS, before)
