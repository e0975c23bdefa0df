import json

from pyspark.sql import functions as F

from pagewarden.functions import formats as M
from pagewarden.functions import urls as U
from pagewarden.operators import fixes as X
from pagewarden.sources import records as S


def test_nested_sitemaps(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in u) + "</sitemapindex>"
    urls = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    maps = [("i", index("a", "j", *[f"m{k}" for k in range(20)])), ("a", urls("p1", "p2", "p1")), ("j", index("b")), ("b", "<urlset><url><loc>p3</loc><lastmod>x</lastmod></url></urlset>"), ("m12", urls("late")), ("solo", urls("q"))]
    df = spark.createDataFrame(maps, "url string, xml string")
    roots = spark.createDataFrame([("s", "i"), ("t", "solo"), ("u", "missing")], "site_id string, url string")
    out = sorted(map(tuple, S.sitemap_urls(df, roots).collect()))
    assert out == [("s", "p1", False), ("s", "p2", False), ("s", "p3", True), ("t", "q", False)]


def test_soft_404_of_llms_txt(spark):
    df = spark.createDataFrame([("# Site\n",), (" <!DOCTYPE html><html>",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(S.llms_txt(F.col("t")).alias("x")).collect()] == ["# Site\n", None, None, None]


def test_pagespeed_and_lighthouse(spark):
    audits = {"largest-contentful-paint": {"numericValue": 2500.5, "score": 0.5}, "x": {"title": "Less script", "numericValue": 900.4, "details": {"type": "opportunity"}}, "y": {"title": "small", "numericValue": 100, "details": {"type": "opportunity"}}, "document-title": {"score": 1}, "image-alt": {"score": 0}, "hreflang": {"score": None}}
    doc = json.dumps({"lighthouseResult": {"audits": audits, "categories": {"performance": {"score": 0.815}}}, "loadingExperience": {"overall_category": "FAST", "metrics": {"INTERACTION_TO_NEXT_PAINT": {"percentile": 150}}}})
    r = S.pagespeed(spark.createDataFrame([("s", doc)], "site_id string, json string")).first()
    assert (r.psi.ok, r.psi.perf_score, r.psi.overall, r.lcp_ms, r.field_inp_ms) == (True, 82, "FAST", 2500.5, 150.0)
    assert [(o.title, o.saving_ms) for o in r.opportunities] == [("Less script", 900)]
    assert not S.pagespeed(spark.createDataFrame([("s", "oops"), ("t", None)], "site_id string, json string")).where("psi.ok").count()
    v = {x.dim: x.verdict for x in S.lighthouse(spark.createDataFrame([(1, doc)], "audit_id long, json string")).collect()}
    assert v["title"] == "pass" and v["imageAlt"] == "fail" and v["hreflang"] == v["canonical"] == "n/a"


def test_stored_audits(spark, tmp_path):
    old = {"id": "a", "url": "http://s/", "createdAt": "2026-01-01T00:00:00.000Z", "score": {"overall": 50, "grade": "D", "categoryScores": {"geo": 40}}, "checks": [{"id": "https", "category": "security", "severity": "high", "status": "pass"}], "extra": 1}
    (tmp_path / "a.json").write_text(json.dumps(old, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(old | {"id": "b", "engineVersion": 14, "createdAt": "2026-01-02T00:00:00.000Z"}))
    a, c, k = S.audit_tables(S.stored_audits(spark, str(tmp_path)))
    assert sorted((r.audit_id, r.engine_version, r.created_at.day) for r in a.collect()) == [("a", None, 1), ("b", 14, 2)]
    assert c.count() == 2 and sorted(map(tuple, k.collect())) == [("a", "geo", 40), ("b", "geo", 40)]


def test_formats(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    assert one(M.retry_after_ms(F.lit("3"), now)) == 3000
    assert one(M.retry_after_ms(F.lit("Thu, 01 Jan 2026 00:01:00 GMT"), now)) == 60_000
    assert one(M.retry_after_ms(F.lit("soon"), now)) == 0 and one(M.retry_after_ms(F.lit(None).cast("string"), now)) == 0
    assert [one(M.duration(F.lit(x).cast("double"))) for x in (1234.0, 99.5, None)] == ["1.2s", "100ms", "–"]
    assert one(M.copy_minutes(F.lit(4))) == 15 and one(M.copy_minutes(F.lit(31))) == 47
    assert one(F.to_json(M.json_object(F.lit('sure: {"a": 1} ok?')))) == '{"a":1}' and one(M.json_object(F.lit("none"))) is None
    assert one(M.strip_emoji(F.lit("\U0001f680 go"))) == "go"
    assert one(M.no_numeric_claims(F.lit("grow 30% - 50% soon"))) == "grow – soon"
    assert M.search_phrases("AcmeWare | Running shoes for everyone", "AcmeWare sells, running shoes, hiking boots and sandals", "Best running shoes", "www.acmeware.com") == ["running shoes hiking boots and sandals", "Best running shoes", "Running shoes for everyone"]


def test_page_kinds(spark):
    rows = [("https://s/", "home"), ("https://s/th/", "home"), ("https://s/en/contact/", "contact"), ("https://s/blog", "bloglist"), ("https://s/blog/x", "article"), ("https://s/x", "other"), ("nothing", "other")]
    df = spark.createDataFrame(rows, "u string, want string")
    assert all(r.want == r.got for r in df.select("want", U.page_type(F.col("u")).alias("got")).collect())
    assert [tuple(c) for c in df.select(U.breadcrumbs(F.lit("https://s/th/our-team/FAQ_page/")).alias("b")).first().b] == [(1, "Home", "https://s/"), (2, "Our Team", "https://s/th/our-team"), (3, "FAQ Page", "https://s/th/our-team/FAQ_page")]
    assert len(df.select(U.origin_variants(F.lit("https://www.s.io/x")).alias("v")).first().v) == 3


def test_generated_robots(spark):
    text = spark.range(1).select(X.robots_file(F.lit("https://s"), F.array(F.lit("https://s/m.xml"), F.lit("https://s/m.xml"))).alias("t")).first().t
    assert text.startswith("User-agent: *\nDisallow: /admin/") and text.count("Sitemap: ") == 1 and "User-agent: GPTBot\nAllow: /" in text
