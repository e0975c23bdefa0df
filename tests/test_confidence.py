from pyspark.sql import functions as F

from pagewarden.operators import confidence as C


def test_agreement(spark):
    checks = spark.createDataFrame([(1, "title-missing", "onpage"), (1, "img-alt", "images"), (1, "geo-eeat", "geo"), (2, "title-missing", "onpage"), (2, "made-up", "schema"), (2, "other", "onpage")], "audit_id long, id string, category string")
    verified = spark.createDataFrame([(1, "title", True), (1, "imageAlt", False)], "audit_id long, dim string, agree boolean")
    out = C.annotate(checks, verified)
    got = {(r.audit_id, r.id): (r.type, r.sure, r.needs_verify) for r in out.collect()}
    assert got == {(1, "title-missing"): ("deterministic", 99, False), (1, "img-alt"): ("rule", 50, True), (1, "geo-eeat"): ("ai", 65, False), (2, "title-missing"): ("deterministic", 97, False), (2, "made-up"): ("deterministic", 97, False), (2, "other"): ("rule", 88, False)}
    assert {tuple(r) for r in C.type_counts(out).collect()} == {(1, 1, 1, 1, 1), (2, 2, 1, 0, 0)}


def test_places(spark):
    html = "<html>\n<h1>a</h1>\n<h1 class=x>b</h1>"
    df = spark.createDataFrame([(html,)], "h string")
    r = df.select(C.locate(F.col("h"), r"<h1[^>]*>").alias("x"), C.locate(F.col("h"), "<table").alias("y")).first()
    assert (r.x["count"], r.x.snippet, r.x.line) == (2, "<h1>", 2) and (r.y["count"], r.y.line) == (0, None)
    m = df.select(C.explain_mismatch(F.lit("title(ours:pass/theirs:fail)")).alias("m"), C.page_of_label(F.lit("https://x/ (3 images)")).alias("p")).first()
    assert tuple(m.m) == ("title", "pass", "fail") and m.p == "https://x/"
