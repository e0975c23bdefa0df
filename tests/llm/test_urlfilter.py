from pyspark.sql import functions as F

from pagewarden.llm import urlfilter as u

PAGES = [
    (1, "https://a.example.com/en/7x?utm_source=z"), (2, "HTTP://WWW.Example.COM/en/8/"), (3, "https://example.org/es/#top"), (4, None), (5, "no scheme"), (6, "http://shop.example.net/de/89"), (7, "http://example.net/de/7"),
    (8, "http://host?x=://y/z"), (9, "https://Ünï.de/Pfad?b=2&a=1&ref=q"), (9, "https://Ünï.de/Pfad/?a=1&b=2"), (None, "https://com/en/"), (10, "x://h/p\nq?r"), (11, "https://notexample.com/en/7"), (12, ""),
]


def slow(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end]


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_list_against_brute_force(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, x in PAGES], "page_id long, url string, listed string")
    listed = spark.createDataFrame([("Ünï.de/Pfad?a=1&b=2",), ("host?x=://y/z",), (None,), ("",)], "canonical string")
    out = u.filter_urls(df, listed).collect()
    assert len(out) == len(PAGES)
    want = []
    for i, x in PAGES:
        host, path = slow(x)
        rule, verdict = slow_rule(host, path)
        hit = (x or "").startswith(("https://Ünï", "http://host"))
        want.append((i or 0, host, path, rule or "", verdict or ("block" if hit else "allow"), hit))
    assert sorted((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict, r.listed) for r in out) == sorted(want)


def test_the_filter_has_no_false_negatives_and_the_join_no_false_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    rows = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("canonical")).union(spark.range(4000).select(F.lit(1).cast("long"), F.lit("k1")))
    out = u.listed_flag(rows, "canonical", keys).groupBy("listed", "bloom_hit").count().collect()
    got = {(r.listed, r.bloom_hit): r["count"] for r in out}
    assert got[(True, True)] == 7000 and (True, False) not in got
    assert got.get((False, True), 0) < 60  # about one in a thousand


def test_large_lists_are_joined_over_salts(spark, monkeypatch):
    from pagewarden.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    rows = spark.range(5000).select("id", F.concat(F.lit("k"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id"))).alias("canonical"), F.lit("x").alias("block"), F.lit("y").alias("key"), F.lit(True).alias("listed"))
    out = u.listed_flag(rows, "canonical", keys)
    assert sorted(out.columns) == ["block", "bloom_hit", "canonical", "id", "key", "listed"]
    assert {(r.listed, r["count"]) for r in out.groupBy("listed").count().collect()} == {(True, 3000), (False, 2000)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "canonical string")
    assert u.filter_urls(df, none).count() == 0
    one = u.filter_urls(spark.createDataFrame([(1, "https://x.io/")], "page_id long, url string"), none).collect()
    assert [r.verdict for r in one] == ["allow"]
