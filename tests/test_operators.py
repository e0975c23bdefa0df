from pyspark.sql import functions as F

from pagewarden.operators import audits as A
from pagewarden.operators import discovery as D
from pagewarden.operators import linkgraph as L
from pagewarden.operators import robots as R
from pagewarden.storage import materialize


def test_robots_groups(spark):
    text = "User-agent: A\nUser-agent: B # two names\nDisallow: /x\nAllow: /x/y\n\nuser-AGENT: *\ndisallow: /*.pdf$\nDisallow:\nNoise: 1\nUser-agent: C\n"
    df = spark.createDataFrame([("s", text), ("empty", "")], "site_id string, robots_txt string")
    rules = R.parse_robots(df)
    got = sorted((r.group_ord, tuple(r.agents), r.type or "", r.path or "") for r in rules.collect())
    assert got == [(1, ("a", "b"), "allow", "/x/y"), (1, ("a", "b"), "disallow", "/x"), (2, ("*",), "disallow", ""), (2, ("*",), "disallow", "/*.pdf$"), (3, ("c",), "", "")]
    paths = spark.createDataFrame([("s", "/x/y/z"), ("s", "/x"), ("s", "/a.pdf"), ("s", "/a.pdf$"), ("empty", "/x")], "site_id string, path string")
    out = {(r.site_id, r.ua, r.path): r.allowed for r in R.access(rules, paths, ("xA-bot", "other")).collect()}
    assert out[("s", "xA-bot", "/x/y/z")] and not out[("s", "xA-bot", "/x")] and out[("s", "xA-bot", "/a.pdf")]
    assert out[("s", "other", "/x")] and out[("s", "other", "/a.pdf")] and not out[("s", "other", "/a.pdf$")]  # $ is only itself
    assert out[("empty", "other", "/x")]


def test_crawl_order_and_budget(spark):
    base = "https://s.io"
    links = [("/", "/a/b"), ("/", "/z"), ("/", "/c"), ("/c", "/d"), ("/a/b", "/"), ("/z", "/a/b/c"), ("/d", None)]
    df = spark.createDataFrame([("s", base + a, base + b if b else None) for a, b in links], "site_id string, url string, target string")
    start = spark.createDataFrame([("s", base + "/")], "site_id string, url string")
    persist = lambda d: materialize(d, "crawl")
    out = L.bfs_crawl(start, df, 4, persist).select("level", "url").collect()
    # The root, then paths of one segment in order (also /d, found on the way), before deeper ones.
    assert sorted((r.level, r.url[len(base) :]) for r in out) == [(1, "/"), (2, "/c"), (2, "/z"), (3, "/d")]
    assert L.bfs_crawl(start, df, 99, persist).count() == 6


def test_reaudit_falls_back_to_names(spark):
    links = spark.createDataFrame([(1, 7, "awaiting_fixes"), (2, 7, "needs_more_work"), (3, 7, "passed"), (4, 7, "awaiting_fixes")], "parent_id long, audit_id long, state string")
    tasks = spark.createDataFrame([(1, "Fix title", "title-missing", True), (1, "Add alt", None, True), (2, "Fine", "https", True), (4, "Open", "https", False)], "parent_id long, name string, id string, done boolean")
    checks = spark.createDataFrame([(7, "title-missing", "pass", "Fix title"), (7, "img-alt", "warn", "Add alt"), (7, "https", "pass", "Fine")], "audit_id long, id string, status string, title string")
    out = {r.parent_id: (r.new_state, r.reopened) for r in A.reaudit_step(links, tasks, checks).collect()}
    assert out == {1: ("needs_more_work", 1), 2: ("passed", 0), 4: ("awaiting_fixes", 0)}


def test_picks_are_merged(spark):
    live = spark.createDataFrame([("me", "a.io", 40), ("me", "b.io", 24), ("me", "c.io", 25), ("me", "d.io", 90)], "own string, domain string, score int")
    picked = spark.createDataFrame([("me", "b.io", 0), ("me", "gone.io", 1), ("me", "a.io", 2)], "own string, domain string, ord int")
    assert [r.domain for r in D.merge_picks(live, picked).orderBy("rank").collect()] == ["b.io", "a.io", "d.io", "c.io"]


def test_admission(spark):
    rows = [("www.shoestore.com", "shoestore.com", False), ("www.shoestore.com", "shoestore-thai.com", False), ("www.shoestore.com", "facebook.com", False), ("www.shoestore.com", "boots.co.th", True)]
    df = spark.createDataFrame(rows, "own string, domain string, want boolean")
    out = df.select("want", D.admitted(F.col("own"), F.col("domain"), F.col("domain")).alias("got")).collect()
    assert all(r.want == r.got for r in out)
    assert spark.range(1).select(D.relevant(F.lit("buy red shoes"), F.lit("RED things"), F.lit("http://x")).alias("x")).first().x


def test_fallbacks(spark):
    fresh = spark.createDataFrame([("a", 1)], "k string, v int")
    cached = spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, D.cached_or_fresh(fresh, cached, "k").collect())) == [("a", 1), ("b", 2)]


def test_delta_reasons(spark):
    audits = spark.createDataFrame([(1, "s", "http://s/", "2026-01-01", 14, 20, 50, False), (2, "s", "https://www.s", "2026-01-02", 14, 21, 60, False), (3, "s", "http://s", "2026-01-03", 15, 21, 60, False), (4, "s", "http://s", "2026-01-04", 15, 40, 60, False)], "audit_id long, site_id string, url string, created_at string, engine_version int, pages_analyzed int, overall int, render_failed boolean")
    checks = [(1, "a", "fail"), (2, "a", "warn"), (1, "gone", "fail"), (2, "compression", "warn"), (1, "compression", "pass"), (2, "fresh", "fail"), (3, "a", "fail"), (3, "fresh", "fail"), (3, "new3", "warn"), (4, "a", "pass"), (4, "ok", "pass")]
    out = {(r.audit_id, r.id): (r.change, r.reason) for r in A.audit_delta(audits, spark.createDataFrame(checks, "audit_id long, id string, status string")).collect()}
    assert out == {(2, "a"): ("fixed", None), (2, "compression"): ("explained", "unstable"), (2, "fresh"): ("new", None), (3, "a"): ("regressed", None), (3, "new3"): ("explained", "engine"), (4, "a"): ("explained", "scope")}
