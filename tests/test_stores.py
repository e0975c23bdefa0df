import itertools
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import linkgraph as L
from pagewarden.sources.records import sitemap_pages, typed_documents
from pagewarden.statetable import StateTable, newer
from pagewarden.storage import materialize
from pagewarden.streaming.sinks import upsert_stream


def persist(df):
    return materialize(df, "test")


def slow_crawl(start, links, budget, params):
    """One site, page by page."""
    depth = lambda u: len([s for s in u.split("?")[0].split("/")[3:] if s])
    known, queue, taken, asked = set(), [], [], {}

    def find(urls):
        for u in sorted(urls):
            if u in known:
                continue
            path = u.split("?")[0]
            if "?" in u:
                if params is not None and asked.get(path, 0) >= params:
                    continue
                asked[path] = asked.get(path, 0) + 1
            known.add(u)
            queue.append(u)

    find([start])
    for level in itertools.count(1):
        if not queue or len(taken) >= budget:
            return sorted(taken)
        least = min(map(depth, queue))
        now = sorted(u for u in queue if depth(u) == least)[: budget - len(taken)]
        queue = [u for u in queue if u not in now]
        taken += [(u, depth(u), level) for u in now]
        find({t for u, t in links if u in now})


@pytest.mark.parametrize("budget, params", [(1, None), (7, None), (25, 2), (1000, 1)])
def test_crawls_with_a_budget(spark, budget, params):
    rng = random.Random(budget)
    base = "https://x.example"
    urls = [base + "/" + "/".join(rng.choices("abc", k=rng.randint(0, 3))) + rng.choice(["", "", f"?q={k}"]) for k in range(60)]
    links = [(rng.choice(urls[:30]), rng.choice(urls)) for _ in range(150)] + [(urls[0], urls[k]) for k in range(1, 4)]
    rows = [(s, a, b) for s in ("one", "two") for a, b in links] + [("one", urls[0], None)]
    start = spark.createDataFrame([("one", urls[0]), ("two", urls[0]), ("one", urls[0])], "site_id string, url string")
    out = L.bfs_crawl(start, spark.createDataFrame(rows, "site_id string, url string, target string"), budget, persist, params).collect()
    for site in ("one", "two"):
        assert sorted((r.url, r.depth, r.level) for r in out if r.site_id == site) == slow_crawl(urls[0], links, budget, params)


def test_a_crawl_without_levels(spark):
    """A site whose budget lasts takes all that it reaches, in steps that a long path does not multiply."""
    at = lambda k: f"https://x.example/{k % 3}/{k}"
    way = [(at(k), at(k + step)) for k in range(120) for step in (1, 2)] + [(at(k), at(k) + "?dead") for k in range(120)] + [(at(900), at(901))]
    links = spark.createDataFrame([(s, a, b) for s in ("one", "two") for a, b in way] + [("small", at(0), at(1)), ("small", at(0), None)], "site_id string, url string, target string")
    start = spark.createDataFrame([(s, at(0)) for s in ("one", "two", "small", "alone")], "site_id string, url string")
    written = []

    def count(df):
        written.append(1)
        return persist(df)

    out = L.bfs_crawl(start, links, 1000, count, levels=False).collect()
    for site, n in (("one", 242), ("two", 242), ("small", 2), ("alone", 1)):
        mine = {(r.url, r.depth) for r in out if r.site_id == site}
        assert len(mine) == sum(r.site_id == site for r in out) == n
        assert all(d == 2 for _, d in mine)
    assert len(written) < 150
    first = [link for link in way if link[0] == at(0)]
    less = L.bfs_crawl(start, spark.createDataFrame([("one", a, b) for a, b in first] + [("two", at(0), at(1))], "site_id string, url string, target string"), 3, persist, levels=False).collect()
    assert sorted(r.url for r in less if r.site_id == "one") == [u for u, _, _ in slow_crawl(at(0), first, 3, None)]
    assert sorted(r.url for r in less if r.site_id == "two") == [at(0), at(1)]


def test_redirects(spark):
    chain = [(f"c{k}", 301, f"c{k + 1}") for k in range(40)] + [("c40", 200, None)]
    ring = [("r0", 302, "r1"), ("r1", 302, "r2"), ("r2", 302, "r0"), ("to-ring", 301, "r1"), ("self", 301, "self")]
    other = [("lost", 308, "nowhere"), ("stuck", 301, None), ("to-stuck", 301, "stuck"), ("gone", 404, "ignored"), ("never", None, "c0"), *[(f"hot{k}", 301, "c33") for k in range(20)]]
    df = spark.createDataFrame(chain + ring + other, "url string, status int, location string")
    out = {r.url: (r.hops, r.final_url, r.status, r.outcome) for r in L.redirect_outcomes(df, persist).collect()}
    assert len(out) == df.count()
    for k in range(41):
        assert out[f"c{k}"] == (40 - k, "c40", 200, "too_many" if 40 - k > 8 else "ok")
    assert {u for u, o in out.items() if o == (None, None, None, "loop")} == {"r0", "r1", "r2", "to-ring", "self"}
    assert out["lost"] == (1, "nowhere", None, "unknown") and out["stuck"] == (0, "stuck", 301, "no_location") and out["to-stuck"] == (1, "stuck", 301, "no_location")
    assert out["gone"] == (0, "gone", 404, "ok") and out["hot3"] == (8, "c40", 200, "ok")
    assert L.redirect_outcomes(df.limit(0), persist).count() == 0


def merge(column):
    return F.coalesce(F.col("old.n"), F.lit(0)) + F.coalesce(F.col("new.n"), F.lit(0)) if column == "n" else newer(column, "at")


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    state = StateTable(spark, f"file://{tmp_path}/state", ["k", "j"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, j int, at int, what string, n int")
    assert state.read() is None
    assert state.upsert(batch(("a", 1, 5, "x", 1), ("a", 1, 7, "y", 1), (None, 2, 1, "z", 1)), 3, merge, ["at"])
    assert not state.upsert(batch(("a", 1, 9, "never", 1)), 3, merge, ["at"]) and not state.upsert(batch(("a", 1, 9, "never", 1)), 2, merge, ["at"])
    assert state.upsert(batch(("a", 1, 6, "late", 10), (None, 2, 4, None, 10), ("b", None, 1, "new", 10)), 4, merge, ["at"])
    want = {("a", 1, 7, "y", 11), (None, 2, 4, None, 11), ("b", None, 1, "new", 10)}
    assert {(r.k, r.j, r.at, r.what, r.n) for r in state.read().collect()} == want
    assert state.upsert(batch(), 5, merge, ["at"]) and {tuple(r[c] for c in ("k", "j", "at", "what", "n")) for r in state.read().collect()} == want
    assert state.versions() == [4, 5]


def test_a_lost_commit_merges_nothing_twice(spark, tmp_path):
    """The stream's last batch runs again after its commit is lost; a batch that breaks halfway leaves no version."""
    schema = "k string, at int, n int"
    for part in range(4):
        spark.createDataFrame([("a", part, 1), (f"p{part}", part, 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state = StateTable(spark, f"file://{tmp_path}/state", ["k"])
    run = lambda: upsert_stream(stream(), state, merge, ["at"], f"{tmp_path}/check").awaitTermination()
    run()
    want = {("a", 4), *[(f"p{k}", 1) for k in range(4)]}
    assert {(r.k, r.n) for r in state.read().collect()} == want and state.versions()[-1] == 3
    for name in ("3", ".3.crc"):
        os.remove(f"{tmp_path}/check/commits/{name}")
    run()
    assert {(r.k, r.n) for r in state.read().collect()} == want
    shutil.copytree(f"{tmp_path}/state/batch=000000000003", f"{tmp_path}/state/.broken")
    run()
    assert {(r.k, r.n) for r in state.read().collect()} == want


def test_sitemaps_that_name_themselves_end(spark):
    entry = lambda *locs: "".join(f"<loc>{u}</loc>" for u in locs)
    maps = [("i", f"<sitemapindex>{entry('i', 'j', 'm', 'gone')}"), ("j", f"<sitemapindex>{entry('i', 'k')}"), ("k", f"<sitemapindex>{entry('j', 'deep')}"), ("m", f"<urlset>{entry('p?a=1&amp;b=2', 'q')}"), ("deep", f"<urlset><lastmod>1{entry('q', 'r')}"), ("m", "<urlset>")][:5]
    sites = [("s", "i"), ("t", "m"), ("u", "none"), ("s", "i")]
    out = sitemap_pages(spark.createDataFrame(maps, "url string, xml string"), spark.createDataFrame(sites, "site_id string, url string"), persist).collect()
    assert sorted(tuple(r) for r in out) == [("s", "p?a=1&b=2", False, 2), ("s", "q", True, 2), ("s", "r", True, 4), ("t", "p?a=1&b=2", False, 1), ("t", "q", False, 1)]
    assert sitemap_pages(spark.createDataFrame([], "url string, xml string"), spark.createDataFrame([], "site_id string, url string"), persist).count() == 0


def test_documents_by_version(spark):
    docs = ['{"k": 1}', '{"version": 2, "m": {"k": "7"}, "t": [1, "x"]}', '{"version": 9}', "{", "[1]", None, '{"k": "no number"}', '{"version": "2"}']
    versions = {1: {"k": ("$.k", "long"), "t": (None, "array<string>")}, 2: {"k": ("$.m.k", "long"), "t": ("$.t", "array<string>")}}
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    out = [(r.version, r.k, r.t, r.fault) for r in typed_documents(df, "doc", versions).orderBy("i").collect()]
    bad = (None, None, None, "unreadable")
    assert out == [(1, 1, None, None), (2, 7, ["1", "x"], None), (9, None, None, "unknown_version"), bad, bad, bad, (1, None, None, None), (2, None, None, None)]
