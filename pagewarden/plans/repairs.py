"""Queries of crawls with a budget, redirects, patched pages, stored state and stored documents, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linkgraph as L
from ..operators.fixes import xml_escape
from ..operators.joins import dealt
from ..sources.head_patch import patch_pages
from ..sources.html_page import parse_pages
from ..sources.records import sitemap_pages, typed_documents
from ..statetable import StateTable, newer
from ..storage import materialize, shared_dir
from ..streaming.sinks import upsert_stream
from . import crawl as C
from .crawl import AUDITS_SQL, CRAWL_SQL, FINDINGS_SQL, LINKS_SQL


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts)


# ---------------------------------------------------------------- patched heads

#: (what page_id % 5 is, part of the HTML, what stands there instead): pages that lack or have what a fix changes.
VARIANTS = (
    (1, "<style>", "<meta name=\"description\" content=\"old\"><meta content='width=device-width, user-scalable=no' name=viewport><style>"),
    (2, "<title>", '<link rel="canonical" href="/old"><title>'),
    (2, "<article>", '<article><IMG SRC="/img/hero.jpg" alt=""><img src="/icon.svg" alt="icon">'),
    (3, "</head>", '<script type="application/ld+json">{"@type": "Thing"}</script></head>'),
    (4, "<title>", "<!-- <title>none</title> --><title>"),
)


def head_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML of all pages with a fix in its head, and what the parser then reads."""
    i, html = F.col("page_id"), F.col("html")
    for k, old, new in VARIANTS:
        html = F.when(i % 5 == k, F.replace(html, F.lit(old), F.lit(new))).otherwise(html)
    n = i.cast("string")
    canonical = F.regexp_extract("url", r"^[^?#]*", 0)
    title = F.concat(F.lit("T"), n, F.lit(' & <b> "|"'))
    fix = F.struct(
        title.alias("title"), F.concat(F.lit('About "'), n, F.lit('" & more')).alias("description"), canonical.alias("canonical"), F.when(i % 3 == 0, "x-y").alias("lang"),
        title.alias("og_title"), F.lit(None).cast("string").alias("og_description"), F.when(i % 2 == 0, F.concat(F.lit("https://i.example/"), n, F.lit(".png"))).alias("og_image"), F.lit("").alias("og_url"), F.lit("summary").alias("twitter_card"),
        F.array(F.lit("{not json"), F.concat(F.lit('{"@type":"WebPage","name":"</x>'), n, F.lit('"}'))).alias("json_ld"), F.array(F.struct(F.lit("hero").alias("key"), F.lit('A "hero"').alias("text"))).alias("alts"),
    )
    done = patch_pages(C.table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"), fix.alias("fix")))
    read = parse_pages(done.withColumn("source", F.col("html")))
    return read.select(
        "page_id", F.length("source").cast("long").alias("chars"), F.sha2("source", 256).alias("sha256"), "title", F.col("metas")["description"].alias("description"), F.col("metas")["viewport"].alias("viewport"), "canonical", F.col("canonical_count").cast("long").alias("canonicals"),
        "lang", F.size("json_ld").cast("long").alias("blocks"),
    )


_HTML = "html"
for _k, _old, _new in VARIANTS:
    _HTML = f"CASE WHEN page_id % 5 = {_k} THEN replace({_HTML}, '{_old}', '{_new.replace(chr(39), chr(39) * 2)}') ELSE {_HTML} END"
HEADS = f"""WITH made AS (
  SELECT page_id, {_HTML} AS html, regexp_extract(url, '^[^?#]*') AS canonical, 'T' || page_id || ' &amp; &lt;b&gt; "|"' AS title, 'T' || page_id || ' &amp; <b> &quot;|&quot;' AS og, 'About &quot;' || page_id || '&quot; &amp; more' AS description FROM pages
), cut AS (
  SELECT *, CASE WHEN page_id % 5 = 4 THEN strpos(html, '--><title>') + 10 ELSE strpos(html, '<title>') + 7 END AS a, page_id % 5 AS v FROM made
), titled AS (
  SELECT *, substr(html, 1, a - 1) || title || substr(html, a - 1 + strpos(substr(html, a), '</title>')) AS h FROM cut
), patched AS (
  SELECT page_id, v, canonical, replace(replace(replace(replace(CASE WHEN page_id % 3 = 0 THEN regexp_replace(h, '<html lang="[^"]*">', '<html lang="x-y">') ELSE h END, '<link rel="canonical" href="/old">', ''),
      'content="old"', 'content="' || description || '"'), '''width=device-width, user-scalable=no''', '"width=device-width"'), '<IMG SRC="/img/hero.jpg" alt="">', '<IMG SRC="/img/hero.jpg" alt="A &quot;hero&quot;">') AS h,
    CASE WHEN v = 1 THEN '' ELSE '<meta name="description" content="' || description || '"><meta name="viewport" content="width=device-width, initial-scale=1">' END
      || '<meta property="og:title" content="' || og || '">' || CASE WHEN page_id % 2 = 0 THEN '<meta property="og:image" content="https://i.example/' || page_id || '.png">' ELSE '' END
      || '<meta name="twitter:card" content="summary"><link rel="canonical" href="' || canonical || '">'
      || CASE WHEN v = 3 THEN '' ELSE '<script type="application/ld+json">{{"@type":"WebPage","name":"<\\/x>' || page_id || '"}}</script>' END AS more
  FROM titled
), whole AS (SELECT *, substr(h, 1, strpos(h, '</head>') - 1) || more || substr(h, strpos(h, '</head>')) AS out FROM patched)
SELECT page_id, CAST(length(out) AS BIGINT) AS chars, sha256(out) AS sha256, 'T' || page_id || ' & <b> "|"' AS title, 'About "' || page_id || '" & more' AS description,
       CASE WHEN v = 1 THEN 'width=device-width' ELSE 'width=device-width, initial-scale=1' END AS viewport, canonical, CAST(1 AS BIGINT) AS canonicals, regexp_extract(out, '<html lang="([^"]*)"', 1) AS lang, CAST(1 AS BIGINT) AS blocks
FROM whole"""


# ---------------------------------------------------------------- crawls and redirects


def budgeted_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each site's first page over the links of the crawl view, with a budget that no site uses up."""
    start = C.crawl(spark, sf_dir).where("page_ord = 1").select("site_id", "url")
    links = C.links(spark, sf_dir).where("internal").select("site_id", "url", "target")
    return L.bfs_crawl(start, links, 1_000_000, lambda df: materialize(df, "crawl"), levels=False)


CRAWLED = f"""WITH RECURSIVE {CRAWL_SQL.strip()}, {LINKS_SQL.strip()}, edges AS MATERIALIZED (SELECT DISTINCT site_id, url, target FROM links WHERE internal AND target IS NOT NULL),
reach(site_id, url) AS (SELECT site_id, url FROM crawl WHERE page_ord = 1 UNION SELECT e.site_id, e.target FROM reach r JOIN edges e ON e.site_id = r.site_id AND e.url = r.url)
SELECT site_id, url, CAST(len(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) AS BIGINT) AS depth FROM reach"""


def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page's address leads: two of three move to another page's, some to an address that nobody asked."""
    p = C.table(spark, sf_dir, "pages").select("page_id")
    at = lambda c: F.concat(F.lit("https://r.example/"), c.cast("string"))
    i = F.col("page_id")
    last = p.agg(F.max("page_id").alias("last"))
    status = F.when((i % 3 != 0) | (i % 40 == 39), F.lit(301) + i % 2).otherwise(F.when(i % 21 == 0, 404).otherwise(200)).cast("int")
    to = F.when(i % 8 < 6, F.when(i > 12, i - 1 - i % 2).otherwise((i + 5) % 13)).when(i % 8 == 6, (i * 5 + 1) % (F.col("last") + 1)).otherwise(F.col("last") + i)
    hops = p.crossJoin(F.broadcast(last)).select(at(i).alias("url"), status.alias("status"), F.when(i % 50 != 1, at(to)).alias("location"))
    return L.redirect_outcomes(materialize(hops, "hops"), lambda df: materialize(df, "redirects"))


REDIRECTS = """WITH RECURSIVE last AS (SELECT max(page_id) AS last FROM pages), hops AS MATERIALIZED (
  SELECT 'https://r.example/' || page_id AS url, CAST(CASE WHEN page_id % 3 <> 0 OR page_id % 40 = 39 THEN 301 + page_id % 2 WHEN page_id % 21 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status,
         CASE WHEN page_id % 50 <> 1 THEN 'https://r.example/' || CASE WHEN page_id % 8 < 6 THEN CASE WHEN page_id > 12 THEN page_id - 1 - page_id % 2 ELSE (page_id + 5) % 13 END
           WHEN page_id % 8 = 6 THEN (page_id * 5 + 1) % (last + 1) ELSE last + page_id END END AS location FROM pages, last
), walk(url, hops, place, seen) AS (
  SELECT url, 0, url, [url] FROM hops
  UNION ALL SELECT w.url, w.hops + 1, h.location, list_append(w.seen, h.location) FROM walk w JOIN hops h ON h.url = w.place
  WHERE h.status BETWEEN 300 AND 399 AND h.location IS NOT NULL AND len(list_distinct(w.seen)) = len(w.seen)
), ends AS (
  SELECT w.*, h.status, h.location, len(list_distinct(seen)) < len(seen) AS again, row_number() OVER (PARTITION BY w.url ORDER BY w.hops DESC) AS k FROM walk w LEFT JOIN hops h ON h.url = w.place
)
SELECT url, CASE WHEN NOT again THEN CAST(hops AS BIGINT) END AS hops, CASE WHEN NOT again THEN place END AS final_url, CASE WHEN NOT again THEN status END AS status,
       CASE WHEN again THEN 'loop' WHEN hops > 8 THEN 'too_many' WHEN status IS NULL THEN 'unknown' WHEN status BETWEEN 300 AND 399 THEN 'no_location' ELSE 'ok' END AS outcome
FROM ends WHERE k = 1"""


#: Pages in one sitemap of the made-up ones.
CHUNK = 3


def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sitemaps made of all pages: index i of a site names itself, its pages' sitemap, and indices 2i + 1 and 2i + 2."""
    p = C.crawl(spark, sf_dir).select("site_id", "url", F.floor((F.col("page_ord") - 1) / CHUNK).alias("i"))
    at = lambda kind, i: F.concat(F.lit("https://"), F.col("site_id"), F.lit(f"/{kind}-"), i.cast("string"), F.lit(".xml"))
    loc = lambda u: F.concat(F.lit("<loc> "), xml_escape(u), F.lit("\n</loc>"))
    chunks = p.groupBy("site_id", "i").agg(F.array_sort(F.collect_list("url")).alias("urls"))  # CHUNK of them
    maps = chunks.select(at("map", F.col("i")).alias("url"), F.concat(F.lit("<urlset>"), F.array_join(F.transform("urls", loc), ""), F.lit("<lastmod>2026</lastmod></urlset>")).alias("xml"))
    index = F.array(at("map", F.col("i")), at("index", F.col("i")), at("index", F.col("i") * 2 + 1), at("index", F.col("i") * 2 + 2), at("index", F.lit(0)))
    indices = chunks.select(at("index", F.col("i")).alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(index, loc), ""), F.lit("</sitemapindex>")).alias("xml"))
    roots = p.select("site_id").distinct().select("site_id", at("index", F.lit(0)).alias("url"))
    return sitemap_pages(materialize(maps.union(indices), "sitemaps"), roots, lambda df: materialize(df, "opened")).select("site_id", "url", "lastmod", "depth")


SITEMAPS = f"""WITH RECURSIVE {CRAWL_SQL.strip()}, p AS MATERIALIZED (SELECT site_id, url, (page_ord - 1) // {CHUNK} AS i FROM crawl), known AS (SELECT DISTINCT site_id, i FROM p),
walk(site_id, i, depth) AS (SELECT DISTINCT site_id, CAST(0 AS BIGINT), 1 FROM p UNION SELECT w.site_id, k.i, w.depth + 1 FROM walk w JOIN known k ON k.site_id = w.site_id AND k.i IN (w.i * 2 + 1, w.i * 2 + 2))
SELECT p.site_id, p.url, TRUE AS lastmod, min(w.depth) + 1 AS depth FROM walk w JOIN p ON p.site_id = w.site_id AND p.i = w.i GROUP BY p.site_id, p.url"""


# ---------------------------------------------------------------- state by key


def _item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding of the audit view as a row of its site's work items: what it says, and when."""
    a = C.audits(spark, sf_dir).select("audit_id", "site_id", "created_at")
    f = C.findings(spark, sf_dir).join(dealt(a), "audit_id")
    return f.select("site_id", "id", "audit_id", F.col("status").isin("fail", "warn").alias("open"), F.col("created_at").alias("changed_at"))


def merge_item(column: str) -> F.Column:
    """A work item is as its latest audit says; it was seen first by the earliest, and ``audits`` counts all."""
    if column == "audits":
        return F.coalesce(F.col("old.audits"), F.lit(0)) + F.coalesce(F.col("new.audits"), F.lit(0))
    if column == "first_audit":
        return F.least("old.first_audit", "new.first_audit")
    return newer(column, "last_audit")


def item_batch(rows: DataFrame) -> DataFrame:
    """The work items of a batch of findings, one row for each site and check."""
    last = F.max_by(F.struct("open", "changed_at"), "audit_id").alias("last")
    g = rows.groupBy("site_id", "id").agg(F.min("audit_id").alias("first_audit"), F.max("audit_id").alias("last_audit"), F.count(F.lit(1)).alias("audits"), last)
    return g.select("site_id", "id", "first_audit", "last_audit", "audits", "last.open", "last.changed_at")


def work_item_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items after two batches of audits, the second of which comes twice."""
    rows = _item_rows(spark, sf_dir)
    state = StateTable(spark, f"{shared_dir(spark)}/pagewarden/items-{uuid.uuid4().hex}", ["site_id", "id"])
    middle = rows.agg(F.max("audit_id")).first()[0] or 0
    for batch, half in ((0, rows.where(F.col("audit_id") * 2 <= middle)), (1, rows.where(F.col("audit_id") * 2 > middle)), (1, rows.where(F.col("audit_id") * 2 > middle))):
        state.upsert(item_batch(half), batch, merge_item, ["last_audit"])
    return state.read()


def streamed_item_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the audits' files, merged by micro-batch."""
    at = f"{shared_dir(spark)}/pagewarden/streamed-{uuid.uuid4().hex}"
    _item_rows(spark, sf_dir).withColumn("part", F.col("audit_id") % 3).write.partitionBy("part").parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    state = StateTable(spark, f"{at}/state", ["site_id", "id"])
    upsert_stream(stream, state, merge_item, ["last_audit"], f"{at}/checkpoint", item_batch).awaitTermination()
    return state.read()


ITEMS = f"""{_with(AUDITS_SQL, FINDINGS_SQL)}, each AS (SELECT a.site_id, f.id, f.audit_id, f.status IN ('fail', 'warn') AS open, a.created_at FROM findings f JOIN audits a ON a.audit_id = f.audit_id)
SELECT site_id, id, min(audit_id) AS first_audit, max(audit_id) AS last_audit, count(*) AS audits, arg_max(open, audit_id) AS open, arg_max(created_at, audit_id) AS changed_at FROM each GROUP BY site_id, id"""


# ---------------------------------------------------------------- stored documents

#: Fields of a stored event by version, as paths of its JSON.
EVENT_VERSIONS = {
    1: {"k": ("$.k", "long"), "value": (None, "double"), "tags": (None, "array<string>")},
    2: {"k": ("$.metrics.k", "long"), "value": ("$.metrics.value", "double"), "tags": ("$.tags", "array<string>")},
}


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of all events in two versions and one that nobody knows; every eleventh is cut short."""
    i = F.col("event_id")
    k = F.regexp_extract("props", r"(\d+)", 1)
    two = F.concat(F.lit('{"version": 2, "metrics": {"k": '), k, F.lit(', "value": '), (i % 100).cast("string"), F.lit('.5}, "tags": ["a", "'), F.col("event_type"), F.lit('"]}'))
    text = F.when(i % 4 == 1, two).when(i % 4 == 2, F.concat(F.lit('{"version": 3, "k": '), k, F.lit("}"))).otherwise(F.col("props"))
    text = F.when(i % 11 == 5, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    rows = typed_documents(C.table(spark, sf_dir, "events").select("event_id", text.alias("doc")), "doc", EVENT_VERSIONS)
    return rows.select("event_id", "version", "k", F.round("value", 6).alias("value"), F.array_join("tags", ",").alias("tags"), "fault")


EVENT_DOCS = """WITH d AS (SELECT event_id, event_id % 4 AS v, event_id % 11 = 5 AS bad, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type FROM events)
SELECT event_id, CASE WHEN bad THEN NULL WHEN v = 1 THEN 2 WHEN v = 2 THEN 3 ELSE 1 END AS version, CASE WHEN NOT bad AND v <> 2 THEN k END AS k, CASE WHEN NOT bad AND v = 1 THEN event_id % 100 + 0.5::DOUBLE END AS value,
       CASE WHEN NOT bad AND v = 1 THEN 'a,' || event_type END AS tags, CASE WHEN bad THEN 'unreadable' WHEN v = 2 THEN 'unknown_version' END AS fault FROM d"""


QUERIES = (head_patches, budgeted_crawl, redirect_chains, sitemap_walk, work_item_state, streamed_item_state, event_documents)
SQL = {"head_patches": HEADS, "budgeted_crawl": CRAWLED, "redirect_chains": REDIRECTS, "sitemap_walk": SITEMAPS, "work_item_state": ITEMS, "streamed_item_state": ITEMS, "event_documents": EVENT_DOCS}
