"""Queries of generated JSON-LD, places of elements, marked terms, and decoded or parsed inputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as X
from ..functions import urls as U
from ..operators.glossary import annotate_terms
from ..operators.pageview import site_socials
from ..operators.schema import schema_blocks, validated
from ..sources.html_page import decode_column, parse_pages
from ..sources.places import LOCATORS, element_places
from ..sources.records import lighthouse, pagespeed
from . import crawl as C
from .crawl import CRAWL_SQL

# ---------------------------------------------------------------- JSON-LD

#: Last segments that the pages' addresses are given, by page_id.
SEGMENTS = ("", "about-us", "contact", "faq", "service/repair", "blog/first-post", "news", "x%20y_z/deep")


def schema_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all pages, under addresses of all kinds, and what the validator says of them."""
    c, i = C.crawl(spark, sf_dir, ordered=False), F.col("page_id")
    word = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (i % len(SEGMENTS) + 1).cast("int"))
    asked = F.when(i % 16 == 3, F.array(F.struct(F.concat(F.lit('Why "'), i.cast("string"), F.lit('"?')).alias("question"), F.lit("So.").alias("answer")), F.struct(F.lit("Open?").alias("question"), F.lit("").alias("answer"))))
    pages = c.select(
        F.concat("site_id", F.lit("|"), i.cast("string")).alias("site_id"), F.concat(F.lit("https://"), F.col("site_id"), F.lit("/"), word).alias("url"), F.col("site_id").alias("brand"), F.when(i % 3 != 0, F.col("title")).alias("title"), F.col("h1_text").alias("description"),
        F.when(i % 2 == 1, 'Ann "A" Bé').alias("author"), F.when(i % 4 == 0, F.lit("https://l.example/l.png")).otherwise("").alias("logo"), F.when(i % 5 == 0, F.array(F.lit("https://x.com/a"), F.lit("https://y.example/b"))).alias("socials"), F.col("lang").alias("language"), asked.alias("questions"),
    )
    out = validated(schema_blocks(pages))
    return out.select(F.substring_index("site_id", "|", -1).cast("long").alias("page_id"), "page_type", F.size("blocks").cast("long").alias("blocks"), F.array_join("blocks", "\n").alias("json"), F.col("bad").cast("long").alias("bad"), F.size("errors").cast("long").alias("errors"))


def _crumb(k: int, name: str, path: str) -> str:
    return f"""'{{"@type":"ListItem","position":{k},"name":"{name}","item":"' || o || '/{path}"}}'"""


_CRUMBS = {
    1: [("About Us", "about-us")], 2: [("Contact", "contact")], 3: [("Faq", "faq")], 4: [("Service", "service"), ("Repair", "service/repair")], 5: [("Blog", "blog"), ("First Post", "blog/first-post")], 6: [("News", "news")],
    7: [("X Y Z", "x%20y_z"), ("Deep", "x%20y_z/deep")],
}
_LISTS = " ".join(
    f"""WHEN {v} THEN '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[' || {_crumb(1, "Home", "")} || {" || ".join("',' || " + _crumb(k, *x) for k, x in enumerate(steps, 2))} || ']}}'""" for v, steps in _CRUMBS.items()
)
SCHEMAS = f"""WITH {CRAWL_SQL.strip()}, p AS (
  SELECT page_id, page_id % {len(SEGMENTS)} AS v, site_id AS brand, 'https://' || site_id AS o, CASE WHEN page_id % 3 <> 0 THEN nullif(title, '') END AS title, h1_text, lang, [{", ".join(f"'{s}'" for s in SEGMENTS)}][CAST(page_id % {len(SEGMENTS)} + 1 AS INTEGER)] AS word FROM crawl
), b AS (
  SELECT *, o || '/' || word AS url, '{{"@id":"' || o || '/#org"}}' AS org,
    '{{"@context":"https://schema.org","@graph":[{{"@type":"Organization","@id":"' || o || '/#org","name":"' || brand || '","url":"' || o || '/"' || CASE WHEN page_id % 4 = 0 THEN ',"logo":"https://l.example/l.png"' ELSE '' END
      || CASE WHEN h1_text <> '' THEN ',"description":' || to_json(substr(h1_text, 1, 200)) ELSE '' END || CASE WHEN page_id % 5 = 0 THEN ',"sameAs":["https://x.com/a","https://y.example/b"]' ELSE '' END || '}},{{"@type":"WebSite","@id":"' || o || '/#website","url":"' || o || '/","name":"' || brand
      || '","publisher":{{"@id":"' || o || '/#org"}},"inLanguage":"' || lang || '"}}]}}' AS graph, CASE v {_LISTS} END AS crumbs FROM p
), w AS (
  SELECT *, CASE v
    WHEN 1 THEN '{{"@context":"https://schema.org","@type":"AboutPage","url":"' || url || '","name":' || to_json(coalesce(title, brand)) || ',"about":' || org || ',"isPartOf":{{"@id":"' || o || '/#website"}}}}'
    WHEN 2 THEN '{{"@context":"https://schema.org","@type":"ContactPage","url":"' || url || '","name":' || to_json(coalesce(title, brand)) || ',"about":' || org || '}}'
    WHEN 4 THEN '{{"@context":"https://schema.org","@type":"Service","name":' || to_json(coalesce(title, 'Repair')) || ',"url":"' || url || '","provider":' || org || '}}'
    WHEN 5 THEN '{{"@context":"https://schema.org","@type":"Article","headline":' || to_json(substr(coalesce(title, 'First Post'), 1, 110)) || ',"url":"' || url || '","publisher":' || org || ',"mainEntityOfPage":"' || url || '","author":'
      || CASE WHEN page_id % 2 = 1 THEN '{{"@type":"Person","name":"Ann \\"A\\" Bé"}}' ELSE org END || '}}'
    WHEN 3 THEN CASE WHEN page_id % 16 = 3 THEN '{{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{{"@type":"Question","name":"Why \\"' || page_id || '\\"?","acceptedAnswer":{{"@type":"Answer","text":"So."}}}}]}}' END END AS own FROM b
)
SELECT page_id, ['home', 'about', 'contact', 'faq', 'service', 'article', 'bloglist', 'other'][CAST(v + 1 AS INTEGER)] AS page_type, CAST(1 + CASE WHEN crumbs IS NULL THEN 0 ELSE 1 END + CASE WHEN own IS NULL THEN 0 ELSE 1 END AS BIGINT) AS blocks,
       concat_ws(chr(10), graph, crumbs, own) AS json, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS errors FROM w"""


# ---------------------------------------------------------------- places in the source


def source_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the audit's elements stand in the HTML of all pages, with a line for each tag."""
    html = F.replace(F.replace("html", F.lit("><"), F.lit(">\n<")), F.lit("</h1>"), F.lit("\n</h1>"))
    return element_places(C.table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


_PLACE_ROWS = ", ".join("('{}', '{}')".format(k, "(?i)" + p.replace("'", "''")) for k, p in LOCATORS.items())
PLACES = f"""WITH kinds(focus, pattern) AS (VALUES {_PLACE_ROWS}), p AS (SELECT page_id, replace(replace(html, '><', '>' || chr(10) || '<'), '</h1>', chr(10) || '</h1>') AS html FROM pages),
{" ".join(f"k{n} AS (SELECT page_id, '{k}' AS focus, html, regexp_extract(html, '{'(?i)' + v.replace(chr(39), chr(39) * 2)}') AS hit, len(regexp_extract_all(html, '{'(?i)' + v.replace(chr(39), chr(39) * 2)}')) AS n FROM p)," for n, (k, v) in enumerate(LOCATORS.items()))}
every AS ({" UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(LOCATORS)))}), at AS (SELECT *, substr(html, 1, strpos(html, hit) - 1) AS before FROM every)
SELECT page_id, focus, CAST(n AS BIGINT) AS count, CASE WHEN n > 0 THEN CAST(1 + length(before) - length(replace(before, chr(10), '')) AS INTEGER) END AS line, CASE WHEN n > 0 THEN CAST(1 + length(regexp_extract(before, '[^\\n]*$')) AS INTEGER) END AS "column",
  CASE WHEN n > 0 THEN CAST(1 + length(before || hit) - length(replace(before || hit, chr(10), '')) AS INTEGER) END AS end_line, CASE WHEN n > 0 THEN substr(trim(regexp_replace(hit, '\\s+', ' ', 'g')), 1, 400) END AS snippet FROM at""".replace("at AS (", "placed AS (").replace("FROM at", "FROM placed")


# ---------------------------------------------------------------- marked terms

#: A glossary of words that the documents have, some inside others.
GLOSSARY = {"the": "an article", "of the": "a \"genitive\" & more", "of": "a preposition", "and": "a conjunction", "ation": "an ending", "la": "un article", "de la": "de + la", "der": "ein Artikel", "und": "eine Konjunktion", "e": "a letter", "é": "a letter", "th": "letters"}


def glossary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary's terms in all documents: how often each occurs alone, where first, and the marked text's digest."""
    out = annotate_terms(C.table(spark, sf_dir, "documents").select("doc_id", "text"), GLOSSARY)
    return out.select("doc_id", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["first"], t["n"])), "|").alias("terms"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


# ---------------------------------------------------------------- profiles of a site

#: Hosts of the profiles that pages are given; the last is none.
HOSTS = ("www.facebook.com", "x.com", "linkedin.com", "www.tiktok.com", "news.example")


def social_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pages with two links to profiles each; every thirteenth page is its site's root."""
    i, hosts = F.col("page_id"), F.array(*[F.lit(h) for h in HOSTS])
    link = lambda k: F.concat(F.lit('<a href="https://'), F.element_at(hosts, ((i * 3 + k * (i % 4 + 1)) % len(HOSTS) + 1).cast("int")), F.lit("/page"), (i % 9).cast("string"), F.lit('">p</a>'))
    html = F.replace("html", F.lit("<nav>"), F.concat(F.lit("<nav>"), link(0), link(1)))
    p = C.table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("site_id"), i.alias("page_ord"), F.when(i % 13 == 7, F.concat(U.origin(F.col("url")), F.lit("/"))).otherwise(F.col("url")).alias("url"), html.alias("html"))
    return site_socials(parse_pages(p).withColumn("final_url", F.lit(None).cast("string")), 3)


SOCIALS = f"""WITH {CRAWL_SQL.strip()}, p AS (SELECT site_id, page_id AS i, page_id % 13 = 7 OR path = '/' AS root FROM crawl), home AS (SELECT site_id, min(i) AS home FROM p WHERE root GROUP BY site_id),
l AS (SELECT p.site_id, i, k, coalesce(i <> home, true) AS later, regexp_replace([{", ".join(f"'{h}'" for h in HOSTS)}][CAST((i * 3 + k * (i % 4 + 1)) % {len(HOSTS)} + 1 AS INTEGER)], '^www[.]', '') AS host FROM p LEFT JOIN home h ON h.site_id = p.site_id, range(2) t(k)),
first AS (SELECT *, row_number() OVER (PARTITION BY site_id, host ORDER BY later, i, k) AS r FROM l WHERE host <> 'news.example')
SELECT * FROM (SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY later, i, k) AS INTEGER) AS rank, 'https://' || host || '/page' || i % 9 AS url FROM first WHERE r = 1) WHERE rank <= 3"""


# ---------------------------------------------------------------- inputs of other tools


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML of all pages as bytes of a charset that the header, a meta tag or nobody names, decoded again."""
    i = F.col("page_id")
    name = F.when(i % 3 == 1, "UTF-16LE").when(i % 3 == 2, "UTF-8").otherwise("UTF-8")
    data = F.when(i % 3 == 1, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8"))
    header = F.when(i % 3 == 1, F.concat(F.lit("text/html; charset="), name)).when(i % 3 == 2, "text/html")
    p = C.table(spark, sf_dir, "pages").select("page_id", data.alias("content"), header.alias("content_type"))
    return decode_column(p).select("page_id", F.col("detected_charset").alias("charset"), F.length("html").cast("long").alias("chars"), F.sha2("html", 256).alias("sha256"))


DECODED = """SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'utf-16le' ELSE 'utf-8' END AS charset, CAST(length(html) AS BIGINT) AS chars, sha256(html) AS sha256 FROM pages"""


def check_results_of_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of Lighthouse documents made of all events, and the scores of the same documents."""
    i = F.col("event_id")
    score = lambda k: F.when((i + k) % 7 == 0, "null").otherwise(F.concat(F.lit("0."), ((i * (k + 3)) % 10).cast("string")))
    audits = F.concat(F.lit('{"document-title":{"score":'), score(1), F.lit('},"meta-description":{"score":'), score(2), F.lit('},"largest-contentful-paint":{"score":1,"numericValue":'), (i * 3 % 5000).cast("string"), F.lit("}}"))
    text = F.concat(F.lit('{"lighthouseResult":{"categories":{"performance":{"score":'), score(0), F.lit('}},"audits":'), audits, F.lit("}}"))
    text = F.when(i % 13 == 5, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    e = C.table(spark, sf_dir, "events").select(i.alias("audit_id"), i.alias("site_id"), text.alias("json"))
    said = lighthouse(e).where(F.col("dim").isin("title", "description")).groupBy("audit_id").pivot("dim", ["title", "description"]).agg(F.first("verdict"))
    speed = pagespeed(e).select(F.col("site_id").alias("audit_id"), F.col("psi.ok").alias("ok"), F.col("psi.perf_score").alias("perf_score"), "lcp_ms")
    return speed.join(said, "audit_id").select("audit_id", "ok", "perf_score", "lcp_ms", "title", "description")


TOOLS = """WITH e AS (SELECT event_id AS i, event_id % 13 = 5 AS bad FROM events), s AS (SELECT *, CASE WHEN i % 7 <> 0 THEN i * 3 % 10 END AS p, CASE WHEN (i + 1) % 7 <> 0 THEN i * 4 % 10 END AS t, CASE WHEN (i + 2) % 7 <> 0 THEN i * 5 % 10 END AS d FROM e)
SELECT i AS audit_id, NOT bad AS ok, CASE WHEN bad THEN 0 ELSE CAST(coalesce(p, 0) * 10 AS INTEGER) END AS perf_score, CASE WHEN NOT bad THEN CAST(i * 3 % 5000 AS DOUBLE) END AS lcp_ms,
  CASE WHEN bad OR t IS NULL THEN 'n/a' WHEN t = 9 THEN 'pass' ELSE 'fail' END AS title, CASE WHEN bad OR d IS NULL THEN 'n/a' WHEN d = 9 THEN 'pass' ELSE 'fail' END AS description FROM s"""


def search_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all pages as redirect links of a search engine, and Retry-After headers of the pages' numbers, read back."""
    i, now = F.col("page_id"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    token = F.regexp_replace(F.translate(F.base64(F.encode("url", "UTF-8")), "+/", "-_"), "=+$|\\r?\\n", "")
    link = F.when(i % 4 == 3, F.col("url")).otherwise(F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), token, F.lit("&ntb=1")))
    header = F.when(i % 3 == 0, (i % 500).cast("string")).when(i % 3 == 1, F.concat(F.lit("Thu, 01 Jan 2026 00:0"), (i % 10).cast("string"), F.lit(":30 GMT"))).otherwise("soon")
    return C.table(spark, sf_dir, "pages").select("page_id", U.decode_bing(link).alias("target"), X.retry_after_ms(header, now).alias("wait_ms"))


TARGETS = "SELECT page_id, url AS target, CAST(CASE page_id % 3 WHEN 0 THEN page_id % 500 * 1000 WHEN 1 THEN page_id % 10 * 60000 + 30000 ELSE 0 END AS BIGINT) AS wait_ms FROM pages"

QUERIES = (schema_fixes, source_places, glossary_marks, social_profiles, decoded_pages, check_results_of_tools, search_targets)
SQL = {"schema_fixes": SCHEMAS, "source_places": PLACES, "social_profiles": SOCIALS, "decoded_pages": DECODED, "check_results_of_tools": TOOLS, "search_targets": TARGETS}
