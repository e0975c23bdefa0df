"""A made-up crawl on which every rule has something to find: ten pages a site, features by arithmetic on page_id.

``INPUTS_SQL`` says which features a page has, in SQL that Spark and DuckDB share.  Spark makes HTML of
them, parses it and runs the rules; ``CHECKS_SQL`` decides the checks from the features by their definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PAGE, SITE, conform
from ..sources.html_page import parse_pages
from ..storage import materialize
from .crawl import table


def has(k: int, m: int) -> str:
    """Whether a page has feature k: one page in m does."""
    return f"((i * {2 * k + 3} + g * {k + 2} + {k}) % {m} = 0)"


def pick(*cases: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases) + f" ELSE {otherwise} END"


_PATH = pick(
    ("j = 0", "'/'"), ("j = 1 AND g % 4 = 0", "'/about-us'"), ("j = 2 AND g % 4 = 1", "'/contact'"), ("j = 3", "'/cart/p3'"), ("j = 4 AND g % 3 = 0", "'/en/Page-4'"), ("j = 4", "'/th/p4'"), ("j = 5", "'/twin'"), ("j = 6 AND g % 3 = 1", "'/twin/'"),
    ("j = 7 AND g % 5 = 2", "'/privacy'"), ("j = 7 AND g % 7 = 3", "concat('/', repeat('a', 120))"), ("j = 9 AND g % 6 = 2", "'/page/2'"), otherwise="concat('/p', j)",
)
#: Booleans and categories of a page, by name.
FEATURES = {
    "status": pick((has(40, 23), "404"), (has(41, 29), "503"), otherwise="200"), "blocked": f"(g % 12 = 11 OR {has(83, 31)})",
    "lang": pick(("i % 7 = 0", "''"), ("i % 7 < 4", "'en'"), ("i % 7 = 4", "'en-US'"), otherwise="'th'"),
    "title": pick((has(1, 17), "''"), (has(2, 11), "'Short one'"), (has(3, 13), "repeat('W', 60)"), (has(4, 4), "'The same title on pages'"), otherwise="concat('A proper title of page ', j, ' of ', g)"),
    "descr": pick((has(6, 9), "''"), (has(7, 11), "'Too short.'"), (has(8, 13), "repeat('long text ', 20)"), (has(9, 5), "'The same description of a page, which is told to be long enough for it'"), otherwise="concat('A description of page ', j, ' of site ', g, ', long enough to be a good one for sure')"),
    "viewport": pick((has(10, 9), "''"), (has(11, 7), "'width=device-width, maximum-scale=1.0'"), otherwise="'width=device-width'"),
    "robots": pick((has(12, 11), "'noindex'"), (has(13, 13), "'index,madeup'"), (has(14, 6), "'max-snippet:5, nofollow'"), otherwise="''"), "robots_header": has(76, 21),
    "canon": pick((has(15, 8), "'none'"), (has(16, 11), "'relative'"), (has(17, 13), "'away'"), otherwise="'own'"), "canon_twice": has(18, 17),
    "og": pick((has(19, 7), "'none'"), (has(20, 5), "'some'"), (has(21, 9), "'relative'"), otherwise="'all'"), "twitter": f"(g % 3 <> 1 AND NOT {has(22, 2)})",
    "refresh": has(23, 19), "keywords": has(24, 15), "hreflang": pick((f"g % 4 = 2 AND {has(25, 3)}", "'bad'"), (f"g % 4 = 2 AND {has(26, 2)}", "'good'"), otherwise="'none'"),
    "blocking": has(27, 6), "third": has(28, 9), "many_scripts": has(29, 14), "mixed": has(30, 16),
    "ld": pick((has(31, 3), "'none'"), (has(32, 15), "'bad'"), (has(33, 6), "'org'"), (has(34, 17), "'person'"), (has(35, 9), "'faq'"), (has(36, 9), "'crumb'"), (has(37, 10), "'corp'"), (has(75, 3), "'orgw'"), otherwise="'article'"),
    "signed": has(38, 11), "dated": has(39, 9),
    "h1": pick((has(42, 9), "'none'"), (has(43, 11), "'empty'"), (has(44, 8), "'two'"), (has(45, 13), "'hidden'"), otherwise="'one'"), "h1_same": has(46, 4), "h1_shown": has(47, 2), "jump": has(48, 7), "empty_h3": has(49, 12), "question": has(50, 26),
    "gallery": has(51, 4), "no_alt": has(52, 5), "lazy": has(53, 3), "sized": has(54, 3), "empty_alt": has(55, 4),
    "few_links": has(56, 7), "empty_link": has(57, 8), "generic": has(58, 9), "to_contact": has(59, 12), "thin": has(60, 6), "same_text": has(61, 5), "shell": has(62, 13), "noscript": has(63, 2), "old_tag": has(64, 14), "no_doctype": has(65, 12),
    "phone": "(g % 3 = 0 AND j = 0)", "mail": has(66, 30), "copyright": pick((has(67, 8), "2019"), (has(68, 8), "2025"), otherwise="0"), "in_table": has(69, 14), "lists": has(70, 15),
    "huge": has(71, 61), "large": has(72, 20), "bloat": has(73, 25), "slow": has(74, 9), "gzip": f"(g % 4 <> 3 AND {has(80, 3)})", "charset_": pick((has(77, 9), "'windows-874'"), (has(78, 3), "'UTF-8'"), otherwise="''"), "chain": has(79, 10),
    "retitled": has(5, 7), "longer": has(81, 4), "hides_h1": has(82, 7),
}
# Whole sites that have, or lack, what a check counts, so that it comes out in all of its states.
for _k, _all in {
    "no_alt": ("WHEN 3 THEN false WHEN 4 THEN true"), "empty_alt": ("WHEN 3 THEN false WHEN 4 THEN false"), "gallery": ("WHEN 4 THEN false"), "hreflang": ("WHEN 5 THEN 'none' WHEN 6 THEN 'good'"), "in_table": ("WHEN 7 THEN true"),
    "ld": ("WHEN 1 THEN 'none' WHEN 2 THEN 'org'"),
}.items():
    FEATURES[_k] = f"CASE g % 8 {_all} ELSE {FEATURES[_k]} END"

INPUTS_SQL = f"""made0 AS (SELECT page_id AS i, CAST(floor(page_id / 10.0) AS BIGINT) AS g, page_id % 10 AS j FROM pages),
made1 AS (SELECT i, g, j, concat('www.g', g, '.example') AS site_id, concat(CASE WHEN g % 6 = 1 THEN 'http' ELSE 'https' END, '://www.g', g, '.example') AS origin, {_PATH} AS path,
  CASE WHEN j = 8 AND g % 5 = 1 THEN '?page=2' WHEN j = 8 AND g % 5 = 3 THEN '?x=1' ELSE '' END AS search FROM made0),
made AS (SELECT *, concat(origin, path, search) AS url, {", ".join(f"{v} AS {k}" for k, v in FEATURES.items())} FROM made1)"""

#: JSON-LD blocks by name.
_LD = {
    "bad": "{bad", "org": '{"@type":"Organization","name":"A","url":"https://a/","logo":"l.png","sameAs":["https://x.com/a"]}', "orgw": '{"@type":"Organization","name":"A"}', "person": '{"@type":"Person","name":"P"}',
    "faq": '{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q"}]}', "crumb": '{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"H"}]}', "corp": '{"@type":"Corporation","name":"C"}',
    "article": '{"@type":"Article","headline":"H","author":{"@type":"Person","name":"P"},"datePublished":"2024-01-01"}',
}


def _html() -> str:
    """The HTML of a page as a Spark expression of its features."""
    q = lambda s: "'" + s.replace("'", "\\'") + "'"
    when = lambda cond, s: f"CASE WHEN {cond} THEN {s if s.startswith('concat') else q(s)} ELSE '' END"
    meta = lambda cond, name, value: when(cond, f"concat('<meta name=\"{name}\" content=\"', {value}, '\">')")
    words = "array_join(transform(sequence(1, CASE WHEN thin THEN 20 ELSE 200 END), k -> concat(CASE WHEN same_text AND NOT thin THEN 'same' ELSE concat('w', lpad(cast(i as string), 7, '0'), 'x') END, lpad(cast(k as string), 4, '0'))), ' ')"
    link = lambda n: "".join(f'<a href="/p{k}">Page number {k}</a> ' for k in range(1, n + 1))
    images = "concat(array_join(transform(sequence(1, CASE WHEN gallery THEN 6 ELSE 1 END), k -> concat('<img src=\"/i', k, '.png\"', CASE WHEN no_alt AND k = 1 THEN '' ELSE ' alt=\"a\"' END, CASE WHEN lazy THEN ' loading=\"lazy\"' ELSE '' END, CASE WHEN sized THEN ' width=\"300\" height=\"200\"' ELSE '' END, '>')), ''))"
    parts = [
        when("NOT no_doctype", "<!DOCTYPE html>\n"), "CASE WHEN lang <> '' THEN concat('<html lang=\"', lang, '\">') ELSE '<html>' END", q("<head>"), when("title <> ''", "concat('<title>', title, '</title>')"), meta("title = '' AND g % 2 = 0", "title", "'T'"),
        meta("descr <> ''", "description", "descr"), meta("viewport <> ''", "viewport", "viewport"), meta("robots <> ''", "robots", "robots"), meta("keywords", "keywords", "'a, b'"), meta("signed", "author", "'Ann'"), meta("dated", "article:published_time", "'2024-01-01'"),
        when("canon <> 'none'", "concat('<link rel=\"canonical\" href=\"', CASE canon WHEN 'relative' THEN '/rel' WHEN 'away' THEN 'https://elsewhere.example/x' ELSE url END, '\">')"), when("canon <> 'none' AND canon_twice", '<link rel="canonical" href="/second">'),
        when("og <> 'none'", '<meta property="og:title" content="t">'), when("og IN ('all', 'relative')", '<meta property="og:description" content="d"><meta property="og:type" content="website">'), when("og = 'all'", '<meta property="og:image" content="https://cdn.example/i.png">'), when("og = 'relative'", '<meta property="og:image" content="img.png">'),
        meta("twitter", "twitter:card", "'summary'"), when("refresh", '<meta http-equiv="Refresh" content="9">'), when("hreflang <> 'none'", '<link rel="alternate" hreflang="en" href="/en">'), when("hreflang = 'good'", '<link rel="alternate" hreflang="x-default" href="/">'),
        when("g % 3 <> 2", '<link rel="shortcut icon" href="/f.ico">'), q('<script src="/a.js"></script><script src="/d.js" defer></script>'), when("blocking", '<script src="/b.js"></script><script src="/c.js"></script>'), q("</head><body><div>"), words, q("</div> "),
        *[when(f"ld = '{k}'", f'<script type="application/ld+json">{v}</script>') for k, v in _LD.items()],
        when("h1 = 'empty'", "<h1> </h1>"), when("h1 IN ('one', 'two')", "concat('<h1>', CASE WHEN h1_same THEN 'One heading of many pages' ELSE concat('Heading ', j) END, '</h1>')"), when("h1 = 'two'", "<h1>Another</h1>"),
        when("h1 = 'hidden'", "concat('<h1 style=\"color: red; display: none\">', CASE WHEN h1_same THEN 'One heading of many pages' ELSE concat('Heading ', j) END, '</h1>')"),
        "CASE WHEN question THEN '<h2>What is this?</h2>' ELSE '<h2>Section</h2>' END", "CASE WHEN jump THEN '<h4>Deep</h4>' ELSE '<h3>Sub</h3>' END", when("empty_h3", "<h3></h3>"), images, when("mixed", '<img src="http://plain.example/m.png" alt="m">'),
        f"CASE WHEN few_links THEN {q(link(1))} ELSE {q(link(5))} END", when("empty_link", '<a href="/e"> </a>'), when("generic", '<a href="/m">read more</a> <a href="/m">Here</a> <a href="/m">Read  more</a>'), when("to_contact", '<a href="/contact">Write to us</a>'),
        when("third", "".join(f'<script src="//t{k}.cdn.net/x.js"></script>' for k in range(9))), when("many_scripts", '<script src="/s.js"></script>' * 26), when("shell", '<div id="root"></div>'), when("noscript", "<noscript>no</noscript>"), when("old_tag", "<center></center>"),
        when("phone", "<p>call 02 123 4567</p>"), when("mail", '<a href="mailto:x@y.zz">mail us</a>'), when("copyright > 0", "concat('<p>© Company ', copyright, '</p>')"), when("in_table", "<table><tr><td>1</td></tr></table>"), when("lists", "<ul><li>a</li></ul><ul></ul><ol></ol>"),
        when("huge", "concat('<!--', repeat('x', 500001), '-->')"), when("large", "concat('<!--', repeat('x', 61000), '-->')"), when("bloat", "concat('<script>', repeat('y', 200001), '</script>')"), q("</body></html>"),
    ]
    return f"concat({', '.join(parts)})"


#: robots.txt by site number modulo 6, 0 for none.
ROBOTS = {1: "User-agent: *\nDisallow: /\n", 2: "User-agent: *\nDisallow: /products/\nDisallow: /news\n", 3: "User-agent: GPTBot\nDisallow: /\n", 4: "User-agent: *\nAllow: /\nSitemap: https://x.example/s.xml\n", 5: "User-agent: PerplexityBot\nDisallow: /en/\n"}


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {INPUTS_SQL} SELECT * FROM made".replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))


def made_crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, site) of the made-up crawl."""
    made = made_pages(spark, sf_dir)
    e = F.expr
    rendered = F.col("g") % 5 == 0
    img = lambda cond, alt, labeled: e(f"CASE WHEN {cond} THEN named_struct('src', '/i.png', 'alt', {alt}, 'labeled', {labeled}, 'visible', true, 'aria_hidden', false) END")
    raw = made.select(
        "site_id", F.col("j").cast("int").alias("page_ord"), "url", F.col("url").alias("final_url"), "status", "blocked", F.lit(True).alias("is_html"), F.when(F.col("slow"), 3500).otherwise(200).alias("elapsed"), F.nullif("charset_", F.lit("")).alias("detected_charset"),
        e("""map_filter(map('content-encoding', if(gzip, 'gzip', ''), 'x-robots-tag', if(robots_header, 'NoIndex', ''), 'strict-transport-security', if(g % 3 <> 0, 'max-age=1', ''), 'x-content-type-options', if(g % 5 <> 4, 'nosniff', ''),
             'x-frame-options', if(g % 2 = 0, 'DENY', ''), 'referrer-policy', 'origin', 'content-security-policy', if(g % 4 = 1, "frame-ancestors 'self'", '')), (k, v) -> v <> '')""").alias("headers"),
        F.when(rendered, F.array_compact(F.array(img("no_alt", "cast(null as string)", "false"), img("empty_alt", "''", "false"), img("true", "'x'", "true")))).alias("image_vis"),
        e("if(chain, array(named_struct('url', 'a', 'status', 301, 'location', 'b', 'elapsed', 1L), named_struct('url', 'b', 'status', 302, 'location', 'c', 'elapsed', 1L)), null)").alias("redirect_chain"),
        F.when(rendered, e("if(retitled, 'Another title', title)")).alias("rendered_title"), e("if(descr = '' AND g % 3 = 0, 'Rendered description', null)").alias("rendered_description"),
        F.when(rendered, e("if(h1 IN ('none', 'empty') AND h1_shown, array('Shown', 'Twice'), cast(array() as array<string>))")).alias("rendered_h1"), F.when(rendered, e("if(hides_h1, 1, 0)")).alias("rendered_h1_hidden"),
        F.when(rendered, e("if(longer, 100000, 10)")).alias("rendered_text_length"), F.expr(_html()).alias("html"),
    )
    pages = materialize(conform(parse_pages(raw), PAGE), "made-pages")
    robots = F.element_at(F.create_map(*[x for k, v in ROBOTS.items() for x in (F.lit(k).cast("long"), F.lit(v))]), F.col("g") % 6)
    error = lambda status, final, said: f"array(named_struct('variant', 'https://v/', 'status', {status}, 'final_origin', {final}, 'error', {said}))"
    site = made.groupBy("site_id", "g", "origin").agg(F.collect_list(F.when(F.col("j") != 7, F.col("url"))).alias("urls")).select(
        "site_id", "origin", F.concat("origin", F.lit("/")).alias("start_url"), F.col("origin").startswith("https").alias("https"), robots.alias("robots_txt"),
        e("CASE g % 4 WHEN 0 THEN array() WHEN 1 THEN urls WHEN 2 THEN array(concat(origin, '/')) ELSE array(concat(origin, '/'), concat(origin, '/?language=th')) END").alias("sitemap_urls"),
        (F.col("g") % 3 == 1).alias("sitemap_has_lastmod"), e("if(g % 5 = 3, 404, 200)").alias("favicon_status"), e("if(g % 4 = 2, '# llms', null)").alias("llms_txt"), (F.col("g") % 7 == 2).alias("tls_insecure"), e("named_struct('ok', g % 5 <> 2, 'status', 200)").alias("not_found"),
        e(f"CASE g % 6 WHEN 0 THEN array() WHEN 1 THEN {error(200, chr(39) + 'https://other' + chr(39), 'null')} WHEN 2 THEN {error(0, 'null', chr(39) + 'getaddrinfo ENOTFOUND v' + chr(39))} WHEN 3 THEN {error(500, 'null', 'null')} WHEN 4 THEN {error(200, 'origin', 'null')} ELSE {error(0, 'null', chr(39) + 'aborted' + chr(39))} END").alias("variants"),
        e("CASE g % 4 WHEN 1 THEN array(named_struct('from', 'a', 'to', 'b', 'status', 404)) WHEN 2 THEN array(named_struct('from', 'a', 'to', 'b', 'status', 503)) ELSE array() END").alias("broken_links"),
        e("CASE g % 5 WHEN 0 THEN 'available' WHEN 1 THEN 'failed-spa' WHEN 2 THEN 'skipped' ELSE 'none' END").alias("render_state"),
        e("CASE g % 7 WHEN 0 THEN null WHEN 1 THEN named_struct('skip', true, 'ok', false, 'perf_score', 0, 'overall', '') WHEN 2 THEN named_struct('skip', false, 'ok', true, 'perf_score', 85, 'overall', 'FAST') WHEN 3 THEN named_struct('skip', false, 'ok', true, 'perf_score', 60, 'overall', 'AVERAGE') WHEN 4 THEN named_struct('skip', false, 'ok', true, 'perf_score', 30, 'overall', 'SLOW') WHEN 5 THEN named_struct('skip', false, 'ok', true, 'perf_score', 80, 'overall', '') ELSE named_struct('skip', false, 'ok', false, 'perf_score', 0, 'overall', '') END").alias("psi"),
    )
    return pages, materialize(conform(site, SITE), "made-site")


#: Whether a page has a flag, from its features, by the flags' definitions.
_NOINDEX = "(robots = 'noindex' OR robots_header)"
_UTILITY = "(path <> '/' AND (starts_with(path, '/cart') OR search = '?page=2'))"
_ELIGIBLE = f"(NOT {_NOINDEX} AND canon IN ('none', 'own'))"
_R = "(g % 5 = 0)"
_USABLE, _SHOWN = "(h1 IN ('one', 'two', 'hidden'))", f"({_R} AND h1 IN ('none', 'empty') AND h1_shown)"
_DATED, _SIGNED = "(dated OR ld = 'article')", "(signed OR ld = 'article')"
_INTERNAL = "(CASE WHEN few_links THEN 1 ELSE 5 END + CASE WHEN empty_link THEN 1 ELSE 0 END + CASE WHEN generic THEN 3 ELSE 0 END + CASE WHEN to_contact THEN 1 ELSE 0 END)"
_TITLE_SOFT = f"(({_R} AND retitled) OR g % 2 = 0)"
FLAGS = {
    "title_hard": f"title = '' AND NOT {_TITLE_SOFT}", "title_soft": f"title = '' AND {_TITLE_SOFT}", "title_length": "title = 'Short one' OR title = repeat('W', 60)", "desc_hard": "descr = '' AND g % 3 <> 0", "desc_soft": "descr = '' AND g % 3 = 0",
    "desc_length": "descr <> '' AND length(descr) NOT BETWEEN 50 AND 170", "eligible": _ELIGIBLE, "h1_hard": f"{_ELIGIBLE} AND NOT {_USABLE} AND NOT {_SHOWN}", "h1_soft": f"{_ELIGIBLE} AND NOT {_USABLE} AND {_SHOWN}", "h1_hidden": f"{_ELIGIBLE} AND (h1 = 'hidden' OR ({_R} AND hides_h1))",
    "h1_multiple": f"{_ELIGIBLE} AND h1 = 'two'", "heading_order": "jump", "content_thin": "thin AND NOT shell", "lang_missing": "lang = ''", "viewport_missing": "viewport = ''", "viewport_noscale": "contains(viewport, 'maximum-scale')", "doctype_missing": "no_doctype", "deprecated_tags": "old_tag",
    "url_hygiene": "regexp_matches(path, '[A-Z]') OR length(path) > 115", "copyright_stale": "copyright = 2019", "meta_keywords": "keywords", "empty_headings": "h1 = 'empty' OR empty_h3", "noindex_content": f"{_NOINDEX} AND NOT {_UTILITY}", "noindex_home": f"{_NOINDEX} AND path = '/'",
    "noindex_utility": f"{_NOINDEX} AND {_UTILITY}", "robots_meta_invalid": "robots = 'index,madeup'", "canonical_missing": "canon = 'none'", "canonical_multiple": "canon <> 'none' AND canon_twice", "canonical_relative": "canon = 'relative'", "query_url": "search <> ''", "redirect_chain": "chain",
    "mixed_content": "starts_with(url, 'https') AND mixed", "hreflang_any": "hreflang <> 'none'", "hreflang_bad": "hreflang = 'bad'", "language_url": "j = 4", "meta_refresh": "refresh", "ld_any": "ld <> 'none'", "ld_none": "ld = 'none'", "ld_bad": "ld = 'bad'", "ld_org": "ld IN ('org', 'orgw')",
    "ld_corp": "ld = 'corp'", "ld_breadcrumb": "ld = 'crumb'", "ld_faq": "ld = 'faq'", "ld_person": "ld = 'person'", "schema_error": "ld = 'faq'", "schema_warning": "ld IN ('orgw', 'article')", "schema_valid": "ld IN ('org', 'orgw', 'faq', 'crumb', 'article')", "og_none": "og = 'none'", "og_some": "og = 'some'",
    "og_bad": "og IN ('none', 'some')", "og_image_relative": "og = 'relative'", "twitter_missing": "NOT twitter", "empty_anchor": "empty_link", "generic_anchor": "generic", "internal_links_few": f"{_INTERNAL} < 3", "third_party": "third", "img_missing": "no_alt", "img_empty": f"{_R} AND empty_alt", "rendered_images": _R,
    "html_size": "huge", "script_count": "many_scripts", "compressed": "gzip", "ttfb_slow": "slow", "inline_bloat": "bloat", "head_blocking": "blocking", "text_ratio": "(huge OR large OR bloat) AND NOT shell", "spa_shell": "shell", "noscript_missing": "shell AND NOT noscript", "charset_other": "charset_ = 'windows-874'",
    "question_": "question", "author": _SIGNED, "dated_": _DATED, "undated": f"NOT {_DATED}", "unsigned": f"{_DATED} AND NOT {_SIGNED}", "same_as": "ld = 'org'", "citable": "in_table OR lists", "contact_signal": "phone OR mail", "rendered": _R, "render_diff": f"{_R} AND (longer OR {_SHOWN} OR retitled)",
    "trust_about": "path = '/about-us'", "trust_contact": "path = '/contact' OR to_contact", "trust_privacy": "path = '/privacy'",
}
#: Flags whose pages a check shows, where they are not called like the check.
SHOWS = {
    "title-missing": ("title_hard", "title_soft"), "desc-missing": ("desc_hard", "desc_soft"), "h1-missing": ("h1_hard", "h1_soft"), "noindex": ("noindex_content", "noindex_utility"), "hreflang": ("hreflang_bad",), "jsonld-missing": ("ld_none",), "jsonld-invalid": ("ld_bad",),
    "schema-incomplete": ("schema_error", "schema_warning"), "og-tags": ("og_bad",), "img-alt": ("img_missing", "img_empty"), "geo-spa-risk": ("spa_shell",), "noscript-fallback": ("noscript_missing",), "charset-not-utf8": ("charset_other",), "error-pages": ("gone",), "crawl-blocked": ("refused",),
    "orphan-pages": ("orphan",), "sitemap-coverage": ("not_in_sitemap",), "trailing-slash": ("slash_twin",), "title-duplicate": ("dup_title",), "desc-duplicate": ("dup_desc",), "h1-duplicate": ("dup_h1",), "geo-eeat": ("undated", "unsigned"),
}
_SITE_ONLY = ("favicon-missing", "https", "ssl-chain-incomplete", "robots-missing", "robots-blocks-all", "robots-blocks-section", "robots-sitemap", "sitemap-exists", "soft-404", "schema-org", "schema-breadcrumb", "twitter-card", "broken-links", "broken-links-soft", "img-lazy", "img-dimensions", "compression",
              "security-headers", "host-variants", "favicon-file", "sitemap-lastmod", "geo-bot-access", "geo-llms-txt", "geo-faq-schema", "geo-qa-content", "geo-citable", "geo-trust-pages", "geo-entity", "no-pages", "cwv", "cwv-score", "cwv-field")
_EXTRA = ("gone", "refused", "orphan", "not_in_sitemap", "slash_twin", "near_duplicate", "dup_title", "dup_desc", "dup_h1")


def _rule(id_: str, category: str, *cases: tuple[str, str, str], always: str = "n_ok > 0") -> str:
    """SQL rows of one check: the first case (condition, severity, status) that holds."""
    which = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cases) + " END"
    return f"SELECT site_id, '{id_}' AS id, '{category}' AS category, {which(1)} AS severity, {which(2)} AS status FROM facts WHERE {always}"


def _flag(id_: str, category: str, severity: str, status: str, flag: str | None = None, good: str | None = None) -> str:
    bad = (f"n_{flag or id_.replace('-', '_')} > 0", severity, status)
    return _rule(id_, category, bad, *([("true", good, "pass")] if good else []))


_MAPPED, _HAS_ROBOTS = "(g % 4 <> 0)", "(g % 6 <> 0)"
_ABSENT = "((n_trust_about = 0)::INT + (n_trust_contact = 0)::INT + (n_trust_privacy = 0)::INT + (n_contact_signal = 0)::INT)"
_PSI = "(g % 7 IN (2, 3, 4, 5))"
_RULES = [
    _rule("title-missing", "onpage", ("n_title_hard > 0", "high", "fail"), ("n_title_soft > 0", "high", "warn"), ("true", "high", "pass")), _flag("title-length", "onpage", "med", "warn", good="med"), _flag("title-duplicate", "onpage", "high", "fail", "dup_title", "high"),
    _rule("desc-missing", "onpage", ("n_desc_hard > 0", "med", "fail"), ("n_desc_soft > 0", "med", "warn"), ("true", "med", "pass")), _flag("desc-length", "onpage", "low", "warn"), _flag("desc-duplicate", "onpage", "med", "warn", "dup_desc"),
    _rule("h1-missing", "onpage", ("n_h1_hard > 0", "high", "fail"), ("n_h1_soft > 0", "high", "warn"), ("n_eligible > 0", "high", "pass")), _flag("h1-hidden", "onpage", "med", "warn"), _flag("h1-multiple", "onpage", "low", "info"), _flag("h1-duplicate", "onpage", "med", "warn", "dup_h1"),
    _flag("heading-order", "onpage", "low", "warn"), _flag("empty-headings", "onpage", "low", "warn"), _flag("content-thin", "onpage", "med", "warn"), _flag("lang-missing", "onpage", "low", "warn", good="low"), _flag("viewport-missing", "onpage", "high", "fail", good="high"), _flag("viewport-noscale", "onpage", "low", "warn"),
    _rule("favicon-missing", "onpage", ("g % 3 = 2", "low", "warn")), _rule("favicon-file", "onpage", ("g % 5 = 3", "low", "warn")), _flag("doctype-missing", "onpage", "low", "warn"), _flag("deprecated-tags", "onpage", "low", "warn"), _flag("url-hygiene", "onpage", "low", "warn"), _flag("copyright-stale", "onpage", "low", "warn"),
    _flag("meta-keywords", "onpage", "low", "info"), _rule("no-pages", "index", ("n_ok = 0", "high", "fail"), always="true"), _rule("robots-missing", "index", (f"NOT {_HAS_ROBOTS}", "med", "warn")), _rule("robots-blocks-all", "index", ("g % 6 = 1", "high", "fail"), (_HAS_ROBOTS, "high", "pass")),
    _rule("robots-blocks-section", "index", ("g % 6 = 2", "high", "fail"), ("g % 6 = 5", "med", "warn"), (_HAS_ROBOTS, "low", "pass")), _rule("robots-sitemap", "index", ("g % 6 = 4", "low", "pass"), (_HAS_ROBOTS, "low", "warn")), _flag("robots-meta-invalid", "index", "med", "warn"),
    _rule("sitemap-exists", "index", (f"NOT {_MAPPED}", "med", "fail"), ("true", "med", "pass")), _rule("sitemap-coverage", "index", (f"{_MAPPED} AND n_not_in_sitemap > 0.3 * n_ok", "low", "warn")), _rule("sitemap-lastmod", "index", (f"{_MAPPED} AND g % 3 <> 1", "low", "warn")),
    _rule("noindex", "index", ("n_noindex_home > 0", "high", "warn"), ("n_noindex_content > 0", "high", "warn"), ("n_noindex_utility > 0", "low", "pass")), _rule("canonical-missing", "index", ("n_canonical_missing > 0 AND (n_query_url > 0 OR g % 4 = 3 OR (g % 4 = 1 AND g % 5 IN (1, 3)) OR n_dup_title > 0)", "high", "fail"), ("n_canonical_missing > 0", "low", "warn"), ("true", "low", "pass")),
    _flag("canonical-multiple", "index", "high", "fail"), _flag("canonical-relative", "index", "low", "warn"), _flag("redirect-chain", "index", "med", "warn"), _flag("error-pages", "index", "high", "fail", "gone"), _flag("crawl-blocked", "index", "med", "info", "refused"), _rule("soft-404", "index", ("g % 5 = 2", "med", "warn")),
    _rule("hreflang", "index", ("n_hreflang_bad > 0", "low", "warn"), ("n_hreflang_any > 0", "low", "pass"), ("n_language_url > 0 OR g % 4 IN (1, 3)", "med", "warn")), _flag("meta-refresh", "index", "med", "warn"), _flag("trailing-slash", "index", "med", "warn", "slash_twin"), _flag("near-duplicate", "index", "med", "warn"),
    _rule("host-variants", "index", ("g % 6 = 1 AND n_ok - n_canonical_missing >= 0.8 * n_ok", "med", "warn"), ("g % 6 = 1", "high", "fail"), ("g % 6 IN (2, 3)", "med", "warn"), ("g % 6 IN (4, 5)", "high", "pass")), _rule("jsonld-missing", "schema", ("n_ld_any = 0", "high", "fail"), ("n_ld_any < 0.9 * n_ok", "high", "warn"), ("true", "high", "pass")),
    _flag("jsonld-invalid", "schema", "high", "fail", "ld_bad"), _rule("schema-org", "schema", ("n_ld_org + n_ld_corp = 0", "med", "fail"), ("true", "med", "pass")), _rule("schema-breadcrumb", "schema", ("n_ld_breadcrumb = 0", "low", "warn"), ("true", "low", "pass")),
    _rule("schema-incomplete", "schema", ("n_schema_error > 0", "high", "fail"), ("n_schema_warning > 0", "low", "warn"), ("n_schema_valid > 0", "high", "pass")), _rule("og-tags", "schema", ("n_og_none > 0", "high", "fail"), ("n_og_some > 0", "med", "warn"), ("true", "low", "pass")), _flag("og-image-relative", "schema", "low", "warn"),
    _rule("twitter-card", "schema", ("n_twitter_missing = n_ok", "low", "warn")), _rule("broken-links", "links", ("g % 4 = 1", "high", "fail"), ("true", "high", "pass")), _rule("broken-links-soft", "links", ("g % 4 = 2", "low", "info")), _flag("empty-anchor", "links", "med", "warn"), _flag("generic-anchor", "links", "low", "warn"),
    _flag("internal-links-few", "links", "med", "warn"), _flag("orphan-pages", "links", "med", "warn", "orphan"), _rule("img-alt", "images", ("images_missing > 0 AND floor(images_missing / images * 100 + 0.5) > 50", "med", "fail"), ("images_missing > 0", "med", "warn"), ("images_empty > 0", "low", "warn"), ("true", "med", "pass")),
    _rule("img-lazy", "images", ("not_lazy > 0.7 * raw_images AND raw_images > 5", "low", "warn")), _rule("img-dimensions", "images", ("no_size > 0.5 * raw_images AND raw_images > 5", "low", "warn")), _flag("html-size", "performance", "med", "warn"), _flag("script-count", "performance", "med", "warn"),
    _rule("compression", "performance", ("n_compressed = 0", "med", "warn"), ("true", "med", "pass")), _flag("ttfb-slow", "performance", "med", "warn"), _flag("inline-bloat", "performance", "low", "warn"), _flag("third-party", "performance", "med", "warn"), _flag("head-blocking", "performance", "med", "warn"), _flag("text-ratio", "performance", "low", "warn"),
    _rule("cwv", "performance", (f"NOT {_PSI}", "low", "info"), always="true"), _rule("cwv-score", "performance", ("g % 7 IN (2, 5)", "high", "pass"), ("g % 7 = 3", "high", "warn"), ("g % 7 = 4", "high", "fail"), always="true"),
    _rule("cwv-field", "performance", ("g % 7 = 5", "low", "info"), ("g % 7 = 2", "high", "pass"), ("g % 7 = 3", "high", "warn"), ("g % 7 = 4", "high", "fail"), always="true"), _rule("https", "security", ("g % 6 = 1", "high", "fail"), ("true", "high", "pass")), _rule("ssl-chain-incomplete", "security", ("g % 7 = 2", "high", "fail")),
    _flag("mixed-content", "security", "med", "fail"), _rule("security-headers", "security", ("g % 3 = 0 OR g % 5 = 4 OR (g % 2 <> 0 AND g % 4 <> 1)", "low", "warn"), ("true", "low", "pass")), _flag("spa-shell", "rendering", "high", "fail", good="high"),
    _rule("render-diff", "rendering", ("g % 5 = 0 AND n_render_diff > 0", "high", "fail"), ("g % 5 = 0", "high", "pass"), ("g % 5 = 1", "high", "warn"), ("g % 5 = 2", "low", "info")), _flag("noscript-fallback", "rendering", "low", "warn", "noscript_missing"), _flag("charset-not-utf8", "technical", "med", "warn", "charset_other"),
    _rule("geo-bot-access", "geo", (f"NOT {_HAS_ROBOTS}", "med", "warn"), ("g % 6 IN (1, 3)", "high", "fail"), ("g % 6 IN (2, 5)", "med", "warn"), ("true", "high", "pass")), _rule("geo-llms-txt", "geo", ("g % 4 = 2", "low", "pass"), ("true", "low", "info")),
    _flag("geo-spa-risk", "geo", "high", "fail", "spa_shell", "high"), _rule("geo-faq-schema", "geo", ("n_ld_faq = 0", "med", "warn"), ("true", "med", "pass")), _rule("geo-qa-content", "geo", ("n_question = 0", "med", "warn"), ("true", "med", "pass")),
    _rule("geo-eeat", "geo", ("n_author + n_ld_person = 0 OR n_dated = 0 OR n_same_as = 0", "med", "warn"), ("true", "med", "pass")), _rule("geo-citable", "geo", ("n_citable < least(3, n_ok)", "low", "warn"), ("true", "low", "pass")),
    _rule("geo-trust-pages", "geo", (f"{_ABSENT} >= 3", "med", "fail"), (f"{_ABSENT} > 0", "med", "warn"), ("true", "med", "pass")), _rule("geo-entity", "geo", ("n_ld_org = 0", "med", "warn"), ("true", "med", "pass")),
]


def _duplicates(flag: str, key: str) -> str:
    """Pages of a language that share a key, if they differ in more than their locale."""
    return f"""SELECT site_id, j, url, '{flag}' AS flag FROM (SELECT *, count(*) OVER w AS n, len(list_distinct(list(place) OVER w)) AS places FROM (
      SELECT *, {key} AS key FROM ok WHERE {_ELIGIBLE} AND search <> '?page=2' AND path <> '/page/2') WHERE key <> '' WINDOW w AS (PARTITION BY site_id, tongue, key)) WHERE n > 1 AND places = n"""


_NAMED = ", ".join(f"CASE WHEN {c} THEN '{n.rstrip('_')}' END" for n, c in FLAGS.items())
_FLAGGED = f"""{INPUTS_SQL},
ok AS (SELECT *, concat(origin, regexp_replace(path, '^/(en|th)/', '/')) AS place, CASE WHEN lang <> '' THEN split_part(lang, '-', 1) WHEN path LIKE '/en/%' THEN 'en' WHEN path LIKE '/th/%' THEN 'th' ELSE '' END AS tongue FROM made WHERE status = 200 AND NOT blocked),
targets AS (SELECT DISTINCT site_id, concat(origin, unnest(list_concat(CASE WHEN few_links THEN ['/p1'] ELSE ['/p1', '/p2', '/p3', '/p4', '/p5'] END, [CASE WHEN to_contact THEN '/contact' ELSE '/e' END]))) AS target FROM ok),
flags AS (
  SELECT site_id, j, url, unnest(list_filter([{_NAMED}], lambda f: f IS NOT NULL)) AS flag FROM ok
  UNION ALL SELECT site_id, j, url, CASE WHEN status = 404 THEN 'gone' ELSE 'refused' END FROM made WHERE status >= 400
  UNION ALL SELECT site_id, j, url, 'orphan' FROM ok o WHERE j <> 0 AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.site_id = o.site_id AND t.target = o.url)
  UNION ALL SELECT site_id, j, url, 'not_in_sitemap' FROM ok WHERE (g % 4 = 1 AND j = 7) OR (g % 4 IN (2, 3) AND j <> 0)
  UNION ALL SELECT a.site_id, a.j, a.url, 'slash_twin' FROM ok a JOIN ok b ON a.site_id = b.site_id AND (a.path = b.path || '/' OR b.path = a.path || '/') AND a.path <> '/' AND b.path <> '/'
  UNION ALL SELECT a.site_id, a.j, a.url || ' ↔ ' || b.url, 'near_duplicate' FROM ok a JOIN ok b ON a.site_id = b.site_id AND a.j < b.j WHERE a.same_text AND b.same_text AND NOT a.thin AND NOT b.thin AND NOT a.shell AND NOT b.shell
  UNION ALL {_duplicates("dup_title", "title")} UNION ALL {_duplicates("dup_desc", "trim(descr)")}
  UNION ALL {_duplicates("dup_h1", f"CASE WHEN NOT {_USABLE} THEN '' WHEN h1_same THEN 'One heading of many pages' ELSE concat('Heading ', j) END")}
)"""
FLAGS_SQL = f"WITH {_FLAGGED} SELECT site_id, CAST(j AS INTEGER) AS page_ord, url, flag FROM flags"
ORPHANS_SQL = f"WITH {_FLAGGED} SELECT site_id, CAST(j AS INTEGER) AS page_ord, url FROM flags WHERE flag = 'orphan'"
HEADINGS_SQL = f"WITH {_FLAGGED} SELECT site_id, CAST(j AS INTEGER) AS page_ord, jump AS jumps FROM ok"


def checks_sql() -> str:
    flags = [f.rstrip("_") for f in FLAGS] + list(_EXTRA)
    ids = [r.split("'")[1] for r in _RULES]
    shows = [(id_, f) for id_ in ids if id_ not in _SITE_ONLY for f in SHOWS.get(id_, (id_.replace("-", "_"),))]
    return f"""WITH {_FLAGGED}, counts AS (SELECT site_id, {", ".join(f"count(*) FILTER (flag = '{f}') AS n_{f}" for f in flags)} FROM flags GROUP BY site_id),
oks AS (SELECT site_id, count(*) AS n_ok,
  sum(CASE WHEN {_R} THEN 1 + no_alt::INT + empty_alt::INT ELSE CASE WHEN gallery THEN 6 ELSE 1 END + mixed::INT END) AS images, sum(no_alt::INT) AS images_missing, sum(CASE WHEN {_R} AND empty_alt THEN 1 ELSE 0 END) AS images_empty,
  sum(CASE WHEN gallery THEN 6 ELSE 1 END + mixed::INT) AS raw_images, sum(CASE WHEN lazy THEN 0 WHEN gallery THEN 6 ELSE 1 END + mixed::INT) AS not_lazy, sum(CASE WHEN sized THEN 0 WHEN gallery THEN 6 ELSE 1 END + mixed::INT) AS no_size FROM ok GROUP BY site_id),
facts AS (SELECT s.site_id, g, {", ".join(f"coalesce(n_{f}, 0) AS n_{f}" for f in flags)}, coalesce(n_ok, 0) AS n_ok, images, images_missing, images_empty, raw_images, not_lazy, no_size
  FROM (SELECT DISTINCT site_id, g FROM made) s LEFT JOIN counts ON counts.site_id = s.site_id LEFT JOIN oks ON oks.site_id = s.site_id),
found AS ({" UNION ALL ".join(_RULES)}),
shows(id, flag) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in shows)}),
shown AS (SELECT f.site_id, s.id, count(*) AS n, string_agg(f.url, ' ' ORDER BY f.j, f.url) AS pages FROM flags f JOIN shows s ON s.flag = f.flag
  WHERE NOT (f.flag = 'unsigned' AND EXISTS (SELECT 1 FROM facts x WHERE x.site_id = f.site_id AND x.n_ld_person > 0)) GROUP BY f.site_id, s.id)
SELECT found.site_id, found.id, category, severity, status, coalesce(n, 0) AS affected_count, coalesce(pages, '') AS pages FROM found LEFT JOIN shown ON shown.site_id = found.site_id AND shown.id = found.id WHERE severity IS NOT NULL"""


#: What the parser finds in the HTML, from the features.
EXTRACT_SQL = f"""WITH {INPUTS_SQL}
SELECT site_id, CAST(j AS INTEGER) AS page_ord, url, trim(title) AS title, lang, CASE canon WHEN 'none' THEN '' WHEN 'relative' THEN '/rel' WHEN 'away' THEN 'https://elsewhere.example/x' ELSE url END AS canonical,
  CASE WHEN canon = 'none' THEN 0 WHEN canon_twice THEN 2 ELSE 1 END AS canonical_count, g % 3 <> 2 AS favicon, {_INTERNAL} AS links, CASE WHEN gallery THEN 6 ELSE 1 END + mixed::INT AS images,
  CASE h1 WHEN 'none' THEN 0 WHEN 'two' THEN 2 ELSE 1 END + 2 + empty_h3::INT AS headings, (h1 = 'empty')::INT + empty_h3::INT AS empty_headings, (h1 = 'hidden')::INT AS hidden_h1, CASE WHEN ld = 'none' THEN 0 ELSE 1 END AS json_ld,
  2 + CASE WHEN blocking THEN 2 ELSE 0 END + CASE WHEN third THEN 9 ELSE 0 END + CASE WHEN many_scripts THEN 26 ELSE 0 END AS scripts, CASE WHEN blocking THEN 3 ELSE 1 END AS head_blocking_scripts,
  CASE WHEN bloat THEN 200001 ELSE 0 END + CASE ld {" ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in _LD.items())} ELSE 0 END AS inline_script_bytes, CASE hreflang WHEN 'good' THEN 2 WHEN 'bad' THEN 1 ELSE 0 END AS hreflang,
  CASE WHEN lists THEN 3 ELSE 0 END AS list_count, in_table AS has_tables, NOT no_doctype AS has_doctype, old_tag::INT AS deprecated_tags, refresh AS meta_refresh, phone AS has_phone, mail AS has_mailto, nullif(copyright, 0) AS max_copyright_year,
  noscript AS has_noscript, shell AS empty_root, CASE WHEN signed THEN 'Ann' WHEN ld = 'article' THEN 'P' ELSE '' END AS author, CASE WHEN ld = 'org' THEN regexp_replace(concat(origin, path), '[^/]*$', 'l.png') WHEN og = 'all' THEN 'https://cdn.example/i.png' WHEN og = 'relative' THEN regexp_replace(concat(origin, path), '[^/]*$', 'img.png') ELSE '' END AS logo FROM made"""


def made_extract(pages: DataFrame) -> DataFrame:
    sizes = ("links", "images", "headings", "json_ld", "scripts", "hreflang")
    plain = ("site_id", "page_ord", "url", "title", "lang", "canonical", "canonical_count", "favicon", "empty_headings", "hidden_h1", "head_blocking_scripts", "inline_script_bytes", "list_count", "has_tables", "has_doctype", "deprecated_tags", "meta_refresh", "has_phone", "has_mailto")
    return pages.select(*plain, "max_copyright_year", "has_noscript", "empty_root", "author", "logo", *[F.size(c).alias(c) for c in sizes])
