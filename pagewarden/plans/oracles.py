"""The same queries as SQL for DuckDB, written from their definitions."""

from __future__ import annotations

from ..functions.text import ARIAL
from ..operators.audits import CRITERIA_DIMS, FACT_DIMS, GROUPS, UNSTABLE
from ..operators.confidence import DETERMINISTIC, DIMENSION, JUDGED, RULE
from ..operators.fixes import FIX_FOR_CHECK
from ..operators.robots import AI_BOTS
from ..operators.scoring import CATEGORY
from . import pieces, repairs, reports
from .crawl import AUDITS_SQL, CRAWL_SQL, FINDINGS_SQL, LINKS_SQL, PREVIOUS_SQL
from .made import EXTRACT_SQL, FLAGS_SQL, HEADINGS_SQL, INPUTS_SQL, ORPHANS_SQL, checks_sql
from .queries import PROFILE, SQL_CHECKS, WORDS

REPEAT = "(?i)[?&](page|p|start|offset|sort|filter|q|s|search|tag|year|ref)="
PX = f"""CAST(floor(list_sum(list_transform(string_split({{0}}, ''), lambda c:
  CASE WHEN c = '' THEN 0 WHEN unicode(c) BETWEEN 32 AND 126 THEN {list(ARIAL)}[unicode(c) - 31]
       WHEN unicode(c) = 3633 OR unicode(c) BETWEEN 3636 AND 3642 OR unicode(c) BETWEEN 3655 AND 3662 THEN 0 WHEN unicode(c) BETWEEN 3584 AND 3711 THEN 540
       WHEN unicode(c) BETWEEN 12288 AND 40959 OR unicode(c) BETWEEN 44032 AND 55203 OR unicode(c) BETWEEN 63744 AND 64255 THEN 1000 ELSE 556 END)) * 20 / 1000.0 + 0.5) AS BIGINT)"""
NORM = "trim(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[​-‍﻿]', '', 'g'), '[\\s   -     　﻿]+', ' ', 'g'))"
BIGRAMS = "list_distinct(list_transform(range(length({0}) - 1), lambda i: substr({0}, CAST(i + 1 AS INTEGER), 2)))"
SQUEEZE = "regexp_replace(lower({0}), '[\\s|·\\-–—_:,.!?()\\[\\]]+', '', 'g')"
LANG = "CASE WHEN lower(regexp_extract(lang, '^([^-_]*)', 1)) <> '' THEN lower(regexp_extract(lang, '^([^-_]*)', 1)) ELSE lower(regexp_extract(path, '(?i)^/([a-z][a-z])(-[a-z][a-z])?(/|$)', 1)) END"
BARE = "scheme || '://' || {0} || regexp_replace(path, '(?i)^/[a-z][a-z](-[a-z][a-z])?(/|$)', '/')"
HOST0 = "regexp_replace(site_id, '^www\\.', '')"
PATH0 = "regexp_replace(path, '/$', '')"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _crawl(body: str) -> str:
    return f"{_with(CRAWL_SQL)} {body}"


def _links(body: str, more: str = "") -> str:
    return f"{_with(CRAWL_SQL, LINKS_SQL)}{more} {body}"


PAGE_BASIC = _crawl("""SELECT page_id, site_id, title, h1_text, lang, status, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links, CAST(length(html) AS BIGINT) AS html_chars, starts_with(html, '<!DOCTYPE html>') AS doctype FROM crawl""")

URLS = _crawl(f"""SELECT page_id, scheme, site_id AS host, path, search, CAST(len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS BIGINT) AS depth,
  CASE WHEN len(string_split({HOST0}, '.')) <= 2 THEN {HOST0}
       WHEN array_to_string(list_slice(string_split({HOST0}, '.'), -2, -1), '.') IN ('co.th','or.th','ac.th','go.th','in.th','co.uk','com.au','co.jp','com.sg','co.kr') THEN array_to_string(list_slice(string_split({HOST0}, '.'), -3, -1), '.')
       ELSE array_to_string(list_slice(string_split({HOST0}, '.'), -2, -1), '.') END AS domain,
  {BARE.format("site_id")} AS no_locale,
  lower(regexp_extract(path, '(?i)^/([a-z][a-z])(-[a-z][a-z])?(/|$)', 1)) AS path_lang, {HOST0} || {PATH0} AS site_path,
  regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/+$', '') AS no_scheme, {HOST0} || {PATH0} || CASE WHEN search = '?' THEN '' ELSE search END AS site_key,
  scheme || '://' || {HOST0} || {PATH0} AS sitemap_key FROM crawl""")

NORMALIZED = _crawl("""SELECT page_id, scheme || '://' || site_id || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normalized
  FROM (SELECT *, list_filter(string_split(substr(search, 2), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid'], string_split(p, '=')[1])) AS kept FROM crawl)""")

WIDTHS = _crawl(f"""SELECT page_id, px, graphemes, CASE WHEN px > 600 OR graphemes BETWEEN 1 AND 14 THEN 'warn' ELSE 'pass' END AS title_length
  FROM (SELECT page_id, coalesce({PX.format("title")}, 0) AS px, CAST(length_grapheme(title) AS BIGINT) AS graphemes FROM crawl)""")

SIMILARITY = f"""WITH {INPUTS_SQL} SELECT site_id, j AS page_ord, CASE WHEN a = '' OR b = '' THEN NULL WHEN contains(a, b) OR contains(b, a) THEN 1.0
       ELSE floor(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0) * 100 + 0.5) / 100 END AS similarity
  FROM (SELECT *, {BIGRAMS.format("a")} AS x, {BIGRAMS.format("b")} AS y FROM (
    SELECT site_id, j, {SQUEEZE.format("title")} AS a, CASE WHEN h1 IN ('none', 'empty') THEN '' WHEN h1_same THEN 'oneheadingofmanypages' ELSE concat('heading', j) END AS b FROM made))"""

DUP_TITLES = _crawl(f"""SELECT site_id, language, key, count(*) AS n, arg_min(title, page_ord) AS value, bool_or(path = '/') AS has_root
  FROM (SELECT *, {LANG} AS language, {NORM.format("title")} AS key, {BARE.format("site_id")} AS place FROM crawl WHERE status = 200 AND NOT regexp_matches(search, '{REPEAT}'))
  WHERE key <> '' GROUP BY site_id, language, key HAVING count(*) > 1 AND count(DISTINCT place) = count(*)""")

DUP_DOCS = f"""SELECT lang, md5(key) AS key, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc
  FROM (SELECT lang, doc_id, {NORM.format("text").replace("nfc_normalize(text)", "text")} AS key FROM documents) GROUP BY lang, key HAVING count(*) > 1"""

NEAR_DOCS = """WITH every AS MATERIALIZED (SELECT source, doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 3))) AS t FROM documents),
named AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY source, t) AS rep FROM every WHERE len(t) >= 30),
pairs AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.t, y.t)) AS common, len(x.t) + len(y.t) AS total FROM named x JOIN named y ON x.source = y.source AND x.doc_id < y.doc_id
  WHERE x.rep = x.doc_id AND y.rep = y.doc_id AND len(x.t) > len(y.t) * 0.85 AND len(y.t) > len(x.t) * 0.85)
SELECT source, a, b, round(common / (total - common), 6) AS similarity FROM pairs WHERE common / (total - common) > 0.85
UNION ALL SELECT source, rep, doc_id, 1.0 FROM named WHERE rep <> doc_id"""

TWINS = f"""{_with(CRAWL_SQL)}, base AS (
  SELECT site_id, page_id * 2 AS page_ord, url, scheme || '://' || site_id || path AS key FROM crawl WHERE status = 200
), every AS (
  SELECT * FROM base UNION ALL
  SELECT site_id, page_ord + 1, CASE WHEN ends_with(key, '/') THEN regexp_replace(key, '/$', '') ELSE key || '/' END, CASE WHEN ends_with(key, '/') THEN regexp_replace(key, '/$', '') ELSE key || '/' END FROM base WHERE page_ord % 3 = 0
), spots AS (SELECT site_id, key, arg_max(url, page_ord) AS twin FROM every GROUP BY site_id, key)
SELECT e.site_id, e.page_ord, e.url, s.twin FROM every e JOIN spots s ON e.site_id = s.site_id AND s.key = CASE WHEN ends_with(e.key, '/') AND e.key <> regexp_extract(e.key, '^[a-z]+://[^/]*/') THEN e.key[:-2] ELSE e.key || '/' END
WHERE s.twin <> e.url"""

INLINKS = _links("SELECT site_id, target, count(*) AS inlinks FROM links GROUP BY site_id, target")
HEALTH_ORPHANS = _links("""SELECT site_id, url FROM (SELECT c.*, row_number() OVER (PARTITION BY c.site_id ORDER BY page_ord) AS r FROM crawl c WHERE status = 200 AND path <> '/'
  AND NOT EXISTS (SELECT 1 FROM links l WHERE l.internal AND l.site_id = c.site_id AND l.target = c.url)) WHERE r <= 8""")
BROKEN = _links("""SELECT site_id, target, rank FROM (SELECT site_id, target, row_number() OVER (PARTITION BY site_id ORDER BY target) AS rank
  FROM (SELECT DISTINCT site_id, target FROM links l WHERE internal AND NOT EXISTS (SELECT 1 FROM crawl c WHERE c.site_id = l.site_id AND c.url = l.target))) WHERE rank <= 40""")
_ANCHORS = """, anchors AS (SELECT site_id, substr(lower(trim(text)), 1, 120) AS anchor, count(*) AS n FROM links WHERE internal AND length(substr(lower(trim(text)), 1, 120)) > 1 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, anchor) AS rank FROM anchors) WHERE rank <= 8)"""
ANCHORS = _links("SELECT * FROM top", _ANCHORS)
HEALTH = _links("""SELECT b.site_id, internal, external, nofollow, coalesce(u, 0) AS unique_anchors, coalesce(o, 0) AS over_optimised,
  CASE WHEN internal > 0 THEN CAST(floor(nofollow / internal * 100 + 0.5) AS BIGINT) ELSE 0 END AS nofollow_pct, CASE WHEN internal > 0 THEN least(100, CAST(floor(coalesce(u, 0) / internal * 150 + 0.5) AS BIGINT)) ELSE 0 END AS diversity
  FROM (SELECT site_id, count(*) FILTER (internal) AS internal, count(*) FILTER (NOT internal) AS external, count(*) FILTER (internal AND contains(rel, 'nofollow')) AS nofollow FROM links GROUP BY site_id) b
  LEFT JOIN (SELECT site_id, count(*) AS u FROM anchors GROUP BY site_id) a ON a.site_id = b.site_id
  LEFT JOIN (SELECT t.site_id, count(*) FILTER (i > 5 AND n / i > 0.4) AS o FROM top t JOIN (SELECT site_id, count(*) FILTER (internal) AS i FROM links GROUP BY site_id) x ON x.site_id = t.site_id GROUP BY t.site_id) v ON v.site_id = b.site_id""", _ANCHORS)

PARAMS = _crawl("""SELECT site_id, url, ord FROM (SELECT *, row_number() OVER (PARTITION BY site_id, scheme, l, has ORDER BY ord, url) AS r FROM (
    SELECT site_id, scheme, lower(regexp_extract(path, '(?i)^/([a-z][a-z])(-[a-z][a-z])?(/|$)', 1)) AS l, search <> '' AS has,
           scheme || '://' || site_id || '/' || lower(regexp_extract(path, '(?i)^/([a-z][a-z])(-[a-z][a-z])?(/|$)', 1)) || search || CASE WHEN search <> '' THEN '&n=' || page_id ELSE '' END AS url, page_ord AS ord FROM crawl)) WHERE NOT has OR r <= 3""")

FINALS = _crawl(f"""SELECT site_id, page_id, url, final AS final_url FROM (SELECT *, row_number() OVER (PARTITION BY site_id, final ORDER BY url <> final, page_ord) AS r FROM (SELECT *, {BARE.format("site_id")} AS final FROM crawl)) WHERE r = 1""")

#: (kind of robots.txt, group, agents, order, type, path) of the robots files that the queries make up.
_RULES = [
    (0, 1, "*", 1, "disallow", "/en/"), (0, 1, "*", 2, "allow", "/en/4"), (0, 2, "gptbot,ccbot", 1, "disallow", "/"), (1, 1, "googlebot", 1, "allow", "/"), (1, 2, "*", 1, "disallow", "/*.html"), (1, 2, "*", 2, "disallow", "/de/"), (1, 2, "*", 3, "allow", "/de/8"),
    (3, 1, "bot", 1, "disallow", "/fr"), (3, 1, "bot", 2, "allow", "/fr"), (3, 2, "*", 1, "disallow", "/es/"), (4, 1, "*", 1, "disallow", "/"),
]
_ROBOTS = f"""rules(kind, grp, agents, ord, type, rule) AS (VALUES {", ".join(str(r) for r in _RULES)}),
sites AS (SELECT DISTINCT site_id, length(site_id) % 5 AS kind FROM crawl)"""
ROBOT_RULES = f"{_with(CRAWL_SQL, _ROBOTS)} SELECT site_id, CAST(grp AS BIGINT) AS group_ord, agents, type, rule AS path FROM sites JOIN rules ON rules.kind = sites.kind"
BOTS = f"""{_with(CRAWL_SQL, _ROBOTS)}, bots(ua) AS (VALUES {", ".join(f"('{b}')" for b in AI_BOTS)}),
fits AS (SELECT ua, kind, grp, agent = '*' AS star FROM bots, (SELECT DISTINCT kind, grp, unnest(string_split(agents, ',')) AS agent FROM rules) WHERE agent = '*' OR contains(lower(ua), agent)),
pick AS (SELECT ua, kind, grp FROM (SELECT *, row_number() OVER (PARTITION BY ua, kind ORDER BY star, grp) AS r FROM fits) WHERE r = 1),
asked AS (SELECT DISTINCT site_id, path, kind, ua FROM (SELECT site_id, path FROM crawl UNION SELECT site_id, '/' FROM crawl) JOIN sites USING (site_id), bots),
hits AS (SELECT a.site_id, a.path, a.ua, r.type, row_number() OVER (PARTITION BY a.site_id, a.path, a.ua ORDER BY length(r.rule) DESC, r.type = 'allow' DESC) AS k
  FROM asked a JOIN pick p ON p.ua = a.ua AND p.kind = a.kind JOIN rules r ON r.kind = a.kind AND r.grp = p.grp
  WHERE regexp_matches(a.path, '^' || replace(replace(r.rule, '.', '\\.'), '*', '.*')))
SELECT a.site_id, a.ua, a.path, coalesce(h.type = 'allow', true) AS allowed FROM asked a LEFT JOIN hits h ON h.site_id = a.site_id AND h.path = a.path AND h.ua = a.ua AND h.k = 1"""

_ALWAYS = [("desc-missing", "onpage", "med", "fail"), ("viewport-missing", "onpage", "high", "fail"), ("og-tags", "schema", "high", "fail"), ("jsonld-missing", "schema", "high", "fail")]
_SITE_ONLY = [("favicon-missing", "onpage", "low", "warn"), ("twitter-card", "schema", "low", "warn"), ("sitemap-exists", "index", "med", "fail"), ("geo-llms-txt", "geo", "low", "info"), ("compression", "performance", "med", "warn"), ("security-headers", "security", "low", "warn")]
CHECKS = f"""{_with(CRAWL_SQL)}, ok AS (SELECT *, coalesce({PX.format("trim(title)")}, 0) > 600 OR length_grapheme(trim(title)) BETWEEN 1 AND 14 AS odd FROM crawl WHERE status = 200),
s AS (SELECT site_id, count(*) AS n, count(*) FILTER (trim(title) = '') AS no_title, count(*) FILTER (odd) AS odd, count(*) FILTER (lang = '') AS no_lang, count(*) FILTER (search NOT IN ('', '?')) AS q,
             count(*) FILTER (regexp_matches(path, '[A-Z]') OR length(path) > 115) AS bad_path FROM ok GROUP BY site_id),
dup AS (SELECT DISTINCT site_id FROM (SELECT site_id, {LANG} AS l, {NORM.format("title")} AS key, count(*) AS n, count(DISTINCT {BARE.format("site_id")}) AS m FROM ok WHERE NOT regexp_matches(search, '{REPEAT}') AND NOT regexp_matches(path, '(?i)/page/[0-9]') GROUP BY ALL) WHERE key <> '' AND n > 1 AND n = m),
first AS (SELECT site_id, scheme = 'https' AS https FROM crawl WHERE page_ord = 1),
gone AS (SELECT site_id, count(*) FILTER (status IN (404, 410)) AS gone, count(*) FILTER (status >= 400 AND status NOT IN (404, 410)) AS refused FROM crawl GROUP BY site_id),
rows AS (
  {" UNION ALL ".join(f"SELECT site_id, '{a}' AS id, '{b}' AS category, '{c}' AS severity, '{d}' AS status, n AS affected_count FROM s" for a, b, c, d in _ALWAYS)}
  UNION ALL {" UNION ALL ".join(f"SELECT site_id, '{a}', '{b}', '{c}', '{d}', 0 FROM s" for a, b, c, d in _SITE_ONLY)}
  UNION ALL SELECT site_id, 'title-missing', 'onpage', 'high', CASE WHEN no_title > 0 THEN 'fail' ELSE 'pass' END, no_title FROM s
  UNION ALL SELECT site_id, 'title-length', 'onpage', 'med', CASE WHEN odd > 0 THEN 'warn' ELSE 'pass' END, odd FROM s
  UNION ALL SELECT site_id, 'lang-missing', 'onpage', 'low', CASE WHEN no_lang > 0 THEN 'warn' ELSE 'pass' END, no_lang FROM s
  UNION ALL SELECT site_id, 'https', 'security', 'high', CASE WHEN https THEN 'pass' ELSE 'fail' END, 0 FROM s JOIN first USING (site_id)
  UNION ALL SELECT site_id, 'canonical-missing', 'index', CASE WHEN q > 0 OR dup.site_id IS NOT NULL THEN 'high' ELSE 'low' END, CASE WHEN q > 0 OR dup.site_id IS NOT NULL THEN 'fail' ELSE 'warn' END, n FROM s LEFT JOIN dup USING (site_id)
  UNION ALL SELECT site_id, 'error-pages', 'index', 'high', 'fail', gone FROM s JOIN gone USING (site_id) WHERE gone > 0
  UNION ALL SELECT site_id, 'crawl-blocked', 'index', 'med', 'info', refused FROM s JOIN gone USING (site_id) WHERE refused > 0
  UNION ALL SELECT site_id, 'url-hygiene', 'onpage', 'low', 'warn', bad_path FROM s WHERE bad_path > 0
  UNION ALL SELECT site_id, 'robots-sitemap', 'index', 'low', CASE WHEN length(site_id) % 5 = 2 THEN 'pass' ELSE 'warn' END, 0 FROM s
  UNION ALL SELECT DISTINCT site_id, 'cwv', 'performance', 'low', 'info', 0 FROM crawl)
SELECT * FROM rows WHERE id IN ({", ".join(f"'{c}'" for c in SQL_CHECKS)})"""

_CATW = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CATEGORY.items()) + " ELSE 5 END"
_W = "CASE severity WHEN 'high' THEN 10 WHEN 'med' THEN 5 ELSE 2 END"
_SCORES = f"""cats AS (SELECT audit_id, category, CAST(floor((1 - sum({_W} * CASE status WHEN 'fail' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.45::DOUBLE ELSE 0 END) / sum({_W})) * 100 + 0.5) AS INTEGER) AS score FROM findings WHERE status <> 'info' GROUP BY audit_id, category)"""
_SITES = f"""scored AS (SELECT f.audit_id, coalesce(o, 0) AS overall, CASE WHEN coalesce(o, 0) >= 90 THEN 'A' WHEN coalesce(o, 0) >= 75 THEN 'B' WHEN coalesce(o, 0) >= 60 THEN 'C' WHEN coalesce(o, 0) >= 45 THEN 'D' ELSE 'F' END AS grade, fails, warns, passes
  FROM (SELECT audit_id, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'warn') AS warns, count(*) FILTER (status = 'pass') AS passes FROM findings GROUP BY audit_id) f
  LEFT JOIN (SELECT audit_id, CAST(floor(sum(score * {_CATW}) / sum({_CATW}) + 0.5) AS INTEGER) AS o FROM cats GROUP BY audit_id) c ON c.audit_id = f.audit_id)"""
CATS = f"{_with(FINDINGS_SQL, _SCORES)} SELECT * FROM cats"
SITES = f"{_with(FINDINGS_SQL, _SCORES, _SITES)} SELECT * FROM scored"
GRADES = f"{_with(FINDINGS_SQL, _SCORES, _SITES)} SELECT grade, count(*) AS audits, round(avg(overall), 6) AS mean_score FROM scored GROUP BY grade"

PREVIOUS = f"{_with(AUDITS_SQL, PREVIOUS_SQL)} SELECT audit_id, prev_id FROM previous"
LATEST = f"{_with(AUDITS_SQL)} SELECT audit_id, site_id, overall FROM (SELECT *, row_number() OVER (PARTITION BY nurl ORDER BY created_at DESC, audit_id DESC) AS r FROM audits) WHERE r = 1"
HISTORY = f"{_with(AUDITS_SQL)} SELECT audit_id, overall, overall - lag(overall) OVER (PARTITION BY nurl ORDER BY created_at, audit_id) AS trend FROM audits"
_DELTA = f"""pairs AS MATERIALIZED (
  SELECT p.audit_id, p.prev_id, abs(p.pages_analyzed - o.pages_analyzed) > greatest(4.0, o.pages_analyzed * 0.2) AS moved, coalesce(p.engine_version, 0) <> coalesce(o.engine_version, 0) AS engine
  FROM previous p JOIN audits o ON o.audit_id = p.prev_id
), each AS MATERIALIZED (
  SELECT audit_id, id, max(f) AS f, max(t) AS t FROM (
    SELECT audit_id, id, NULL AS f, status AS t FROM findings
    UNION ALL SELECT p.audit_id, n.id, n.status, NULL FROM findings n JOIN pairs p ON p.prev_id = n.audit_id) GROUP BY audit_id, id
), joined AS (
  SELECT p.*, e.id, e.f, e.t FROM each e JOIN pairs p ON p.audit_id = e.audit_id WHERE e.t IS NOT NULL
), judged AS (
  SELECT *, f IS NULL AND t IN ('fail', 'warn') AS fresh, (f IN ('fail', 'warn') AND t NOT IN ('fail', 'warn')) OR (f = 'fail' AND t = 'warn') AS better, (f NOT IN ('fail', 'warn') AND t IN ('fail', 'warn')) OR (f = 'warn' AND t = 'fail') AS worse FROM joined
), delta AS (
  SELECT audit_id, prev_id, id, coalesce(f, '—') AS from_status, t AS to_status,
         CASE WHEN id IN ({", ".join(f"'{u}'" for u in UNSTABLE)}) OR moved OR (fresh AND engine) THEN 'explained' WHEN fresh THEN 'new' WHEN better THEN 'fixed' ELSE 'regressed' END AS change,
         CASE WHEN id IN ({", ".join(f"'{u}'" for u in UNSTABLE)}) THEN 'unstable' WHEN moved THEN 'scope' WHEN fresh AND engine THEN 'engine' END AS reason
  FROM judged WHERE fresh OR coalesce(better OR worse, false)
)"""
DELTA = f"{_with(AUDITS_SQL, PREVIOUS_SQL, FINDINGS_SQL, _DELTA)} SELECT * FROM delta"
CAT_DELTA = f"""{_with(AUDITS_SQL, PREVIOUS_SQL, FINDINGS_SQL, _SCORES)}, scores AS MATERIALIZED (SELECT * FROM cats),
p AS MATERIALIZED (SELECT audit_id, prev_id FROM previous WHERE prev_id IS NOT NULL)
SELECT audit_id, category, CAST(sum(score) AS INTEGER) AS delta FROM (
  SELECT p.audit_id, c.category, c.score FROM scores c JOIN p ON p.audit_id = c.audit_id
  UNION ALL SELECT p.audit_id, c.category, -c.score FROM scores c JOIN p ON p.prev_id = c.audit_id) GROUP BY audit_id, category"""
ALERTS = f"""{_with(AUDITS_SQL, PREVIOUS_SQL, FINDINGS_SQL, _DELTA)}, c AS (SELECT audit_id, count(*) FILTER (change = 'regressed') AS regressed, count(*) FILTER (change = 'new') AS new FROM delta GROUP BY audit_id)
SELECT * FROM (SELECT p.audit_id, o.overall AS prev_score, p.overall AS score, coalesce(regressed, 0) AS regressed, coalesce(new, 0) AS new FROM previous p JOIN audits o ON o.audit_id = p.prev_id LEFT JOIN c ON c.audit_id = p.audit_id)
WHERE score < prev_score - 3 OR regressed + new > 0"""

_SAY = "CASE WHEN ({0}) % 8 = 7 THEN 'n/a' WHEN ({0}) % 3 = 0 THEN 'fail' ELSE 'pass' END"
_VERIFY = f"""dims(k, dim) AS (VALUES {", ".join(f"({k}, '{d}')" for k, d in enumerate([*FACT_DIMS, *CRITERIA_DIMS]))}),
verdicts AS (SELECT * FROM (SELECT event_id AS audit_id, dim, CASE WHEN k < {len(FACT_DIMS)} THEN 'fact' ELSE 'criteria' END AS kind, {_SAY.format("event_id * 5 + k * 3")} AS ours, {_SAY.format("event_id * 5 + k * 3 + event_id // 9 % 2")} AS theirs FROM events, dims) WHERE ours <> 'n/a' AND theirs <> 'n/a')"""
CROSS = f"""{_with(_VERIFY)} SELECT audit_id, facts, fact_agree, CASE WHEN facts > 0 THEN CAST(floor(fact_agree / facts * 100 + 0.5) AS BIGINT) END AS fact_pct, mismatches, mismatches <> '' AS flag FROM (
  SELECT audit_id, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'fact' AND ours = theirs) AS fact_agree,
         coalesce(string_agg(CASE WHEN kind = 'fact' AND ours <> theirs THEN dim || '(ours:' || ours || '/theirs:' || theirs || ')' END, ' ' ORDER BY dim), '') AS mismatches FROM verdicts GROUP BY audit_id)"""
_PCT = "CASE WHEN {0} + {1} > 0 THEN floor({0} / ({0} + {1}) * 1000 + 0.5) / 10 END AS {2}"
_METRICS = ", ".join(_PCT.format(*x) for x in (("tp", "fp", "precision"), ("tp", "fn", "recall"), ("fp", "tn", "fpr"), ("fn", "tp", "fnr")))
_CELLS = "count(*) FILTER (ours = 'fail' AND theirs = 'fail') AS tp, count(*) FILTER (ours = 'fail' AND theirs <> 'fail') AS fp, count(*) FILTER (ours <> 'fail' AND theirs = 'fail') AS fn, count(*) FILTER (ours <> 'fail' AND theirs <> 'fail') AS tn"
CONFUSION = f"""{_with(_VERIFY)} SELECT dim, tp, fp, fn, tn, {_METRICS} FROM (SELECT dim, {_CELLS} FROM verdicts WHERE kind = 'fact' GROUP BY dim UNION ALL SELECT 'all', {_CELLS} FROM verdicts WHERE kind = 'fact')"""
LABELS = f"""SELECT tp, fp, fn, tn, {_METRICS} FROM (SELECT {_CELLS} FROM (SELECT CASE WHEN regexp_matches(text, '%%%|###|&&&') OR contains(text, '!!') THEN 'fail' ELSE 'pass' END AS ours, CASE WHEN quality = 0 THEN 'fail' ELSE 'pass' END AS theirs FROM documents JOIN labels USING (doc_id)))"""

_PRIO = "CASE WHEN severity = 'high' AND status = 'fail' THEN 1 WHEN (severity = 'high' AND status = 'warn') OR (severity = 'med' AND status = 'fail') THEN 2 WHEN severity = 'med' AND status = 'warn' THEN 3 ELSE 4 END"
_GROUP = lambda i: "CASE category " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in GROUPS.items()) + " ELSE 'SEO' END"
WORK = f"""{_with(FINDINGS_SQL)} SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY priority, is_top DESC, status <> 'fail', CASE severity WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END, emit_ord, id) AS rank, id, priority, due_days, is_top, {_GROUP(0)} AS "group", {_GROUP(1)} AS team, audit_id || ':' || id AS issue_key
FROM (SELECT *, CASE base WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 14 ELSE 30 END AS due_days, CASE WHEN is_top AND base > 1 THEN base - 1 ELSE base END AS priority FROM (SELECT *, {_PRIO} AS base, audit_id % 4 = emit_ord % 4 AS is_top FROM findings WHERE status IN ('fail', 'warn')))"""
TOPK = f"""{_with(FINDINGS_SQL)} SELECT audit_id, rank, id, effective FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY effective, emit_ord, id) AS rank FROM (
  SELECT *, least(CASE severity WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END + CASE WHEN status = 'warn' THEN 1 ELSE 0 END, 2) AS effective FROM findings WHERE status IN ('fail', 'warn'))) WHERE rank <= 5"""
GUARD = f"""{_with(FINDINGS_SQL)}, named AS (SELECT event_id AS audit_id, rank, id FROM events, (VALUES (0, 'title-missing'), (1, 'made-up'), (2, 'og-tags'), (3, 'spa-shell'), (4, 'img-alt')) v(rank, id))
SELECT audit_id, id, rank, fate, CASE WHEN fate = 'kept' THEN row_number() OVER (PARTITION BY audit_id, fate ORDER BY rank) END AS new_rank FROM (
  SELECT n.audit_id, n.id, n.rank, CASE WHEN f.status IS NULL THEN 'unknown' WHEN f.status IN ('fail', 'warn') THEN 'kept' ELSE 'non_issue' END AS fate FROM named n LEFT JOIN findings f ON f.audit_id = n.audit_id AND f.id = n.id)"""
_PROF = "profile AS MATERIALIZED (SELECT audit_id, " + ", ".join(f"max(CASE WHEN id = '{i}' THEN status END) AS {n}" for n, i in PROFILE.items()) + " FROM findings GROUP BY audit_id)"
PROFILES = f"{_with(FINDINGS_SQL, _PROF)} SELECT * FROM profile"
_RANK = "CASE {0} WHEN 'pass' THEN 0 WHEN 'info' THEN 1 WHEN 'warn' THEN 2 WHEN 'fail' THEN 3 END"
VERDICTS = f"""{_with(FINDINGS_SQL, _PROF)}, long AS MATERIALIZED ({" UNION ALL ".join(f"SELECT audit_id, '{n}' AS flag, {n} AS status FROM profile" for n in PROFILE)}),
faced AS (SELECT audit_id, flag, max(ours) AS ours, max(theirs) AS theirs FROM (
  SELECT audit_id, flag, status AS ours, NULL AS theirs FROM long UNION ALL SELECT audit_id - 1, flag, NULL, status FROM long) GROUP BY audit_id, flag HAVING count(*) = 2)
SELECT audit_id, flag, ours, theirs, CASE WHEN ours IS NULL OR theirs IS NULL THEN '–' WHEN {_RANK.format("ours")} < {_RANK.format("theirs")} THEN 'win' WHEN {_RANK.format("ours")} > {_RANK.format("theirs")} THEN 'lose' ELSE 'tie' END AS verdict FROM faced"""
WATCH = """WITH last AS (SELECT user_id, max(ts) AS t, arg_max(event_type, ts) AS kind FROM events GROUP BY user_id)
SELECT 'https://s' || user_id || '.example.com/' AS url, user_id % 3 + 1 AS interval_days, CASE WHEN user_id % 10 <> 0 THEN t END AS last_run FROM last
WHERE kind <> 'error' AND (user_id % 10 = 0 OR epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(t) > (user_id % 3 + 1) * 86400000000)"""
SERP = """WITH r AS (
  SELECT page_id % 25 AS idx, array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '.'), 1, 2), '.') || '.co.uk' AS host, substr(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), 1, 90) AS title FROM pages
), d AS (SELECT *, array_to_string(list_slice(string_split(regexp_replace(host, '^www\\.', ''), '.'), -3, -1), '.') AS domain FROM r WHERE idx < 20),
k AS (SELECT domain, greatest(1, 20 - idx) AS points, title FROM d WHERE domain <> 'example.com' AND NOT contains(host, 'cheap-pills') AND NOT contains(host, 'spam-farm')
  AND NOT (length(string_split(domain, '.')[1]) >= 5 AND (contains('ththre', string_split(domain, '.')[1]) OR contains(string_split(domain, '.')[1], 'ththre'))))
SELECT 'ththre.example.com' AS own, domain, score, titles, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, domain) AS rank FROM (SELECT domain, CAST(sum(points) AS BIGINT) AS score, count(DISTINCT title) AS titles FROM k GROUP BY domain)) WHERE rank <= 30"""
USD = """SELECT user_id, round(sum(((event_id % 5000) * CASE event_type WHEN 'click' THEN 0.15::DOUBLE WHEN 'error' THEN 2.5::DOUBLE ELSE 0.8::DOUBLE END + (event_id % 700) * CASE event_type WHEN 'click' THEN 0.6::DOUBLE WHEN 'error' THEN 10.0::DOUBLE ELSE 4.0::DOUBLE END) / 1000000), 4) AS usd,
  CAST(sum(event_id % 5000) AS BIGINT) AS tokens_in, count(*) AS calls FROM events GROUP BY user_id"""


_PAGE_ALWAYS = (("desc", "high"), ("viewport", "high"), ("canonical", "high"), ("og-title", "med"), ("og-image", "med"), ("jsonld", "high"), ("og-desc", "low"), ("twitter-card", "low"))
ISSUES = _crawl(" UNION ALL ".join(f"SELECT site_id, url, '{i}' AS issue, '{v}' AS severity FROM crawl" for i, v in _PAGE_ALWAYS) + """
  UNION ALL SELECT site_id, url, 'title', 'high' FROM crawl WHERE trim(title) = '' UNION ALL SELECT site_id, url, 'title-length', 'med' FROM crawl WHERE trim(title) <> '' AND length(trim(title)) NOT BETWEEN 10 AND 65
  UNION ALL SELECT site_id, url, 'lang', 'med' FROM crawl WHERE lang = ''""")
FIXES = f"{_with(FINDINGS_SQL)}, fix(id, fix) AS (VALUES {', '.join(str(p) for p in FIX_FOR_CHECK.items())}) SELECT audit_id, fix, string_agg(DISTINCT id, ',' ORDER BY id) AS checks FROM findings JOIN fix USING (id) WHERE status IN ('fail', 'warn') GROUP BY audit_id, fix"
TYPES = f"SELECT page_id, ['home', 'home', 'contact', 'faq', 'about', 'article', 'bloglist', 'service', 'career', 'policy'][CAST(page_id % {len(WORDS)} + 1 AS INTEGER)] AS page_type FROM pages"
KINDS = _crawl("SELECT site_id, ['ecommerce', 'service', 'content', 'corporate'][CAST(length(site_id) % 4 + 1 AS INTEGER)] AS kind, count(*) AS pages FROM crawl GROUP BY site_id")
CRUMBS = _crawl("""SELECT page_id, position, name, item FROM (
  SELECT page_id, 1 AS position, 'Home' AS name, scheme || '://' || site_id || '/' AS item FROM crawl UNION ALL
  SELECT page_id, CAST(1 + row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER), array_to_string(list_transform(string_split(regexp_replace(url_decode(s), '[-_]+', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' '), scheme || '://' || site_id || '/' || array_to_string(list_slice(ss, 1, i), '/')
  FROM (SELECT page_id, scheme, site_id, ss, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS ss FROM crawl)) WHERE lower(s) NOT IN ('en', 'th'))""")
VARIANTS = _crawl(f"""SELECT page_id, variant FROM (SELECT page_id, scheme || '://' || site_id || '/' AS own, unnest(list_transform(['https://', 'https://www.', 'http://', 'http://www.'], lambda s: s || {HOST0} || '/')) AS variant FROM crawl) WHERE variant <> own""")
SITEMAP = _crawl("""SELECT site_id, min(page_ord) AS entry_ord, '  <url><loc>' || replace(replace(replace(replace(final_url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</loc></url>' AS entry FROM crawl WHERE status = 200 GROUP BY site_id, final_url""")

_IN = lambda ids: "(" + ", ".join(f"'{i}'" for i in ids) + ")"
CONFIDENCE = f"""{_with(FINDINGS_SQL, _VERIFY)}, dim_of(id, dim) AS (VALUES {", ".join(str(p) for p in DIMENSION.items())}), typed AS (
  SELECT audit_id, id, CASE WHEN id IN {_IN(DETERMINISTIC)} THEN 'deterministic' WHEN id IN {_IN(RULE)} THEN 'rule' WHEN id IN {_IN(JUDGED)} THEN 'ai' WHEN category IN ('schema', 'index', 'security') THEN 'deterministic' WHEN category = 'geo' THEN 'ai' ELSE 'rule' END AS type FROM findings)
SELECT t.audit_id, t.id, type, CASE WHEN v.ours IS NULL THEN CASE type WHEN 'deterministic' THEN 97 WHEN 'rule' THEN 88 ELSE 65 END WHEN v.ours = v.theirs THEN 99 ELSE 50 END AS sure, coalesce(v.ours <> v.theirs, false) AS needs_verify
FROM typed t LEFT JOIN dim_of d ON d.id = t.id LEFT JOIN verdicts v ON v.audit_id = t.audit_id AND v.dim = d.dim"""


NEEDS = f"WITH judged AS ({CONFIDENCE}) SELECT id, count(*) AS n FROM judged WHERE needs_verify GROUP BY id ORDER BY n DESC, id LIMIT 8"


def oracle_sql() -> dict[str, str]:
    return reports.SQL | repairs.SQL | pieces.SQL | reports.board_sql(_VERIFY, _METRICS) | {
        "needs_verify": NEEDS,
        "page_extract_basic": PAGE_BASIC, "url_functions": URLS, "url_normalize": NORMALIZED, "text_widths": WIDTHS, "title_h1_similarity": SIMILARITY, "title_duplicate_groups": DUP_TITLES, "dup_docs_by_lang": DUP_DOCS, "near_duplicate_pairs": NEAR_DOCS,
        "trailing_slash_twins": TWINS, "inlink_counts": INLINKS, "orphan_pages": ORPHANS_SQL, "health_orphans": HEALTH_ORPHANS, "broken_link_sample": BROKEN, "anchor_topk": ANCHORS, "link_health": HEALTH, "heading_order": HEADINGS_SQL, "parameter_cap": PARAMS,
        "final_url_dedupe": FINALS, "bot_access_matrix": BOTS, "robots_rules": ROBOT_RULES, "check_results": CHECKS, "made_checks": checks_sql(), "made_flags": FLAGS_SQL, "made_extract": EXTRACT_SQL, "category_score": CATS, "site_score": SITES, "grade_distribution": GRADES, "previous_audit_asof": PREVIOUS, "latest_per_site": LATEST,
        "history_trend": HISTORY, "audit_delta": DELTA, "category_delta": CAT_DELTA, "score_drop_alerts": ALERTS, "cross_check": CROSS, "confusion_matrix": CONFUSION, "label_confusion": LABELS, "work_items": WORK, "effective_rank_topk": TOPK,
        "guardrail_partition": GUARD, "flag_profile": PROFILES, "flag_verdicts": VERDICTS, "watch_due": WATCH, "serp_rank": SERP, "usd_costs": USD,
        "page_issues": ISSUES, "needed_fixes": FIXES, "page_types": TYPES, "site_kinds": KINDS, "breadcrumbs": CRUMBS, "origin_variants": VARIANTS, "sitemap_fix": SITEMAP, "check_confidence": CONFIDENCE,
    }
