"""Queries over boards, report lists and page views, each beside the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import boards as B
from ..operators import confidence as E
from ..operators import pageview as V
from ..operators import rules as K
from ..operators import scoring as S
from ..operators.joins import dealt
from . import crawl as C
from . import made as M
from .crawl import AUDITS_SQL, FINDINGS_SQL
from .made import INPUTS_SQL

_BAD = "status IN ('fail', 'warn')"
_SEV = "CASE severity WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END"
_EFF = f"least({_SEV} + CASE WHEN status = 'warn' THEN 1 ELSE 0 END, 2)"


def _ranked(order: str, where: str = "true", more: str = "") -> str:
    return f"SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY {order + ', ' if order else ''}emit_ord, id) AS rank, id{more} FROM findings WHERE {where}"


def dashboard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, and those of one status and one category."""
    f = C.findings(spark, sf_dir)
    lists = {"all": B.dashboard(f), "warn": B.dashboard(f, "warn"), "fail index": B.dashboard(f, "fail", "index")}
    parts = [d.select(F.lit(n).alias("list"), "audit_id", "rank", "id") for n, d in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DASH = f"CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, {_SEV}"
DASHBOARD = f"WITH {FINDINGS_SQL} SELECT 'all' AS list, * FROM ({_ranked(_DASH)}) UNION ALL SELECT 'warn', * FROM ({_ranked(_SEV, chr(34) + 'status' + chr(34) + ' = ' + chr(39) + 'warn' + chr(39))}) UNION ALL SELECT 'fail index', * FROM ({_ranked(_SEV, 'status = ' + chr(39) + 'fail' + chr(39) + ' AND category = ' + chr(39) + 'index' + chr(39))})"


def category_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.category_badges(C.findings(spark, sf_dir))


BADGES = f"WITH {FINDINGS_SQL} SELECT audit_id, category, count(*) FILTER ({_BAD}) AS issues FROM findings GROUP BY audit_id, category"


def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.findings(spark, sf_dir)
    lists = {"health": B.health_table(f), "key": B.key_findings(f), "sales": B.sales_issues(f), "passes": B.sales_passes(f), "asked": B.asked_first(f)}
    out = None
    for n, d in lists.items():
        d = d.select(F.lit(n).alias("list"), "audit_id", "rank", "id")
        out = d if out is None else out.unionByName(d)
    return out


_STATUS = "CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
_LISTS = {
    "health": (_ranked(_STATUS, "severity <> 'low' AND status <> 'info' AND category <> 'geo'"), 13), "key": (_ranked("", "status = 'fail' AND severity = 'high'"), 6), "sales": (_ranked(_SEV, _BAD), 99), "passes": (_ranked("", "status = 'pass'"), 27),
    "asked": (_ranked(_SEV, "status = 'fail'"), 6),
}
LISTS = f"WITH {FINDINGS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS list, * FROM ({sql}) WHERE rank <= {k}" for n, (sql, k) in _LISTS.items())


def issue_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.issue_cards(C.findings(spark, sf_dir))


CARDS = f"""WITH {FINDINGS_SQL}, issues AS (SELECT *, {_EFF} AS e FROM findings WHERE {_BAD} AND category <> 'geo')
SELECT audit_id, id, ['urgent', 'improve', 'minor'][e + 1] AS bucket, place, CAST((place - 1) // 2 AS INTEGER) AS slide, number FROM (
  SELECT *, row_number() OVER (PARTITION BY audit_id, e ORDER BY emit_ord, id) AS place, row_number() OVER (PARTITION BY audit_id ORDER BY e, emit_ord, id) AS number FROM issues)"""


def template_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities and quick wins of each audit, in the two parts of a roadmap."""
    return B.roadmap(B.template_priorities(C.findings(spark, sf_dir), F.col("emit_ord") % 2 == 0))


PLAN = f"""WITH {FINDINGS_SQL}, f AS (SELECT *, emit_ord % 2 = 0 AS fixable, row_number() OVER (PARTITION BY audit_id ORDER BY severity <> 'high', emit_ord, id) AS rank FROM findings WHERE status = 'fail'),
q AS (SELECT *, fixable AND count(*) FILTER (fixable) OVER (PARTITION BY audit_id ORDER BY rank) <= 4 AS quick FROM f)
SELECT audit_id, rank, id, quick, CASE WHEN rank <= 3 THEN 'week 1' WHEN rank <= 7 THEN 'weeks 2-3' END AS timeline, CASE WHEN rank <= 3 THEN 'first' ELSE 'later' END AS part FROM q WHERE rank <= 7 OR quick"""

_FLAGS = {"canonical": "canonical-missing", "eeat": "geo-eeat", "og": "og-tags", "sitemap": "sitemap-exists", "ssr": "spa-shell", "title": "title-missing", "desc": "desc-missing"}


def site_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each audit against the next one: difference of scores, flags won and lost, what a plan without a model reckons with."""
    f, a = C.findings(spark, sf_dir), C.audits(spark, sf_dir).select("audit_id", "overall")
    # Audits meet with a row each; their flags are told apart afterwards, within the audit's task.
    mine = A.flag_profile(f, _FLAGS)
    theirs = mine.select((F.col("audit_id") - 1).alias("audit_id"), *[F.col(n).alias(f"their_{n}") for n in _FLAGS])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("flag"), A.verdict(F.col(n), F.col(f"their_{n}")).alias("verdict")) for k, n in enumerate(_FLAGS)]))
    v = mine.join(dealt(theirs), "audit_id").select("audit_id", each.alias("x")).select("audit_id", "x.*")
    pairs = a.withColumnRenamed("overall", "ours").join(dealt(a.select((F.col("audit_id") - 1).alias("audit_id"), F.col("overall").alias("theirs"))), "audit_id")
    out = B.compare_sites(pairs, v).join(dealt(a.select("audit_id", B.growth(F.col("overall")).alias("g"))), "audit_id")
    return out.select("audit_id", "diff", "leads", *[F.array_join(c, ",").alias(c) for c in ("losing", "winning", "battles")], "g.m3", "g.m6")


_RANK = "CASE {0} WHEN 'pass' THEN 0 WHEN 'info' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END"
COMPARISON = f"""WITH {AUDITS_SQL}, {FINDINGS_SQL}, names(ord, flag, id) AS (VALUES {", ".join(f"({k}, '{n}', '{i}')" for k, (n, i) in enumerate(_FLAGS.items()))}),
s AS (SELECT f.audit_id, n.ord, n.flag, f.status FROM findings f JOIN names n ON n.id = f.id),
v AS (SELECT a.audit_id, a.ord, a.flag, {_RANK.format("a.status")} - {_RANK.format("b.status")} AS d FROM s a JOIN s b ON b.audit_id = a.audit_id + 1 AND a.flag = b.flag),
t AS (SELECT audit_id, list(flag ORDER BY ord) FILTER (d > 0) AS losing, list(flag ORDER BY ord) FILTER (d < 0) AS winning FROM v GROUP BY audit_id)
SELECT a.audit_id, a.overall - b.overall AS diff, a.overall >= b.overall AS leads, coalesce(array_to_string(losing, ','), '') AS losing, coalesce(array_to_string(winning, ','), '') AS winning, coalesce(array_to_string(losing[1:5], ','), '') AS battles,
  least(a.overall + 15, 80) AS m3, least(a.overall + 25, 88) AS m6 FROM audits a JOIN audits b ON b.audit_id = a.audit_id + 1 LEFT JOIN t ON t.audit_id = a.audit_id"""


def competitor_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.category_scores(C.findings(spark, sf_dir), "audit_id")
    theirs = s.select((F.col("audit_id") - 1).alias("audit_id"), "category", "score")
    rows = [B.competitor_categories(s, theirs, both).withColumn("both_only", F.lit(both)) for both in (False, True)]
    return rows[0].unionByName(rows[1])


_CATS = f"cats AS (SELECT audit_id, category, CAST(floor((1 - sum(w * CASE status WHEN 'fail' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.45::DOUBLE ELSE 0 END) / sum(w)) * 100 + 0.5) AS INTEGER) AS score FROM (SELECT *, CASE severity WHEN 'high' THEN 10 WHEN 'med' THEN 5 ELSE 2 END AS w FROM findings WHERE status <> 'info') GROUP BY audit_id, category)"
COMPETITORS = f"""WITH {FINDINGS_SQL}, {_CATS}, j AS (SELECT coalesce(a.audit_id, b.audit_id - 1) AS audit_id, coalesce(a.category, b.category) AS category, a.score AS ours, b.score AS theirs FROM cats a FULL JOIN cats b ON b.audit_id = a.audit_id + 1 AND a.category = b.category)
SELECT *, ours - theirs AS diff, false AS both_only FROM j UNION ALL SELECT *, ours - theirs, true FROM j WHERE ours IS NOT NULL AND theirs IS NOT NULL"""


def audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest audits."""
    scores = S.site_scores(C.findings(spark, sf_dir), "audit_id").select("audit_id", "grade", "fails")
    return B.audit_list(C.audits(spark, sf_dir).select("audit_id", "created_at", "pages_analyzed"), scores, 100)


AUDIT_LIST = f"""WITH {AUDITS_SQL}, {FINDINGS_SQL}, {_CATS}, o AS (SELECT audit_id, floor(sum(score * w) / sum(w) + 0.5) AS s FROM (SELECT *, CASE category WHEN 'onpage' THEN 18 WHEN 'index' THEN 20 WHEN 'schema' THEN 12 WHEN 'links' THEN 8 WHEN 'images' THEN 5 WHEN 'performance' THEN 10 WHEN 'security' THEN 5 WHEN 'rendering' THEN 12 WHEN 'geo' THEN 10 ELSE 5 END AS w FROM cats) GROUP BY audit_id),
n AS (SELECT audit_id, created_at, pages_analyzed, row_number() OVER (ORDER BY created_at DESC, audit_id DESC) AS place FROM audits), c AS (SELECT audit_id, count(*) FILTER (status = 'fail') AS fails FROM findings GROUP BY audit_id)
SELECT n.audit_id, created_at, pages_analyzed, CASE WHEN coalesce(s, 0) >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 45 THEN 'D' ELSE 'F' END AS grade, fails, row_number() OVER (ORDER BY place) AS rank FROM n JOIN c ON c.audit_id = n.audit_id LEFT JOIN o ON o.audit_id = n.audit_id WHERE place <= 100"""


def _board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(audits, latest audit of each site, quality board); three in four audits were cross-checked."""
    from .queries import verdict_rows

    a = C.audits(spark, sf_dir)
    latest = A.latest_per_site(a)
    checked = A.cross_check(*verdict_rows(spark, sf_dir)).where("audit_id % 4 <> 1")
    return a, latest, B.quality_sites(latest, checked)


_NUMBERS = ("tp", "fp", "fn", "tn", "precision", "recall", "fpr", "fnr")


def quality_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir)[2].select("audit_id", "flag", "wrong", *_NUMBERS)


def quality_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.quality_order(_board(spark, sf_dir)[2], B.FLAGGED).select("rank", "audit_id", "flag", "wrong")


def quality_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, latest, board = _board(spark, sf_dir)
    return B.quality_totals(a, board, latest)


def needs_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import verdict_rows

    return B.needs_verify(E.annotate(C.findings(spark, sf_dir), A.cross_check(*verdict_rows(spark, sf_dir))))


def board_sql(verdicts: str, pct: str) -> dict[str, str]:
    """The SQL of the boards from that of the verdicts."""
    base = f"""WITH {AUDITS_SQL}, {verdicts}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nurl ORDER BY created_at DESC, audit_id DESC) AS r FROM audits) WHERE r = 1),
board AS (SELECT l.audit_id, l.created_at, bool_or(kind = 'fact' AND ours <> theirs) AS flag, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'fact' AND ours = 'fail' AND theirs = 'fail') AS tp, count(*) FILTER (kind = 'fact' AND ours = 'fail' AND theirs <> 'fail') AS fp,
  count(*) FILTER (kind = 'fact' AND ours <> 'fail' AND theirs = 'fail') AS fn, count(*) FILTER (kind = 'fact' AND ours <> 'fail' AND theirs <> 'fail') AS tn FROM latest l JOIN verdicts v ON v.audit_id = l.audit_id WHERE l.audit_id % 4 <> 1 GROUP BY l.audit_id, l.created_at)"""
    cells = ", ".join(f"CASE WHEN facts > 0 THEN {c} END AS {c}" for c in ("tp", "fp", "fn", "tn"))
    return {
        "quality_board": f"{base} SELECT audit_id, flag, CASE WHEN facts > 0 THEN fp + fn ELSE 0 END AS wrong, {cells}, {pct} FROM board",
        "quality_top": f"{base} SELECT row_number() OVER (ORDER BY flag DESC, fp + fn DESC, created_at DESC, audit_id DESC) AS rank, audit_id, flag, fp + fn AS wrong FROM board ORDER BY flag DESC, fp + fn DESC, created_at DESC, audit_id DESC LIMIT 25",
        "quality_totals": f"{base} SELECT (SELECT count(*) FROM audits) AS total, (SELECT count(*) FROM latest) AS sites, count(*) AS with_verify, count(*) FILTER (flag) AS flagged FROM board",
    }


def cost_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = C.table(spark, sf_dir, "events").select(i.alias("audit_id"), F.when(i % 3 != 0, (i % 700) / 1000.0).alias("usd"), (i % 5000).alias("tokens_in"), (i % 700).alias("tokens_out"))
    return B.cost_board(e).select("audits", F.round("usd", 6).alias("usd"), "tokens_in", "tokens_out", F.round("average", 9).alias("average"))


COSTS = "SELECT count(*) AS audits, round(sum(event_id % 700 / 1000.0::DOUBLE), 6) AS usd, CAST(sum(event_id % 5000) AS BIGINT) AS tokens_in, CAST(sum(event_id % 700) AS BIGINT) AS tokens_out, round(sum(event_id % 700 / 1000.0::DOUBLE) / count(*), 9) AS average FROM events WHERE event_id % 3 <> 0"


def check_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the findings' ids, one of them without a standard."""
    f = C.findings(spark, sf_dir).withColumn("id", F.when(F.col("audit_id") % 50 == 0, "made-up").otherwise(F.col("id")))
    return B.authority(f).select("audit_id", "emit_ord", "id", "tier", "standard_confidence")


AUTHORITY = f"""WITH {FINDINGS_SQL}, named AS (SELECT audit_id, emit_ord, CASE WHEN audit_id % 50 = 0 THEN 'made-up' ELSE id END AS id FROM findings), standard(id, tier, sure) AS (VALUES {", ".join(f"('{k}', {t}, {c})" for k, (t, c) in B.STANDARDS.items())})
SELECT n.audit_id, n.emit_ord, n.id, tier, sure AS standard_confidence FROM named n LEFT JOIN standard s ON s.id = n.id"""


def reference_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of checks as made of events: which checks use each, and whether it answered."""
    i = F.col("event_id")
    e = C.table(spark, sf_dir, "events")
    ids = F.array(*[F.lit(x) for x, _, _ in C.FINDINGS])
    refs = B.reference_checks(e.select(F.element_at(ids, (i % len(C.FINDINGS) + 1).cast("int")).alias("id"), F.concat(F.lit("https://r.example/"), (i * 7 % 501).cast("string")).alias("url")))
    n = F.col("n")
    fetched = spark.range(501).select(F.concat(F.lit("https://r.example/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("n"))
    fetched = fetched.select("url", F.when(n % 11 == 0, F.lit(None)).when(n % 7 == 0, 404).otherwise(200).cast("int").alias("status"), F.when(n % 5 == 0, F.lit("https://new.example/")).when(n % 3 == 0, F.concat("url", F.lit("?hl=en#x"))).otherwise(F.col("url")).alias("final"))
    return B.reference_health(fetched).join(refs, "url").select("url", "status", "state", F.array_join("ids", ",").alias("ids"))


REFERENCES = f"""WITH r AS (SELECT event_id * 7 % 501 AS n, [{", ".join(f"'{x}'" for x, _, _ in C.FINDINGS)}][CAST(event_id % {len(C.FINDINGS)} + 1 AS INTEGER)] AS id FROM events)
SELECT 'https://r.example/' || n AS url, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 7 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN 'dead' WHEN n % 5 = 0 THEN 'moved' ELSE 'ok' END AS state, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM r GROUP BY n"""


def check_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field and effort of every finding of the audit view, with up to forty affected pages."""
    f = C.findings(spark, sf_dir)
    category = F.when(F.col("id").contains("spa"), "rendering").otherwise(F.col("category"))
    return f.select("audit_id", "id", V.focus(F.col("id")).alias("focus"), V.page_effort(F.col("id"), category, (F.col("audit_id") * 7 + F.col("emit_ord")) % 41).alias("minutes"))


CHECK_FOCUS = f"""WITH {FINDINGS_SQL.strip()}, a AS (SELECT *, (audit_id * 7 + emit_ord) % 41 AS n FROM findings)
SELECT audit_id, id, CASE WHEN starts_with(id, 'title') THEN 'title' WHEN starts_with(id, 'h1') OR starts_with(id, 'heading') OR id = 'empty-headings' THEN 'h1' WHEN contains(id, 'desc') THEN 'desc' WHEN contains(id, 'canonical') THEN 'canonical'
  WHEN contains(id, 'noindex') OR contains(id, 'robots') THEN 'robots' WHEN starts_with(id, 'img') OR contains(id, 'image') THEN 'images' WHEN contains(id, 'schema') OR contains(id, 'jsonld') THEN 'schema' WHEN id IN ('content-thin', 'text-ratio') THEN 'content' WHEN contains(id, 'lang') THEN 'lang' ELSE '' END AS focus,
  CASE WHEN id IN ('h1-missing', 'title-missing', 'title-duplicate', 'desc-missing', 'desc-duplicate', 'canonical-missing', 'image-alt') THEN CAST(greatest(15, floor(greatest(n, 1) * 1.5 + 0.5)) AS INTEGER) WHEN contains(id, 'spa') OR category = 'rendering' THEN 1440 ELSE 30 END AS minutes
FROM a"""


# ---------------------------------------------------------------- pages of the made-up crawl

_H1 = "CASE WHEN h1_same THEN 'One heading of many pages' ELSE concat('Heading ', j) END"
_HEAD = "CASE WHEN h1 IN ('none', 'empty') THEN [] WHEN h1 = 'two' THEN [{0}, 'Another'] ELSE [{0}] END".format(_H1)
_ALT = "CASE WHEN gallery THEN 6 ELSE 1 END + mixed::INT"


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.with_page_facts(M.made_crawl(spark, sf_dir)[0])
    s = V.page_signals(rows, F.col("ld.types"))
    return s.drop("words", "status").withColumns({c: F.array_join(c, " | ") for c in ("h1", "heading_counts", "types")})


SIGNALS = f"""WITH {INPUTS_SQL} SELECT site_id, j AS page_ord, url, title, array_to_string({_HEAD}, ' | ') AS h1,
  array_to_string(list_filter([CASE h1 WHEN 'none' THEN NULL WHEN 'two' THEN 'h1:2' ELSE 'h1:1' END, 'h2:1', CASE WHEN jump AND NOT empty_h3 THEN NULL WHEN NOT jump AND empty_h3 THEN 'h3:2' ELSE 'h3:1' END, CASE WHEN jump THEN 'h4:1' END], lambda x: x IS NOT NULL), ' | ') AS heading_counts,
  descr AS description, CASE canon WHEN 'none' THEN '' WHEN 'relative' THEN '/rel' WHEN 'away' THEN 'https://elsewhere.example/x' ELSE url END AS canonical, robots, lang, {_ALT} AS images, no_alt::INT AS missing_alt, 0 AS empty_alt,
  CASE ld WHEN 'org' THEN 'Organization' WHEN 'orgw' THEN 'Organization' WHEN 'person' THEN 'Person' WHEN 'faq' THEN 'FAQPage' WHEN 'crumb' THEN 'BreadcrumbList' WHEN 'corp' THEN 'Corporation' WHEN 'article' THEN 'Article' ELSE '' END AS types, {M._INTERNAL} AS links
FROM made WHERE status = 200 AND NOT blocked"""


def persisted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.persisted(M.made_crawl(spark, sf_dir)[0])
    return p.select("site_id", "url", "status", "title", "description", F.array_join("h1", " | ").alias("h1"), "elapsed", "empty_root", F.col("word_count").between(150, 400).alias("wordy"))


PERSISTED = f"""WITH {INPUTS_SQL} SELECT site_id, url, status, title, descr AS description, array_to_string(CASE WHEN h1 = 'empty' THEN [''] ELSE {_HEAD} END, ' | ') AS h1, CASE WHEN slow THEN 3500 ELSE 200 END AS elapsed, shell AS empty_root, NOT thin AS wordy FROM made"""


def spa_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the made-up crawl with sites of four pages, so that some are shells."""
    p = M.made_crawl(spark, sf_dir)[0].withColumn("site_id", F.concat_ws(":", "site_id", (F.col("page_ord") % 4).cast("string")))
    return V.spa_sites(p)


SPA = f"WITH {INPUTS_SQL} SELECT concat(site_id, ':', j % 4) AS site_id, avg(shell::INT) >= 0.5 AS is_spa FROM made WHERE status = 200 AND NOT blocked GROUP BY site_id, j % 4"


def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the pages' URLs in upper case, with a slash, with another query, and of pages that are not there."""
    pages = M.made_crawl(spark, sf_dir)[0]
    u = F.col("url")
    asked = pages.select("site_id", F.explode(F.array(F.upper(F.regexp_replace(u, "^https?", "https")), F.concat(F.regexp_replace(u, r"\?.*$", ""), F.lit("/")), F.concat(F.regexp_replace(u, r"\?.*$", ""), F.lit("?none")), F.concat(u, F.lit("x")))).alias("asked")).where(F.col("asked").startswith("http")).distinct()
    return V.titles_of(asked, pages)


LOOKUP = f"""WITH {INPUTS_SQL}, k AS (SELECT site_id, j, title, regexp_replace(lower(regexp_replace(url, '^https?://', '')), '/+$', '') AS key FROM made WHERE title <> ''),
x AS (SELECT site_id, key, arg_max(title, j) AS title FROM k GROUP BY site_id, key), s AS (SELECT site_id, regexp_replace(key, '[?].*$', '') AS key, arg_min(title, j) AS title FROM k GROUP BY site_id, regexp_replace(key, '[?].*$', '')),
a AS (SELECT DISTINCT site_id, unnest([concat(regexp_replace(url, '[?].*$', ''), '/'), concat(regexp_replace(url, '[?].*$', ''), '?none'), concat(url, 'x')]) AS asked FROM made),
b AS (SELECT *, regexp_replace(lower(regexp_replace(asked, '^https?://', '')), '/+$', '') AS key FROM a)
SELECT b.site_id, asked, coalesce(x.title, y.title, s.title, '') AS title FROM b LEFT JOIN x ON x.site_id = b.site_id AND x.key = b.key LEFT JOIN x y ON y.site_id = b.site_id AND y.key = regexp_replace(b.key, '[?].*$', '') LEFT JOIN s ON s.site_id = b.site_id AND s.key = regexp_replace(b.key, '[?].*$', '')"""


def affected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.affected_pages(M.made_crawl(spark, sf_dir)[0])


AFFECTED = f"""WITH {INPUTS_SQL}, ok AS (SELECT * FROM made WHERE status = 200 AND NOT blocked)
SELECT 'canonical-missing' AS id, site_id, url FROM ok WHERE canon = 'none' UNION ALL SELECT 'title-missing', site_id, url FROM ok WHERE title = '' UNION ALL SELECT 'desc-missing', site_id, url FROM ok WHERE descr = '' UNION ALL SELECT 'h1-missing', site_id, url FROM ok WHERE h1 = 'none'
UNION ALL SELECT 'title-duplicate', site_id, url FROM (SELECT *, count(*) OVER (PARTITION BY site_id, title) AS n FROM ok WHERE title <> '') WHERE n > 1 UNION ALL SELECT 'desc-duplicate', site_id, url FROM (SELECT *, count(*) OVER (PARTITION BY site_id, trim(descr)) AS n FROM ok WHERE descr <> '') WHERE n > 1"""


def title_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of titles from brands and paths, and of titles from headings."""
    pages = M.made_crawl(spark, sf_dir)[0].withColumn("title", F.when(F.col("page_ord") == 0, F.concat(F.lit("Welcome | Shop "), F.substring("site_id", 5, 3))).otherwise(F.col("title")))
    h1 = F.get(F.transform(F.filter("headings", lambda h: h["tag"] == "h1"), lambda h: h["text"]), F.lit(0))
    drafts = pages.select("site_id", "page_ord", V.meta_draft(h1, F.col("url")).alias("from_h1"))
    return V.page_titles(pages.drop("rendered_title").withColumn("rendered_title", F.lit(None).cast("string"))).join(drafts, ["site_id", "page_ord"]).join(V.brands(pages.drop("rendered_title").withColumn("rendered_title", F.lit(""))), "site_id")


_WORDS = "array_to_string(list_transform(string_split(regexp_replace(coalesce(nullif(list_filter(string_split(path, '/'), lambda s: s NOT IN ('', 'en', 'th'))[-1], ''), 'Home'), '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
DRAFTS = f"""WITH {INPUTS_SQL}, b AS (SELECT *, concat('Shop ', trim(substr(site_id, 5, 3))) AS brand, {_H1} AS head FROM made), t AS (SELECT *, CASE WHEN path = '/' THEN concat(brand, ' — IR Website / นักลงทุนสัมพันธ์') ELSE concat({_WORDS}, ' | ', brand) END AS t FROM b)
SELECT site_id, j AS page_ord, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 57)) || '…' ELSE t END AS draft, CASE WHEN h1 IN ('none', 'empty') THEN '' ELSE concat(head, ' | g', g) END AS from_h1, trim(brand) AS brand FROM t"""


def routed_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([(0, "s12", "list a"), (1, "s1", "list b"), (2, "7.example", "list c"), (9, "_default", "list z")], "ord int, part string, target string")
    return V.route(C.audits(spark, sf_dir), routes)


ROUTED = """SELECT event_id AS audit_id, CASE WHEN contains(h, 's12') THEN 'list a' WHEN contains(h, 's1') THEN 'list b' WHEN contains(h, '7.example') THEN 'list c' ELSE 'list z' END AS target, contains(h, 's1') OR contains(h, '7.example') AS matched
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'www.s' ELSE 's' END || user_id || '.example.com' AS h FROM events)"""


def error_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the made-up crawl: every page links to the page after the next."""
    p = M.made_crawl(spark, sf_dir)[0]
    links = p.select("site_id", ((F.col("page_ord") + 2) % 10).alias("to"), F.col("url").alias("source_url"), F.col("page_ord").alias("source_ord")).join(p.select("site_id", F.col("page_ord").alias("to"), F.col("url").alias("target")), ["site_id", "to"]).where("source_ord % 3 <> 0")
    return V.error_sources(p, links)


SOURCES = f"""WITH {INPUTS_SQL} SELECT a.site_id, coalesce(b.url, '(crawl)') AS source, a.url, a.status FROM made a LEFT JOIN made b ON a.site_id = b.site_id AND (b.j + 2) % 10 = a.j AND b.j % 3 <> 0 WHERE a.status >= 400"""


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.made_crawl(spark, sf_dir)[0].select("site_id", "url", "page_ord")
    labels = p.select("site_id", F.concat("url", F.when(F.col("page_ord") % 3 == 0, " (3 images)").when(F.col("page_ord") % 3 == 1, "").otherwise("x")).alias("label"))
    return V.evidence_of(labels, p)


EVIDENCE = f"WITH {INPUTS_SQL} SELECT site_id, concat(url, CASE j % 3 WHEN 0 THEN ' (3 images)' WHEN 1 THEN '' ELSE 'x' END) AS label, CASE WHEN j % 3 < 2 THEN url END AS evidence FROM made"


def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for sites made of events: statuses of pages and errors, messages, pages that robots.txt closes."""
    i = F.col("event_id")
    e = C.table(spark, sf_dir, "events").select(
        i.alias("audit_id"), F.when(i % 2 == 0, "a.co.th").otherwise("b.example").alias("host"), F.when(i % 5 == 0, F.array(F.lit(0), F.lit(500))).when(i % 5 == 1, F.array(F.lit(429))).otherwise(F.array().cast("array<int>")).alias("errors"), F.when(i % 7 == 0, F.array(F.lit(200), F.lit(403), F.lit(403))).otherwise(F.array(F.lit(200))).alias("pages"),
        F.when(i % 3 == 0, F.array(F.lit("fetch failed"), F.lit("fetch failed"))).when(i % 3 == 1, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("reasons"), (i % 4).alias("closed"),
    )
    e = e.withColumn("statuses", E.all_statuses(F.col("errors"), F.col("pages")))
    return e.select("audit_id", F.array_join("statuses", ",").alias("statuses"), E.unreachable_reason(F.col("host"), F.col("statuses"), F.col("reasons"), F.col("closed")).alias("reason"))


UNREACHABLE = """WITH e AS (SELECT event_id AS i, list_sort(list_distinct(list_concat(CASE event_id % 5 WHEN 0 THEN [500] WHEN 1 THEN [429] ELSE [] END, CASE WHEN event_id % 7 = 0 THEN [403] ELSE [] END))) AS s FROM events)
SELECT i AS audit_id, array_to_string(s, ',') AS statuses, CASE WHEN i % 2 = 0 AND len(s) = 0 AND i % 3 = 0 THEN 'geo_block' WHEN i % 4 > 0 AND len(s) = 0 AND i % 3 = 2 THEN 'robots' WHEN list_has_any(s, [401, 403, 429, 503]) THEN 'firewall' WHEN len(s) > 0 THEN 'limited' ELSE 'network' END AS reason FROM e"""

QUERIES = (
    dashboard_order, category_badges, report_lists, issue_cards, template_plan, site_comparison, competitor_categories, audit_list, quality_board, quality_top, quality_totals, needs_verify, cost_board, check_authority, reference_health, check_focus, page_signals, persisted_pages, spa_sites,
    title_lookup, affected_pages, title_drafts, routed_audits, error_sources, evidence_links, unreachable,
)
SQL = {
    "dashboard_order": DASHBOARD, "category_badges": BADGES, "report_lists": LISTS, "issue_cards": CARDS, "template_plan": PLAN, "site_comparison": COMPARISON, "competitor_categories": COMPETITORS, "audit_list": AUDIT_LIST, "cost_board": COSTS, "check_authority": AUTHORITY, "reference_health": REFERENCES,
    "check_focus": CHECK_FOCUS, "page_signals": SIGNALS, "persisted_pages": PERSISTED, "spa_sites": SPA, "title_lookup": LOOKUP, "affected_pages": AFFECTED, "title_drafts": DRAFTS, "routed_audits": ROUTED, "error_sources": SOURCES, "evidence_links": EVIDENCE, "unreachable": UNREACHABLE,
}
