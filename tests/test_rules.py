"""Each case is a site of its own; all are judged in one run."""

import datetime

import pytest

from pagewarden.model import PAGE, SITE, columns, conform
from pagewarden.operators.rules import decisions, run_checks
from pagewarden.operators.scoring import category_scores, site_scores
from pagewarden.sources.html_page import parse_html

LD = '<script type="application/ld+json">{"@type":"Organization","name":"N","url":"u","logo":"l","sameAs":["s"]}</script><script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"Home"}]}</script>'
HEAD = '<title>{title}</title><meta name="description" content="{desc}"><meta name="viewport" content="width=device-width"><link rel="icon" href="/f.ico">{canonical}{more}'
DESC = "A description of this page that is long enough to be shown in full by anyone."
OG = "".join(f'<meta property="og:{k}" content="https://x/{k}">' for k in ("title", "description", "image", "type")) + '<meta name="twitter:card" content="summary">'
BODY = '<h1>{h1}</h1><p>' + "word " * 200 + '</p><a href="/about">About us</a><a href="/contact">Contact us</a><a href="/privacy">Privacy page</a><a href="mailto:a@b.c">m</a>{body}'


def page(url="https://site.io/p", title="A good title for this page", desc=DESC, h1="A heading", canonical="self", more="", body="", ld=LD, og=OG, **over):
    link = f'<link rel="canonical" href="{url}">' if canonical == "self" else f'<link rel="canonical" href="{canonical}">' if canonical else ""
    html = f'<!DOCTYPE html><html lang="en"><head>{HEAD.format(title=title, desc=desc, canonical=link, more=more + ld + og)}</head><body>{BODY.format(h1=h1, body=body) if h1 is not None else body}</body></html>'
    row = parse_html(html) | {"url": url, "final_url": url, "status": 200, "elapsed": 100, "is_html": True, "blocked": False, "headers": {"content-encoding": "br"}}
    return row | over


def site(**over):
    base = {
        "start_url": "https://site.io/", "origin": "https://site.io", "https": True, "robots_txt": "User-agent: *\nAllow: /\nSitemap: https://site.io/sitemap.xml", "robots_status": 200, "sitemaps": ["https://site.io/sitemap.xml"],
        "sitemap_urls": ["https://site.io/p"], "sitemap_has_lastmod": True, "favicon_status": 200, "llms_txt": "x", "tls_insecure": False, "not_found": (True, 404), "variants": [], "broken_links": [], "render_state": None, "psi": None,
    }
    return base | over


IMG = '<img src=a alt="x"><img src=b alt=""><img src=c role=presentation>'
VIS = lambda alt, visible=True: ("s", alt, alt is not None and alt != "", visible, False)
VARIANT = lambda status, final=None, error=None: [("http://site.io", status, final, error)]

#: name: (pages, site, {check: state}, checks that must not come)
CASES = {
    "clean": ([page()], site(), {"title-missing": "pass", "title-length": "pass", "h1-missing": "pass", "schema-incomplete": "pass", "canonical-missing": "pass", "robots-blocks-all": "pass", "https": "pass", "og-tags": "pass", "geo-bot-access": "pass"}, ["h1-multiple", "noindex", "title-soft", "mixed-content", "charset-not-utf8", "orphan-pages-x"]),
    "many-h1": ([page(body="<h1>b</h1><h1>c</h1>")], site(), {"h1-multiple": "info", "h1-missing": "pass"}, []),
    "blank-h1": ([page(h1=" ")], site(), {"h1-missing": "fail"}, []),
    "script-h1": ([page(h1="", rendered_h1=["From script"])], site(), {"h1-missing": "warn"}, []),
    "hidden-h1": ([page(h1="</h1><h1 style='visibility:hidden'>x")], site(), {"h1-hidden": "warn"}, []),
    "noindex-cart": ([page(url="https://site.io/cart", more='<meta name="robots" content="noindex">')], site(), {"noindex": "pass"}, ["h1-multiple"]),
    "noindex-home": ([page(url="https://site.io/", more='<meta name="robots" content="noindex">')], site(), {"noindex": "warn"}, []),
    "no-canonical": ([page(canonical=None)], site(), {"canonical-missing": "warn"}, []),
    "no-canonical-query": ([page(canonical=None, url="https://site.io/p?page=2")], site(), {"canonical-missing": "fail"}, []),
    "hreflang-sitemap": ([page()], site(sitemap_urls=["https://site.io/?language=en"]), {"hreflang": "warn"}, []),
    "bad-robots-meta": ([page(more='<meta name="robots" content="index, noodp">')], site(), {"robots-meta-invalid": "warn"}, []),
    "charset": ([page(detected_charset="windows-874")], site(), {"charset-not-utf8": "warn"}, []),
    "schema-broken": ([page(ld='<script type="application/ld+json">{"@type":"Product"}</script>')], site(), {"schema-incomplete": "fail", "schema-org": "fail", "geo-entity": "warn"}, []),
    "schema-thin": ([page(ld='<script type="application/ld+json">{"@type":"Organization","name":"N"}</script>')], site(), {"schema-incomplete": "warn", "schema-org": "pass", "schema-breadcrumb": "warn"}, []),
    "schema-invalid": ([page(ld='<script type="application/ld+json">{oops</script>')], site(), {"jsonld-invalid": "fail"}, ["schema-incomplete"]),
    "decorative-alt": ([page(body=IMG)], site(), {"img-alt": "pass"}, []),
    "missing-alt": ([page(body=IMG + "<img src=d width=9>")], site(), {"img-alt": "warn"}, []),
    "invisible-image": ([page(body=IMG, image_vis=[VIS(None, False), VIS("x")])], site(), {"img-alt": "pass"}, []),
    "visible-no-alt": ([page(body=IMG, image_vis=[VIS(None)])], site(), {"img-alt": "fail"}, []),
    "visible-empty-alt": ([page(body=IMG, image_vis=[VIS(""), VIS("x")])], site(), {"img-alt": "warn"}, []),
    "no-image": ([page()], site(), {}, ["img-alt", "img-lazy"]),
    "variant-aborted": ([page()], site(variants=VARIANT(0, None, "aborted")), {"host-variants": "pass"}, []),
    "variant-dead": ([page()], site(variants=VARIANT(0, None, "ENOTFOUND x")), {"host-variants": "warn"}, []),
    "variant-live": ([page(canonical=None)], site(variants=VARIANT(200, "http://site.io")), {"host-variants": "fail"}, []),
    "variant-live-canonical": ([page()], site(variants=VARIANT(200, "http://site.io")), {"host-variants": "warn"}, []),
    "states": ([page(), page(url="https://site.io/gone", status=404), page(url="https://site.io/busy", status=429)], site(), {"error-pages": "fail", "crawl-blocked": "info"}, []),
    "no-pages": ([page(status=503)], site(), {"no-pages": "fail", "cwv": "info"}, ["title-missing", "geo-faq-schema"]),
    "same-titles": ([page(url="https://site.io/a"), page(url="https://site.io/b", title="A  GOOD title for this page")], site(), {"title-duplicate": "fail", "desc-duplicate": "warn", "h1-duplicate": "warn"}, []),
    "translated": ([page(url="https://site.io/en/a"), page(url="https://site.io/th/a")], site(), {"title-duplicate": "pass"}, ["desc-duplicate"]),
    "same-but-noindex": ([page(url="https://site.io/a"), page(url="https://site.io/b", more='<meta name="robots" content="noindex">')], site(), {"title-duplicate": "pass"}, []),
    "same-but-canonical": ([page(url="https://site.io/a"), page(url="https://site.io/b", canonical="https://site.io/a")], site(), {"title-duplicate": "pass"}, []),
    "other-language": ([page(url="https://site.io/a"), page(url="https://site.io/b", lang="th")], site(), {"title-duplicate": "pass"}, []),
    "og-none": ([page(og="")], site(), {"og-tags": "fail", "twitter-card": "warn"}, []),
    "og-part": ([page(og='<meta property="og:title" content="x">')], site(), {"og-tags": "warn"}, []),
    "title-none": ([page(title="")], site(), {"title-missing": "fail"}, []),
    "title-from-script": ([page(title="", rendered_title="Later")], site(), {"title-missing": "warn"}, []),
    "desc-none": ([page(desc="")], site(), {"desc-missing": "fail"}, []),
    "desc-from-script": ([page(desc="", rendered_description="Later")], site(), {"desc-missing": "warn"}, []),
    "wide-title": ([page(title="WWWWWWWWWW " * 5)], site(), {"title-length": "warn"}, []),
    "short-title": ([page(title="Short")], site(), {"title-length": "warn"}, []),
    "robots-all": ([page()], site(robots_txt="User-agent: *\nDisallow: /"), {"robots-blocks-all": "fail", "geo-bot-access": "fail", "robots-sitemap": "warn"}, []),
    "robots-section": ([page()], site(robots_txt="User-agent: *\nDisallow: /blog/\n\nUser-agent: Googlebot\nAllow: /"), {"robots-blocks-section": "warn", "geo-bot-access": "warn"}, []),
    "robots-section-google": ([page()], site(robots_txt="User-agent: *\nDisallow: /blog/"), {"robots-blocks-section": "fail"}, []),
    "robots-section-scraper": ([page()], site(robots_txt="User-agent: BadBot\nDisallow: /blog/\n\nUser-agent: *\nAllow: /"), {"robots-blocks-section": "pass", "geo-bot-access": "pass"}, []),
    "robots-none": ([page()], site(robots_txt=None), {"robots-missing": "warn", "geo-bot-access": "warn"}, ["robots-blocks-all"]),
    "shell": ([page(h1=None, body='<div id="app"></div>')], site(), {"spa-shell": "fail", "geo-spa-risk": "fail", "noscript-fallback": "warn"}, ["content-thin"]),
    "heading-jump": ([page(body="<h3>x</h3>")], site(), {"heading-order": "warn"}, []),
    "mixed": ([page(body='<img src="http://x/i.png" alt=a>')], site(), {"mixed-content": "fail"}, []),
    "twins": ([page(url="https://site.io/a"), page(url="https://site.io/a/", title="Another title of this page")], site(), {"trailing-slash": "warn"}, []),
    "orphan": ([page(url="https://site.io/", body='<a href="/p">to the page</a>'), page(), page(url="https://site.io/lost")], site(), {"orphan-pages": "warn"}, []),
    "linked": ([page(url="https://site.io/", body='<a href="/p">to the page</a>'), page()], site(), {}, ["orphan-pages"]),
    "redirects": ([page(redirect_chain=[("a", 301, "b", 1), ("b", 301, "c", 1)])], site(), {"redirect-chain": "warn"}, []),
    "old": ([page(body="<p>Copyright 2015</p>")], site(), {"copyright-stale": "warn"}, []),
    "questions": ([page(body="<h2>What is it?</h2>", ld=LD + '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"name":"q","acceptedAnswer":{"text":"a"}}]}</script>')], site(), {"geo-qa-content": "pass", "geo-faq-schema": "pass"}, []),
    "author": ([page(more='<meta name="author" content="me"><meta property="article:published_time" content="2025">')], site(), {"geo-eeat": "pass"}, []),
    "broken": ([page()], site(broken_links=[("a", "b", 404), ("a", "c", 503)], favicon_status=404, sitemap_has_lastmod=False, not_found=(False, 200), tls_insecure=True, https=False), {"broken-links": "fail", "broken-links-soft": "info", "favicon-file": "warn", "sitemap-lastmod": "warn", "soft-404": "warn", "ssl-chain-incomplete": "fail", "https": "fail"}, []),
    "speed": ([page(elapsed=5000, html_bytes=600_000, inline_script_bytes=300_000, headers={})], site(psi=(False, True, 45, "AVERAGE")), {"ttfb-slow": "warn", "html-size": "warn", "inline-bloat": "warn", "compression": "warn", "text-ratio": "warn", "cwv-score": "fail", "cwv-field": "warn"}, ["cwv"]),
    "render-same": ([page(rendered_text_length=900, rendered_h1=["A heading"])], site(render_state="available"), {"render-diff": "pass"}, []),
    "render-more": ([page(rendered_text_length=90_000, rendered_h1=["A heading"])], site(render_state="available"), {"render-diff": "fail"}, []),
    "alike": ([page(url=f"https://site.io/{k}", title=f"Title number {k} of pages", text_sample=" ".join(f"term{i}" for i in range(60 + k))) for k in range(2)], site(), {"near-duplicate": "warn"}, []),
}


@pytest.fixture(scope="module")
def found(spark):
    pages, sites = [], []
    names, site_names = [n for n, _ in columns(PAGE)], [n for n, _ in columns(SITE)]
    for name, (rows, s, _, _) in CASES.items():
        for k, r in enumerate(rows):
            row = {"site_id": name, "page_ord": k, **r}
            for f, order in (("headings", ("tag", "text", "sectioned")), ("links", ("href", "text", "rel", "target")), ("images", ("src", "alt", "labeled", "loading", "width", "height")), ("hreflang", ("lang", "href"))):
                row[f] = [tuple(x[o] for o in order) for x in row[f]]
            pages.append(tuple(row.get(n) for n in names))
        sites.append(tuple({"site_id": name, **s}.get(n) for n in site_names))
    p, s = conform(spark.createDataFrame(pages, PAGE), PAGE), conform(spark.createDataFrame(sites, SITE), SITE)
    out = run_checks(p, s, datetime.date(2026, 1, 1)).collect()
    by = {}
    for r in out:
        assert (r.site_id, r.id) not in by
        by[(r.site_id, r.id)] = r
    return by


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    _, _, want, absent = CASES[name]
    got = {i: r.status for (n, i), r in found.items() if n == name}
    assert {k: got.get(k) for k in want} == want
    assert not set(absent) & set(got)


def test_there_are_ninety_checks(spark):
    assert len({i for i, _, _ in decisions()}) == 90


def test_pages_and_counts(found):
    assert found[("states", "error-pages")].pages == ["https://site.io/gone"]
    assert found[("same-titles", "title-duplicate")].affected_count == 2
    assert found[("noindex-home", "noindex")].confidence == 0.8


def test_scores(spark):
    rows = [("a", "onpage", "high", "fail"), ("a", "onpage", "med", "warn"), ("a", "onpage", "low", "pass"), ("a", "geo", "low", "info"), ("a", "odd", "high", "pass"), ("b", "geo", "low", "info")]
    c = spark.createDataFrame(rows, "site_id string, category string, severity string, status string")
    assert {(r.category, r.score) for r in category_scores(c, "site_id").collect()} == {("onpage", 28), ("odd", 100)}
    s = {r.site_id: (r.overall, r.grade, r.fails, r.warns, r.passes) for r in site_scores(c, "site_id").collect()}
    assert s == {"a": (44, "F", 1, 1, 2), "b": (0, "F", 0, 0, 0)}
