import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import jsonld
from pagewarden.functions import text as T
from pagewarden.functions import urls as U
from pagewarden.sources import html_page
from pagewarden.sources.html_page import decode_bytes, parse_html


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return rows.select(column.alias("x")).first().x


def test_widths(spark):
    px = lambda s: one(spark, T.text_px(F.col("s")), s=s)
    assert px("") == 0 and px(None) == 0
    assert px("i" * 10) < px("W" * 10)
    assert px("W") == round(944 / 1000 * 20)
    assert px("กำ") == px("กำ่")  # a stacked mark takes no width
    assert px("漢字") == 40 and px("é") == 11
    assert one(spark, T.grapheme_count(F.col("s")), s="éa") == 2


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.49,)], "x double")
    assert [r.y for r in df.select(T.js_round(F.col("x")).alias("y")).collect()] == [-2, 3, 0]


def test_normal_forms(spark):
    assert one(spark, T.norm_dup(F.col("s")), s="  É   a​B\n") == "é ab"
    assert one(spark, T.title_h1_similarity(F.col("a"), F.col("b")), a="Blue shoes | Shop", b="blue shoes") == 1.0
    assert one(spark, T.title_h1_similarity(F.col("a"), F.col("b")), a="", b="x") is None
    assert one(spark, T.title_h1_similarity(F.col("a"), F.col("b")), a="abcd", b="bcde") == 0.5
    assert one(spark, T.truncate(F.col("s"), 3), s="abcd") == "abc…"


@pytest.mark.parametrize(
    "raw,base,want",
    [
        ("/a?utm_source=x&b=1#f", "https://Ex.com/x/y", "https://ex.com/a?b=1"), ("../z", "http://h.io:80/a/b/c", "http://h.io/a/z"), ("//cdn.io/p", "https://h/", "https://cdn.io/p"), ("mailto:a@b", "https://h/", None),
        ("?q=1", "https://h/p", "https://h/p?q=1"), ("https://h:443", None, "https://h/"), ("a b", "https://h/d/", "https://h/d/a%20b"), ("http://[bad", "https://h/", None), (None, "https://h/", None), ("http://h/./x/..", None, "http://h/"),
    ],
)
def test_resolution(raw, base, want):
    assert U.resolve_one(raw, base) == want


def test_url_parts(spark):
    u = "https://www.Shop.Example.co.th:443/th/About/?a=1#x"
    f = lambda c: one(spark, c, u=u)
    assert f(U.host(F.col("u"))) == "www.shop.example.co.th"
    assert f(U.registrable_domain(U.host(F.col("u")))) == "example.co.th"
    assert f(U.strip_locale(F.col("u"))) == "https://www.shop.example.co.th/About/"
    assert f(U.norm_site_path(F.col("u"))) == "shop.example.co.th/th/About"
    assert f(U.site_key(F.col("u"))) == "shop.example.co.th/th/About?a=1"
    assert f(U.url_depth(F.col("u"))) == 2 and f(U.language_of(F.lit(""), F.col("u"))) == "th"
    assert one(spark, U.decode_bing(F.col("u")), u="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leC5jb20v&x") == "https://ex.com/"


def test_json_ld():
    org = '{"@context":"https://schema.org","@type":"Organization","name":"X"}'
    f = jsonld.facts_of([org, "{bad"])
    assert (f["count"], f["bad"], f["types"], f["errors"]) == (2, 1, ["Organization"], [])
    assert set(f["warnings"]) == {"Organization.url", "Organization.logo", "Organization.sameAs"}
    assert jsonld.facts_of(['{"@type":"Offer","price":""}'])["errors"] == ["Offer.price", "Offer.priceCurrency"]
    assert jsonld.facts_of(['{"@type":"AggregateRating","ratingValue":4}'])["errors"] == ["AggregateRating.reviewCount|ratingCount"]
    assert jsonld.facts_of(['{"@type":"Restaurant","name":"R"}'])["errors"] == ["Restaurant.address"]
    assert jsonld.facts_of(['{"@graph":[{"@type":["Person","Thing"],"author":{"x":1}}]}'])["types"] == ["Person", "Thing"]
    assert jsonld.facts_of(['{"a":{"b":{"@type":"Product"}}}'])["errors"] == ["Product.name"]
    assert jsonld.facts_of(['{"@type":"Unknown"}'])["validatable"] == []
    assert jsonld.sanitize('{"a": [1, 2,], /* note */ "b": 3,}') == '{"a": [1, 2], "b": 3}'


def test_decoding():
    thai = "สวัสดี"
    assert decode_bytes(thai.encode("cp874"), "text/html; charset=windows-874") == (thai, "windows-874")
    assert decode_bytes(b'<meta charset="tis-620">' + thai.encode("tis-620"))[0].endswith(thai)
    assert decode_bytes(None) == ("", "utf-8") and decode_bytes(b"x", "charset=nonsense")[1] == "utf-8"


def test_parser():
    p = parse_html(
        """<!DOCTYPE html><html lang=en><head><title> A &amp; B </title><meta name=Description content=d1><meta property="og:title" content=t><meta name=description content=d2>
        <link rel="shortcut icon" href=f><link rel=canonical href=/c><script src=a.js></script><script src=b.js defer></script><script>var t="</p>";</script></head>
        <body><h1 style="display:none">Hi <b>you</b></h1><h2></h2><a href="/x"><img src=i alt="pic"></a><a href="mailto:q@x.io">mail</a><a href="#top">t</a>
        <img src=big.png width=9 height=9><img src=p width=1><p>one<br><p>two <table></table><ul><li>a</ul><noscript>no</noscript><font>old</font> © 2019-2021 <a href="https://facebook.com/me">f</a></body></html>"""
    )
    assert (p["title"], p["lang"], p["canonical"], p["favicon"], p["has_doctype"]) == ("A & B", "en", "/c", True, True)
    assert p["metas"]["description"] == "d2" and p["metas"]["og:title"] == "t"
    assert [(h["tag"], h["text"]) for h in p["headings"]] == [("h1", "Hi you"), ("h2", "")] and p["hidden_h1"] == 1 and p["empty_headings"] == 1
    assert [(x["href"], x["text"]) for x in p["links"]] == [("/x", ""), ("https://facebook.com/me", "f")] and p["has_mailto"]
    assert [i["labeled"] for i in p["images"]] == [True, False, True] and p["images"][1]["alt"] is None
    assert (p["head_blocking_scripts"], p["deprecated_tags"], p["max_copyright_year"], p["has_tables"], p["list_count"], p["has_noscript"]) == (1, 1, 2019, True, 1, True)
    assert p["socials"] == ["https://facebook.com/me"]
    assert parse_html('<div id="root"></div>')["empty_root"] and not parse_html("<p>text</p>")["empty_root"]
    assert parse_html(None)["title"] == "" and parse_html("<p>x " * 50)["word_count"] == 50


def test_signals_of_the_body():
    phone = lambda x: parse_html(f"<body>{x}")["has_phone"]
    assert not phone("Order 12345678 items") and phone("call 02 123 4567") and phone("+66-812-3456") and not phone("<script>021234567</script>")
    year = lambda x: parse_html(f"<body><p>{x}")["max_copyright_year"]
    assert year("© Example Holdings Limited Thailand 2019") == 2019 and year("Copyright 1899") is None and year("&copy; 2019, copyright 2023") == 2023 and year("© " + "x" * 41 + "2019") is None
    assert year("\u00a9\n2019") is None


def test_profiles():
    links = "".join(f'<a href="{h}">x</a>' for h in (
        "https://www.facebook.com/sharer/sharer.php?u=1", "https://youtube.com/watch?v=1", "https://youtu.be/x", "https://www.youtube.com/@me/", "https://facebook.com/", "https://www.facebook.com/ShareInvestor?x=1", "https://facebook.com/second",
        "https://th.linkedin.com/company/c", "https://line.me/x", "https://github.com/x", "https://threads.net/@t", "https://x.com/intent/tweet", "/local",
    ))
    assert parse_html(links, "https://a.example/")["socials"] == ["https://youtube.com/@me", "https://facebook.com/ShareInvestor", "https://th.linkedin.com/company/c", "https://threads.net/@t"]


def test_logo_and_author():
    ld = '<script type="application/ld+json">{"@type": "Organization", "logo": {"@type": "ImageObject", "url": "/l.svg"}, "author": {"name": "Ann B"}}</script>'
    p = parse_html(ld + '<img class="site-LOGO" src="/x.png">', "https://a.example/b/c")
    assert (p["logo"], p["author"]) == ("https://a.example/l.svg", "Ann B")
    p = parse_html('<meta property="og:image" content="o.png"><div class=logo-box><img data-src="in.webp?v=1"></div><p class=byline>by <a href=/u>Bo  C</a></p>', "https://a.example/b/")
    assert (p["logo"], p["author"]) == ("https://a.example/b/in.webp?v=1", "Bo C")
    p = parse_html('<meta property="og:image" content="/o.png"><meta name=author content=" Cy "><img src="/logo"><a rel="nofollow author">Dee</a>', "https://a.example/")
    assert (p["logo"], p["author"]) == ("https://a.example/o.png", "Cy")
    assert parse_html('<a rel="author">' + "n" * 60 + "</a>")["author"] == "" and parse_html('<script type="application/ld+json">{bad</script><img src=logo>')["logo"] == ""


def test_empty_containers():
    long = "word " * 60
    empty = lambda x: parse_html(x)["empty_root"]
    assert empty(f"<div id=root></div><p>{long}") and empty(f"<div id=app>{long}</div><div id=__next>x</div>") and empty("<main data-reactroot><script>" + long + "</script></main>")
    assert not empty(f"<div id=app><div id=root>{long}</div></div>") and not empty(f"<div id=other></div>{long}")
    assert parse_html("<p>react-dom __vue__")["framework_markers"] == ["react", "vue"]


def test_headings_images_and_links():
    p = parse_html('<aside><h1>a</h1></aside><section><h1 style="font-size:0">b</h1></section><div style="display:none"><h1>c</h1></div><h2><img src=x alt=y></h2><big>x</big><a href="">e</a><a>none</a>')
    assert [h["sectioned"] for h in p["headings"]] == [False, True, False, None] and (p["hidden_h1"], p["empty_headings"], p["deprecated_tags"]) == (1, 1, 0)
    assert [x["href"] for x in p["links"]] == [""]
    p = parse_html('<img data-src=d.png width="1.5px"><img src=e.png height=9><link rel="stylesheet preload" href=a><link rel=stylesheet href=b><p>fo<b>o</b>bar')
    assert [i["labeled"] for i in p["images"]] == [True, False] and p["images"][0]["src"] == "d.png" and p["stylesheets"] == ["b"] and p["word_count"] == 1


def test_as_of_is_a_parameter():
    assert datetime.date(2026, 1, 1).year == 2026


def test_links_that_name_no_social_host_are_not_taken_apart(monkeypatch):
    joined = []
    monkeypatch.setattr(html_page, "urljoin", lambda *a: joined.append(a) or urljoin(*a))
    links = "".join(f'<a href="/p{k}">p</a>' for k in range(50)) + '<a href="https://www.Face\tbook.com/me/">f</a><a href="//x.com/you">x</a>'
    assert parse_html(links, "https://a.example/")["socials"] == ["https://Facebook.com/me", "https://x.com/you"] and len(joined) < 10
    assert parse_html('<a href="/me">m</a>', "https://facebook.com/")["socials"] == ["https://facebook.com/me"]
    years = lambda x: parse_html(f"<p>{x}")["max_copyright_year"]
    assert [years(x) for x in ("CopyRight 2019", "© A 2020 © 2018", "&amp;COPY; 2021", "in 2022")] == [2019, 2020, 2021, None]
    assert parse_html("<p>a\u00a0 b\x1f\n\u2003c ")["text_sample"] == "a b c"
