import json
import random
import re

from pyspark.sql import functions as F

from pagewarden.functions.jsonld import facts_of
from pagewarden.operators.glossary import annotate_terms, automaton, mark, occurrences
from pagewarden.operators.schema import schema_blocks, validated
from pagewarden.sources.places import element_places

PAGE = "site_id string, url string, brand string, title string, description string, author string, logo string, socials array<string>, language string, questions array<struct<question:string,answer:string>>"


def test_terms_are_those_of_one_alternation():
    """Against a pattern of all terms, longest first, at every place from the left."""
    rng = random.Random(1)
    terms = {t: f'<{t}> & "x"' for t in ("ab", "abc", "b", "c a", "a", "bc", "ba ba", "é", "a.b", "+")}
    pattern = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + ")(?![A-Za-z0-9])")
    known = automaton(terms)
    for _ in range(3000):
        text = "".join(rng.choices("abc é.+ 1", k=rng.randint(0, 25)))
        want = [(m.start(), m[0]) for m in pattern.finditer(text)]
        assert list(occurrences(text, known)) == want
        marked, used = mark(text, terms, known)
        assert re.sub(r"<span[^>]*>|</span>", "", marked) == text and sum(n for _, _, n in used) == len(want)
        assert [(t, f) for t, f, _ in used] == list({t: (t, f) for f, t in reversed(want)}.values())[::-1] or {(t, f) for t, f, _ in used} == {(t, min(f for f, x in want if x == t)) for _, t in want}


def test_terms_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "see SEO & seo", 5), (2, None, 6), (3, "", 7)], "id long, text string, terms long")
    out = {r.id: r for r in annotate_terms(df, {"SEO": 'search "engine"', "": "never"}).collect()}
    assert out[1].text == 'see <span class="gloss" title="search &quot;engine&quot;">SEO</span> & seo' and [tuple(t) for t in out[1].terms] == [("SEO", 4, 1)]
    assert out[2].text == "" and out[3].terms == [] and annotate_terms(df, {}).count() == 3 and annotate_terms(df.limit(0), {"a": "b"}).count() == 0


def test_blocks_hold_what_is_known_and_pass_the_validator(spark):
    base = "https://s.example"
    none = [None] * 7
    rows = [
        ("s", base + "/", "S", "Home", "D", None, "", None, "en", None), ("s", base + "/blog/one-two", "S", None, None, None, None, [], None, None), ("s", base + "/about", 'S "q"', "Ünï", "d" * 300, "Ann", base + "/l.png", ["https://x.com/s"], "en", None),
        ("s", base + "/faq", "S", *none), ("s", base + "/faq/two", "S", None, None, None, None, None, "en", [("Q?", "A."), ("open", None)]), ("s", "", "S", *none), ("s", None, "S", *none),
    ]
    out = {r.url: r for r in validated(schema_blocks(spark.createDataFrame(rows, PAGE))).collect()}
    parsed = {u: [json.loads(b) for b in r.blocks] for u, r in out.items() if u}
    assert all(r.bad == 0 and r.errors == [] for u, r in out.items() if u)
    graph = parsed[base + "/about"][0]["@graph"]
    assert graph[0] == {"@type": "Organization", "@id": base + "/#org", "name": 'S "q"', "url": base + "/", "logo": base + "/l.png", "description": "d" * 200, "sameAs": ["https://x.com/s"]} and graph[1]["publisher"] == {"@id": base + "/#org"}
    assert "sameAs" not in parsed[base + "/"][0]["@graph"][0] and len(parsed[base + "/"]) == 1
    article = parsed[base + "/blog/one-two"][-1]
    assert article["@type"] == "Article" and article["headline"] == "One Two" and article["author"] == {"@id": base + "/#org"}
    assert [x["position"] for x in parsed[base + "/blog/one-two"][1]["itemListElement"]] == [1, 2, 3]
    assert len(parsed[base + "/faq"]) == 2 and [q["name"] for q in parsed[base + "/faq/two"][-1]["mainEntity"]] == ["Q?"]
    assert facts_of(out[base + "/faq/two"].blocks)["types"][-1] == "FAQPage"


def test_places_of_elements(spark):
    html = "<!doctype html>\n<html lang=en>\n<head><TITLE>a\nb</TITLE><title>2</title>\n</head>\n <h1 class=x>\n one\n</h1></html>"
    df = spark.createDataFrame([(1, html, 9), (2, None, 9), (3, "", 9)], "id long, html string, line long")
    out = {(r.id, r.focus): r for r in element_places(df.select("id", "html")).collect()}
    title, h1 = out[1, "title"], out[1, "h1"]
    assert (title["count"], title.line, title.column, title.end_line, title.snippet) == (2, 3, 7, 4, "<TITLE>a b</TITLE>")
    assert (h1["count"], h1.line, h1.column, h1.end_line, h1.snippet) == (1, 6, 2, 8, "<h1 class=x> one </h1>")
    assert out[1, "desc"]["count"] == 0 and out[1, "desc"].line is None and len(out) == 21 and all(out[2, f]["count"] == 0 for f in ("title", "lang"))
    one = element_places(df.select("id", "html"), {"end": "</html>$"}).where(F.col("id") == 1).first()
    assert (one.line, one.end_line) == (8, 8)
