from pagewarden.sources.head_patch import VIEWPORT, patch, patch_pages
from pagewarden.sources.html_page import parse_html

FIX = {
    "title": "New & <better>", "description": 'Say "hi" & go', "canonical": "https://e.example/p", "lang": "th", "og_title": "OG", "og_description": "D", "og_image": "https://e.example/i.png", "og_url": "https://e.example/p",
    "twitter_card": "summary", "json_ld": ["{broken", '{"@type":"Organization","name":"</script>"}'], "alts": [{"key": "hero", "text": 'The "hero"'}, {"key": "", "text": "x"}],
}


def test_body_stays_and_head_is_fixed():
    body = "<body><h1>Old</h1>" + "<p>ไทย &amp; text</p>\n" * 40 + '<img src="/img/hero-house.jpg"><IMG alt=\'\' data-src=hero.png /><img src="/hero.svg" alt="icon"></body></html>'
    html = "<!DOCTYPE html>\n<html>\n<head><title>Old</title><link rel=canonical href=/a><style>p{}</style></head>" + body
    out = patch(html, FIX)
    page = parse_html(out, "https://e.example/p")
    assert (page["title"], page["canonical"], page["canonical_count"], page["lang"], page["charset"]) == ("New & <better>", "https://e.example/p", 1, "th", "UTF-8")
    assert page["metas"]["description"] == 'Say "hi" & go' and page["metas"]["viewport"] == VIEWPORT and page["metas"]["og:url"] == "https://e.example/p"
    assert len(page["json_ld"]) == 1 and [i["alt"] for i in page["images"]] == ['The "hero"', 'The "hero"', "icon"]
    plain = out[out.index("<body>") :].replace(' alt="The &quot;hero&quot;"', "", 1).replace("alt=\"The &quot;hero&quot;\"", "alt=''", 1)
    assert plain == body and "<style>p{}</style>" in out
    again = patch(out, FIX)  # the canonical link is the head's last element now
    assert sorted(again) == sorted(out) and patch(again, FIX) == again


def test_nothing_asked_changes_only_what_always_is_mended():
    html = '<html><head><meta charset=utf-8><meta name="viewport" content="width=device-width"></head><body>x</body></html>'
    assert patch(html, {}) == html
    assert patch('<head><meta charset=x><META NAME="viewport" CONTENT="user-scalable=no"/></head>', {}) == f'<head><meta charset=x><META NAME="viewport" CONTENT="{VIEWPORT}"/></head>'


def test_pages_without_a_head():
    added = f'<head><meta charset="UTF-8"><title>t</title><meta name="viewport" content="{VIEWPORT}"></head>'
    for before, after in (("", ""), ("<!doctype html>", "text"), ("<!doctype html><html lang=en>", "<body>b</body></html>"), ("<html>\n", "")):
        at = len(before) - before.endswith("\n")
        assert patch(before + after, {"title": "t"}) == before[:at] + added + before[at:] + after
    assert patch(None, {"title": "t"}) == added
    open_head = "<html><head><title>a</title><body>b"
    assert patch(open_head, {"title": "t"}).startswith('<html><head><meta charset="UTF-8"><title>t</title><meta name="viewport"') and patch(open_head, {}).endswith("<body>b")


def test_comments_scripts_and_valid_blocks_are_left_alone():
    html = '<head><meta charset=a><!-- <title>no</title> --><script>var t="<title>no</title>"</script><title>yes</title><script type="application/ld+json">{"a":1}</script></head>'
    out = patch(html, {"title": "new", "json_ld": ['{"b":2}']})
    assert "<!-- <title>no</title> -->" in out and '"<title>no</title>"' in out and "<title>new</title>" in out and '{"b":2}' not in out


def test_pages_in_batches(spark):
    rows = [(1, "<head></head>", {"title": "a"}), (2, None, None), (3, "<p>", {"title": None})]
    df = spark.createDataFrame(rows, "id long, html string, fix struct<title:string>")
    out = {r.id: r.html for r in patch_pages(df).collect()}
    assert "<title>a</title>" in out[1] and out[2].startswith("<head>") and out[3].endswith("</head><p>")
    assert patch_pages(df.limit(0)).count() == 0
