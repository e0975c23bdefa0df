"""Changes the head of HTML pages in place: what a fix names is replaced or inserted, every other character stays.

A page is read once by the standard library's tokenizer, which tells where each tag begins; changes
are cuts at those offsets.  Pages and their fixes travel in Arrow batches.

A fix has title, description, canonical, lang, og_title, og_description, og_image, og_url, twitter_card,
json_ld (array of JSON texts) and alts (map from part of an image's address to its text).  Null and
empty fields change nothing.  In the head: a charset is put first if there is none; title and metas are
changed where they first occur, else added at the end; all canonical links go and the given one is added;
a viewport is added, or freed of its limits to zooming; JSON-LD is added only if the page has no block
that can be read, and only blocks that can.  In the body: images without text, or with an empty one, get
that of the first key (in order) that their address contains.

Defined results: null HTML is an empty page; a page without a head gets one behind the html tag, else
behind the doctype, else at the start; a head without an end tag ends at the body, else at the page's end.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..arrow import small_batches, tidy

VIEWPORT = "width=device-width, initial-scale=1"
#: Limits to zooming, with the comma before them.
_NO_ZOOM = re.compile(r",?\s*(?:maximum-scale\s*=\s*[\d.]+|user-scalable\s*=\s*no)", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]+([^\s=/>"']+)(\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?""")
#: (field of a fix, attribute that names the meta tag, its value), in the order of insertion.
METAS = (
    ("description", "name", "description"), ("og_title", "property", "og:title"), ("og_description", "property", "og:description"), ("og_image", "property", "og:image"), ("og_url", "property", "og:url"), ("twitter_card", "name", "twitter:card"),
)
FIX = "title string, description string, canonical string, lang string, og_title string, og_description string, og_image string, og_url string, twitter_card string, json_ld array<string>, alts array<struct<key:string,text:string>>"


class Spots(HTMLParser):
    """Where the tags of a page are that a fix can change: (start, end, attributes) in characters."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.doctype = self.html = self.head = self.head_end = self.title = self.body = None
        self.metas: list[tuple] = []
        self.canonicals: list[tuple] = []
        self.images: list[tuple] = []
        self.blocks: list[str] = []
        self.inside: str | None = None
        self.size = len(text)
        self.feed(text)
        self.close()

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    @property
    def in_head(self) -> bool:
        return self.head is not None and self.head_end is None and self.body is None

    def handle_decl(self, decl: str) -> None:
        if self.doctype is None:
            self.doctype = self.at() + len(decl) + 3

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        start = self.at()
        span = (start, start + len(self.get_starttag_text() or ""), {k: v or "" for k, v in reversed(attrs)})
        if tag in ("html", "head", "body"):
            if getattr(self, tag) is None:
                setattr(self, tag, span)
        elif tag == "meta" and self.in_head:
            self.metas.append(span)
        elif tag == "link" and self.in_head and span[2].get("rel", "").lower() == "canonical":
            self.canonicals.append(span)
        elif tag == "title" and self.in_head and self.title is None:
            self.title = [span[1], None]
        elif tag == "img":
            self.images.append(span)
        elif tag == "script" and span[2].get("type") == "application/ld+json":
            self.inside = ""

    def handle_data(self, data: str) -> None:
        if self.inside is not None:
            self.inside += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self.head_end is None:
            self.head_end = self.at()
        elif tag == "title" and self.title and self.title[1] is None:
            self.title[1] = self.at()
        elif tag == "script" and self.inside is not None:
            self.blocks.append(self.inside)
            self.inside = None


def readable(block: str) -> bool:
    try:
        json.loads(block)
    except ValueError:
        return False
    return True


def quoted(value: str) -> str:
    return '"' + value.replace("&", "&amp;").replace('"', "&quot;") + '"'


def with_attribute(tag: str, name: str, value: str) -> str:
    """The text of a start tag with one attribute changed where it first is, else added."""
    begin = re.match(r"<[^\s/>]+", tag).end()
    for m in _ATTRIBUTE.finditer(tag, begin):
        if m[1].lower() == name:
            return f"{tag[: m.start(1)]}{m[1]}={quoted(value)}{tag[m.end() :]}"
    close = len(tag) - 2 if tag.endswith("/>") else len(tag) - 1
    return f"{tag[:close].rstrip()} {name}={quoted(value)}{tag[close:]}"


def patch(text: str | None, fix: dict) -> str:
    """text with the fix."""
    text = text or ""
    spots = Spots(text)
    edits: list[tuple[int, int, str]] = []
    first: list[str] = []
    last: list[str] = []

    def change(span: tuple, name: str, value: str) -> None:
        edits.append((span[0], span[1], with_attribute(text[span[0] : span[1]], name, value)))

    def named(attribute: str, value: str) -> tuple | None:
        return next((m for m in spots.metas if m[2].get(attribute) == value), None)

    if not any("charset" in m[2] for m in spots.metas):
        first.append('<meta charset="UTF-8">')
    if fix.get("title"):
        title = entities.escape(fix["title"], quote=False)
        if spots.title and spots.title[1] is not None:
            edits.append((*spots.title, title))
        else:
            last.append(f"<title>{title}</title>")
    for field, attribute, value in METAS:
        if content := fix.get(field):
            if m := named(attribute, value):
                change(m, "content", content)
            else:
                last.append(f"<meta {attribute}={quoted(value)} content={quoted(content)}>")
        if field == "description":
            if m := named("name", "viewport"):
                freed = re.sub(r"^,\s*", "", _NO_ZOOM.sub("", m[2].get("content", ""))).strip() or VIEWPORT
                if freed != m[2].get("content"):
                    change(m, "content", freed)
            else:
                last.append(f'<meta name="viewport" content="{VIEWPORT}">')
    if fix.get("canonical"):
        edits += [(a, b, "") for a, b, _ in spots.canonicals]
        last.append(f'<link rel="canonical" href={quoted(fix["canonical"])}>')
    if not any(map(readable, spots.blocks)):
        last += ['<script type="application/ld+json">' + b.replace("</", "<\\/") + "</script>" for b in fix.get("json_ld") or [] if b and readable(b)]
    if fix.get("lang") and spots.html:
        change(spots.html, "lang", fix["lang"])
    for image in spots.images:
        src = image[2].get("src") or image[2].get("data-src") or ""
        hit = next((a["text"] for a in fix.get("alts") or [] if a["key"] and a["text"] and a["key"] in src), None)
        if hit and not image[2].get("alt"):
            change(image, "alt", hit)
    begin, end = "".join(first), "".join(last)
    if spots.head is None:
        at = spots.html[1] if spots.html else spots.doctype or 0
        edits.append((at, at, f"<head>{begin}{end}</head>"))
    else:
        close = spots.head_end if spots.head_end is not None else spots.body[0] if spots.body else spots.size
        edits += [(spots.head[1], spots.head[1], begin), (close, close, end)]
    out, done = [], 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], e[1])):
        out += [text[done:a], new]
        done = b
    return "".join([*out, text[done:]])


def patch_pages(pages: DataFrame, html: str = "html", fix: str = "fix") -> DataFrame:
    """pages with the HTML changed by each row's fix (a struct of FIX's fields), and without the fix."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != fix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            done = pa.array([patch(t, f or {}) for t, f in zip(at[html].to_pylist(), at[fix].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([done if c == html else at[c] for c in kept], kept)
        tidy()

    return pages.mapInArrow(run, StructType([StructField(c, StringType()) if c == html else pages.schema[c] for c in kept]))
