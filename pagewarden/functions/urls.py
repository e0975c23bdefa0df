"""URL functions as columns.

Those that only take a URL apart are built-in expressions.  Resolving a reference against a base
(the rules of the WHATWG URL standard that matter for links) is one Arrow function.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say nothing about the page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
# Suffixes of two labels under which names are registered.
TWO_LEVEL = ("co.th", "or.th", "ac.th", "go.th", "in.th", "co.uk", "com.au", "co.jp", "com.sg", "co.kr")
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_PORTS = {"http": 80, "https": 443}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    """Lower case, without user and port; '' if the URL has none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    """'/' where a URL with a host has no path."""
    p = F.regexp_extract(url, _PARTS, 3)
    return F.when((p == "") & (host(url) != ""), F.lit("/")).otherwise(p)


def search(url: Column) -> Column:
    """The query with its '?', or ''."""
    return F.regexp_replace(F.coalesce(F.regexp_extract(url, _PARTS, 4), F.lit("")), r"^\?$", "")


def origin(url: Column) -> Column:
    s = scheme(url)
    port = F.regexp_extract(F.regexp_extract(url, _PARTS, 2), r":(\d+)$", 1)
    default = (port == "") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443"))
    return F.concat(s, F.lit("://"), host(url), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return bare_host(a) == bare_host(b)


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, three under a suffix of two labels."""
    labels = F.split(F.regexp_replace(F.lower(name), r"^www\.", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(last(2).isin(*TWO_LEVEL), last(3)).otherwise(last(2))


def url_depth(url: Column) -> Column:
    """Number of path segments; 99 for what is not a URL."""
    return F.when(host(url) == "", F.lit(99)).otherwise(F.size(F.filter(F.split(path(url), "/"), lambda s: s != "")))


def strip_locale(url: Column) -> Column:
    """Origin and path without a leading /xx or /xx-yy; the URL itself if it is none."""
    rest = F.regexp_replace(path(url), "(?i)^/[a-z]{2}(-[a-z]{2})?(?=/|$)", "")
    return F.when(host(url) == "", url).otherwise(F.concat(origin(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def language_of(lang: Column, url: Column) -> Column:
    """The primary subtag of html lang, else a two-letter first path segment, else ''."""
    tag = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), "^([^-_]*)", 1))
    return F.when(tag != "", tag).otherwise(F.lower(F.regexp_extract(path(url), "(?i)^/([a-z]{2})(?:-[a-z]{2})?(?=/|$)", 1)))


def norm_site_path(url: Column) -> Column:
    """Host without www. and path without its last slash: the key under which a site's audits are compared."""
    return F.when(host(url) == "", url).otherwise(F.concat(bare_host(url), F.regexp_replace(path(url), "/$", "")))


def norm_no_scheme(url: Column) -> Column:
    """Lower case without scheme, www. and last slashes: the key of titles."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^https?://(www\.)?", ""), "/+$", "")


def site_key(url: Column) -> Column:
    """As norm_site_path with the query: the key of the quality board."""
    return F.when(host(url) == "", url).otherwise(F.concat(bare_host(url), F.regexp_replace(path(url), "/$", ""), search(url)))


def norm_sitemap(url: Column) -> Column:
    """Origin without www. and path without its last slash: how pages are looked up in a sitemap."""
    return F.when(host(url) == "", url).otherwise(F.concat(F.regexp_replace(origin(url), r"//www\.", "//"), F.regexp_replace(path(url), "/$", "")))


# Kinds of pages by patterns of their path, in order; of sites by patterns of all their paths.
PAGE_KINDS = (
    ("contact", "(?i)contact|ติดต่อ"), ("faq", "(?i)faq|คำถามที่พบบ่อย"), ("about", "(?i)about|team|company|profile|เกี่ยวกับ"), ("article", "(?i)/(blogs?|news|articles?|posts?)/.+"), ("bloglist", "(?i)/(blogs?|news|articles?)$"),
    ("service", "(?i)service|product-and-service|solution|บริการ"), ("career", "(?i)career|job|recruit|ร่วมงาน"), ("policy", "(?i)privacy|cookie|term|policy|นโยบาย|sitemap"),
)
SITE_KINDS = (("ecommerce", "/(product|shop|store|cart|checkout|collection)"), ("service", "service|solution|product-and-service"), ("content", "(blogs?|news|article)"))


def page_type(url: Column) -> Column:
    """The kind of page that a path points at, without a leading /en or /th and last slashes; the first that fits."""
    p = F.regexp_replace(F.regexp_replace(path(url), "^/(en|th)(?=/|$)", ""), "/+$", "")
    out = F.lit("other")
    for name, pattern in reversed(PAGE_KINDS):
        out = F.when(p.rlike(pattern), name).otherwise(out)
    return F.when(host(url) == "", "other").when((p == "") | p.endswith("/home"), "home").otherwise(out)


def site_kind(urls: Column) -> Column:
    """The kind of site by the URLs of its pages (an array): shop, services, content, else corporate."""
    out = F.lit("corporate")
    for name, pattern in reversed(SITE_KINDS):
        out = F.when(_any(urls, pattern), name).otherwise(out)
    return out


def _any(urls: Column, pattern: str) -> Column:
    return F.exists(F.transform(urls, lambda u: F.lower(path(u))), lambda p: p.rlike(pattern))


def breadcrumbs(url: Column) -> Column:
    """array<struct<position, name, item>>: the root, then each path segment but a language, with its readable name."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    each = F.transform(segments, lambda s, i: F.struct(s.alias("s"), F.concat(origin(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/")).alias("item")))
    named = F.filter(each, lambda x: ~F.lower(x["s"]).isin("en", "th"))
    upper = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    title = lambda s: F.array_join(F.transform(F.split(F.regexp_replace(F.try_url_decode(s), "[-_]+", " "), " "), upper), " ")
    crumbs = F.transform(named, lambda x, i: F.struct((i + 2).alias("position"), F.coalesce(title(x["s"]), x["s"]).alias("name"), x["item"].alias("item")))
    return F.concat(F.array(F.struct(F.lit(1).alias("position"), F.lit("Home").alias("name"), F.concat(origin(url), F.lit("/")).alias("item"))), crumbs)


def origin_variants(start: Column) -> Column:
    """The other addresses of a site: http and https, with and without www."""
    bare = bare_host(start)
    every = F.array(*[F.concat(F.lit(s), bare, F.lit("/")) for s in ("https://", "https://www.", "http://", "http://www.")])
    return F.filter(every, lambda v: v != F.concat(origin(start), F.lit("/")))


def resolve_one(raw: str | None, base: str | None) -> str | None:
    """An absolute http(s) URL without fragment and tracking parameters, or None."""
    if raw is None:
        return None
    try:
        parts = urlsplit(urljoin(base or "", re.sub(r"[\t\n\r]", "", raw.strip())))
        if parts.scheme.lower() not in _PORTS or not parts.hostname:
            return None
        port = parts.port
    except ValueError:
        return None
    s = parts.scheme.lower()
    name = parts.hostname.rstrip() + (f":{port}" if port and port != _PORTS[s] else "")
    kept = [p for p in parts.query.split("&") if p and p.split("=")[0] not in TRACKING]
    segments: list[str] = []
    for seg in (parts.path or "/").replace("\\", "/").split("/")[1:]:
        if seg in (".", "%2e"):
            continue
        if seg == "..":
            segments = segments[:-1]
        else:
            segments.append(seg)
    if parts.path.endswith(("/.", "/..")):
        segments.append("")
    return urlunsplit((s, name, "/" + "/".join(segments).replace(" ", "%20"), "&".join(kept), ""))


def normalize_url(raw: Column, base: Column) -> Column:
    """resolve_one as a column."""
    return F.arrow_udf(_resolve, "string")(raw, base)


def _resolve(raw: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([resolve_one(a.as_py(), b.as_py()) for a, b in zip(raw, base, strict=True)], pa.string())


def decode_bing(url: Column) -> Column:
    """The target in the base64url parameter ``u`` of a redirect link; the URL itself if there is none."""
    token = F.regexp_extract(url, r"[?&]u=a1([^&]+)", 1)
    plain = F.translate(token, "-_", "+/")
    full = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    return F.when(token == "", url).otherwise(F.coalesce(F.decode(F.try_to_binary(full, F.lit("base64")), "UTF-8"), url))
