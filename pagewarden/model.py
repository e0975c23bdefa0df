"""The tables of the engine.  Every table carries site_id, and a site's pages are ordered by page_ord."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row for each crawled URL.
PAGE = """
site_id string, page_ord bigint, url string, final_url string, status int, elapsed bigint, is_html boolean, blocked boolean, detected_charset string,
title string, lang string, charset string, canonical string, canonical_count int, favicon boolean, amp_html string,
metas map<string,string>, headers map<string,string>,
headings array<struct<tag:string,text:string,sectioned:boolean>>,
links array<struct<href:string,text:string,rel:string,target:string>>,
images array<struct<src:string,alt:string,labeled:boolean,loading:string,width:string,height:string>>,
image_vis array<struct<src:string,alt:string,labeled:boolean,visible:boolean,aria_hidden:boolean>>,
hreflang array<struct<lang:string,href:string>>, json_ld array<string>,
scripts array<string>, stylesheets array<string>, inline_script_bytes int, inline_style_bytes int, has_noscript boolean,
html_bytes int, word_count int, text_length int, text_sample string, list_count int, has_tables boolean,
has_doctype boolean, head_blocking_scripts int, deprecated_tags int, meta_refresh boolean, empty_headings int, hidden_h1 int,
has_phone boolean, has_mailto boolean, max_copyright_year int, socials array<string>, logo string, author string,
empty_root boolean, framework_markers array<string>, title_h1_sim double,
redirect_chain array<struct<url:string,status:int,location:string,elapsed:bigint>>,
rendered_title string, rendered_description string, rendered_h1 array<string>, rendered_h1_hidden int, rendered_text_length int
"""

#: One row for each site.
SITE = """
site_id string, start_url string, origin string, https boolean, robots_txt string, robots_status int, sitemaps array<string>,
sitemap_urls array<string>, sitemap_has_lastmod boolean, favicon_status int, llms_txt string, tls_insecure boolean,
not_found struct<ok:boolean,status:int>, variants array<struct<variant:string,status:int,final_origin:string,error:string>>,
broken_links array<struct<from:string,to:string,status:int>>, render_state string,
psi struct<skip:boolean,ok:boolean,perf_score:int,overall:string>
"""

#: One finding of a check.
CHECK = "site_id string, emit_ord int, id string, category string, severity string, status string, affected_count bigint, pages array<string>, confidence double"


def columns(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema string, split outside of brackets."""
    out, depth, word = [], 0, ""
    for ch in schema.strip() + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, _, kind = word.strip().partition(" ")
            out.append((name, kind.strip()))
            word = ""
        else:
            word += ch
    return out


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns: missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns(schema)])
