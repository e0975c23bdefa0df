"""JSON-LD blocks that a site's pages lack: its organisation and website, breadcrumbs, and what each kind of page is.

Blocks are built from what was crawled and nothing made up: a field that is not known is left out, and a
FAQ block only comes from questions with answers.  ``validated`` holds them against the rules of the audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.jsonld import ld_facts

CONTEXT = "https://schema.org"


def _node(kind: Column | str, **fields: Column) -> Column:
    """A JSON object of a type; fields that are null are left out.  ``id_`` is @id."""
    named = [v.alias("@id" if k == "id_" else k) for k, v in fields.items()]
    return F.to_json(F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("@type"), *named))


def _block(node: Column) -> Column:
    """The object with its context, which comes first."""
    return F.concat(F.lit(f'{{"@context":"{CONTEXT}",'), F.substring(node, F.lit(2), F.length(node)))


def _ref(origin: Column, name: str) -> Column:
    return F.struct(F.concat(origin, F.lit(f"/#{name}")).alias("@id"))


def site_graph(origin: Column, brand: Column, description: Column, logo: Column, socials: Column, language: Column) -> Column:
    """The block of every page: the organisation and its website, which name each other."""
    home = F.concat(origin, F.lit("/"))
    none = F.nullif(logo, F.lit(""))
    same = F.when(F.size(F.coalesce(socials, F.array().cast("array<string>"))) > 0, socials)
    org = _node("Organization", id_=F.concat(origin, F.lit("/#org")), name=brand, url=home, logo=none, description=F.nullif(F.substring(description, 1, 200), F.lit("")), sameAs=same)
    site = _node("WebSite", id_=F.concat(origin, F.lit("/#website")), url=home, name=brand, publisher=_ref(origin, "org"), inLanguage=language)
    return F.concat(F.lit(f'{{"@context":"{CONTEXT}","@graph":['), org, F.lit(","), site, F.lit("]}"))


def breadcrumb_block(url: Column) -> Column:
    """A list of the path's steps; null for a root."""
    crumbs = U.breadcrumbs(url)
    items = F.transform(crumbs, lambda c: F.struct(F.lit("ListItem").alias("@type"), c["position"].alias("position"), c["name"].alias("name"), c["item"].alias("item")))
    return F.when(F.size(crumbs) > 1, _block(_node("BreadcrumbList", itemListElement=items)))


def page_block(url: Column, brand: Column, title: Column, author: Column, questions: Column) -> Column:
    """What a page is, by its kind; null for kinds that need no block."""
    kind, origin = U.page_type(url), U.origin(url)
    org, name = _ref(origin, "org"), F.nullif(title, F.lit(""))
    last = F.element_at(U.breadcrumbs(url), -1)["name"]
    person = F.when(F.coalesce(author, F.lit("")) != "", _node("Person", name=author)).otherwise(F.to_json(org))
    article = _node("Article", headline=F.substring(F.coalesce(name, last), 1, 110), url=url, publisher=org, mainEntityOfPage=url)
    article = F.concat(F.substring(article, F.lit(1), F.length(article) - 1), F.lit(',"author":'), person, F.lit("}"))
    asked = F.filter(F.coalesce(questions, F.array().cast("array<struct<question:string,answer:string>>")), lambda q: (F.coalesce(q["question"], F.lit("")) != "") & (F.coalesce(q["answer"], F.lit("")) != ""))
    faq = F.transform(asked, lambda q: F.struct(F.lit("Question").alias("@type"), q["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), q["answer"].alias("text")).alias("acceptedAnswer")))
    node = (
        F.when(kind == "about", _node("AboutPage", url=url, name=F.coalesce(name, brand), about=org, isPartOf=_ref(origin, "website")))
        .when(kind == "contact", _node("ContactPage", url=url, name=F.coalesce(name, brand), about=org))
        .when(kind == "service", _node("Service", name=F.coalesce(name, last), url=url, provider=org))
        .when(kind == "article", article)
        .when((kind == "faq") & (F.size(asked) > 0), _node("FAQPage", mainEntity=faq))
    )
    return F.when(node.isNotNull(), _block(node))


def schema_blocks(pages: DataFrame) -> DataFrame:
    """(site_id, url, page_type, blocks) of pages(site_id, url, brand, title, description, author, logo, socials, language, questions)."""
    url = F.col("url")
    graph = site_graph(U.origin(url), F.col("brand"), F.col("description"), F.col("logo"), F.col("socials"), F.col("language"))
    blocks = F.array_compact(F.array(graph, breadcrumb_block(url), page_block(url, F.col("brand"), F.col("title"), F.col("author"), F.col("questions"))))
    return pages.select("site_id", "url", U.page_type(url).alias("page_type"), blocks.alias("blocks"))


def validated(blocks: DataFrame) -> DataFrame:
    """blocks with what the audit's validator finds wrong with them: bad (not readable), errors, types."""
    facts = ld_facts(F.col("blocks"))
    return blocks.withColumn("_f", facts).select(*blocks.columns, "_f.bad", "_f.errors", "_f.types").drop("_f")
