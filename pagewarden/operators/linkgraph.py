"""The internal link graph: in-links, orphans, anchors, health, targets that were not crawled, crawls with a budget, redirects."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import js_round


def inlinks(links: DataFrame) -> DataFrame:
    """(site_id, target, inlinks) of links(site_id, target)."""
    return links.where(F.col("target").isNotNull()).groupBy("site_id", "target").agg(F.count(F.lit(1)).alias("inlinks"))


def uncrawled_targets(links: DataFrame, pages: DataFrame, k: int = 40) -> DataFrame:
    """(site_id, target, rank): the first k targets in order that are no page's URL."""
    known = pages.select("site_id", F.col("url").alias("target")).distinct()
    rest = links.where(F.col("target").isNotNull()).select("site_id", "target").distinct().join(known, ["site_id", "target"], "left_anti")
    return rest.withColumn("rank", F.row_number().over(W.partitionBy("site_id").orderBy("target"))).where(F.col("rank") <= k)


def anchors(links: DataFrame) -> DataFrame:
    """(site_id, anchor, n) of internal links' texts in lower case, of more than one character."""
    text = F.substring(F.lower(F.trim("text")), 1, 120)
    return links.where("internal").select("site_id", text.alias("anchor")).where(F.length("anchor") > 1).groupBy("site_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


def top_anchors(links: DataFrame, k: int = 8) -> DataFrame:
    w = W.partitionBy("site_id").orderBy(F.desc("n"), "anchor")
    return anchors(links).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def link_health(links: DataFrame) -> DataFrame:
    """Per site of links(site_id, internal, rel, text): counts, share of nofollow, anchor diversity, over-used anchors among the top eight."""
    inside = F.col("internal")
    base = links.groupBy("site_id").agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"), F.count_if(inside & F.col("rel").contains("nofollow")).alias("nofollow"))
    kinds = anchors(links).groupBy("site_id").agg(F.count(F.lit(1)).alias("unique_anchors"))
    top = top_anchors(links).join(base.select("site_id", F.col("internal").alias("all")), "site_id")
    over = top.groupBy("site_id").agg(F.count_if((F.col("all") > 5) & (F.col("n") / F.col("all") > 0.4)).alias("over_optimised"))
    rows = base.join(kinds, "site_id", "left").join(over, "site_id", "left").fillna(0, ["unique_anchors", "over_optimised"])
    some = F.greatest("internal", F.lit(1))
    return rows.withColumns({"nofollow_pct": F.when(F.col("internal") > 0, js_round(F.col("nofollow") / some * 100)).otherwise(0), "diversity": F.when(F.col("internal") > 0, F.least(F.lit(100), js_round(F.col("unique_anchors") / some * 150))).otherwise(0)})


def health_orphans(pages: DataFrame, links: DataFrame, k: int = 8) -> DataFrame:
    """(site_id, url): the first k pages, other than a root, to whose URL no internal link points."""
    targets = links.where("internal AND target IS NOT NULL").select("site_id", F.col("target").alias("url")).distinct()
    rest = pages.where((F.col("status") == 200) & (U.path(F.col("url")) != "/")).join(targets, ["site_id", "url"], "left_anti")
    return rest.withColumn("_k", F.row_number().over(W.partitionBy("site_id").orderBy("page_ord"))).where(F.col("_k") <= k).select("site_id", "url")


def final_url_dedupe(pages: DataFrame) -> DataFrame:
    """One page for each final URL: the one that was not redirected, else the first."""
    final = F.coalesce("final_url", "url")
    w = W.partitionBy("site_id", final).orderBy((F.col("url") != final), "page_ord")
    return pages.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def parameter_cap(urls: DataFrame, k: int = 3) -> DataFrame:
    """urls(site_id, url, ord) without those with a query that come after k others of their path."""
    has = U.search(F.col("url")) != ""
    w = W.partitionBy("site_id", U.origin(F.col("url")), U.path(F.col("url")), has).orderBy("ord", "url")
    return urls.withColumn("_k", F.row_number().over(w)).where(~has | (F.col("_k") <= k)).drop("_k")


def reached(start: DataFrame, links: DataFrame, persist) -> DataFrame:
    """(site_id, url) of all URLs to which links(site_id, url, target) lead from start(site_id, url), itself included.

    In every round each URL points at one that is not reached yet and leads on itself, by another hash in each round;
    pointers are doubled, so that a path of n pages is followed in log2(n) steps.  Then all links of the URLs reached so
    far are taken, and rounds end when these add none.  So the number of steps does not grow with the length of a site's paths.
    """
    key = ["site_id", "url"]
    every = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    links = persist(links.where(F.col("target").isNotNull()).select("site_id", "url", "target").distinct())
    names = start.select(*key).union(links.select(*key)).union(links.select("site_id", "target")).distinct()
    names = persist(names.withColumn("id", F.monotonically_increasing_id()))  # written, so that the ids stay
    ends = links.join(names.withColumnRenamed("id", "a"), key).join(names.select("site_id", F.col("url").alias("target"), F.col("id").alias("b")), ["site_id", "target"])
    edges = persist(ends.where(F.col("a") != F.col("b")).select("a", "b"))
    leads = edges.select(F.col("a").alias("b")).distinct()
    onward = persist(edges.join(leads, "b", "left_semi").select("a", "b"))
    known, rounds = persist(start.select(*key).distinct().join(names, key).select("id")), 0
    while True:
        open_ = onward.join(known.withColumnRenamed("id", "b"), "b", "left_anti")
        jump = persist(open_.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(rounds))).alias("b")))
        got = [known]
        while True:
            hit = every(got).join(jump, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
            got.append(persist(hit.join(every(got), "id", "left_anti")))
            if got[-1].isEmpty():  # what is reached is closed under all further jumps as well
                break
            jump = persist(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
        near = edges.join(every(got).withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        fresh = persist(near.join(every(got), "id", "left_anti"))
        if fresh.isEmpty():
            return names.join(every(got), "id", "left_semi").select(*key)
        known, rounds = persist(every([*got, fresh])), rounds + 1


def bfs_crawl(start: DataFrame, links: DataFrame, budget: int, persist, params: int | None = None, levels: bool = True) -> DataFrame:
    """(site_id, url, depth, level) of the pages that a crawl takes, ``budget`` of each site at most.

    Without ``levels`` there is no such column; a site whose budget lasts for all that its links lead to is then
    told without its rounds, of which there are as many as its longest path has pages.

    start(site_id, url); links(site_id, url, target) is the known link table.  In every round a site
    takes all URLs that it has found of the least path depth, in the order of URLs, and finds their
    targets; of the URLs of a path with a query only the first ``params`` are found (None: all).

    A round appends what it found and what it took; nothing is written again.  ``persist`` writes a
    table and reads it back; the driver holds only the loop and one table for each round.
    """
    key = ["site_id", "url"]
    if not levels:
        if params is not None:
            return bfs_crawl(start, links, budget, persist, params).drop("level")
        whole = persist(reached(start, links, persist))
        over = persist(whole.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > budget).select("site_id"))
        some = whole.withColumn("depth", U.url_depth(F.col("url")).cast("long"))
        if over.isEmpty():
            return some
        rest = bfs_crawl(start.join(over, "site_id", "left_semi"), links.join(over, "site_id", "left_semi"), budget, persist)
        return some.join(over, "site_id", "left_anti").unionByName(rest.drop("level"))
    links = links.where(F.col("target").isNotNull()).select("site_id", "url", "target").distinct()
    found: list[DataFrame] = []
    taken: list[DataFrame] = []
    every = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    fresh = start.select(*key).distinct()
    while True:
        if params is not None:
            fresh = _first_with_query(fresh, every(found) if found else None, params)
        found.append(persist(fresh.withColumn("depth", U.url_depth(F.col("url")).cast("long"))))
        open_ = every(found)
        if taken:
            used = every(taken).groupBy("site_id").agg(F.count(F.lit(1)).alias("used"))
            open_ = open_.join(every(taken).select(*key), key, "left_anti").join(used, "site_id", "left").fillna(0, ["used"])
        else:
            open_ = open_.withColumn("used", F.lit(0).cast("long"))
        least = open_.groupBy("site_id").agg(F.min("depth").alias("depth"))
        order = W.partitionBy("site_id").orderBy("url")
        ranked = open_.where(F.col("used") < budget).join(least, ["site_id", "depth"]).withColumn("k", F.row_number().over(order))
        taken.append(persist(ranked.where(F.col("k") + F.col("used") <= budget).select("site_id", "url", "depth", F.lit(len(taken) + 1).alias("level"))))
        if taken[-1].isEmpty():
            return every(taken)
        fresh = links.join(taken[-1].select(*key), key, "left_semi").select("site_id", F.col("target").alias("url")).distinct().join(every(found).select(*key), key, "left_anti")


def _first_with_query(fresh: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """fresh without the URLs with a query that come after k others of their path, of those found before and of these in order."""
    path = F.concat(U.origin(F.col("url")), U.path(F.col("url")))
    rows = fresh.withColumns({"path": path, "asks": U.search(F.col("url")) != ""})
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("site_id", "path", "asks").orderBy("url")))
    if found is None:
        return rows.where(~F.col("asks") | (F.col("k") <= k)).select("site_id", "url")
    before = found.where(U.search(F.col("url")) != "").groupBy("site_id", path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(before, ["site_id", "path"], "left").where(~F.col("asks") | (F.col("k") + F.coalesce("n", F.lit(0)) <= k)).select("site_id", "url")


def redirect_outcomes(hops: DataFrame, persist, most: int = 8) -> DataFrame:
    """(url, hops, final_url, status, outcome) of every URL of hops(url, status, location), which has a row for each URL.

    A URL moves if its status is 3xx and it has a location.  Pointers are doubled: after round k a URL
    knows where 2^k moves lead, so a chain of n moves ends in log2(n) rounds.  A round in which no URL
    reaches an end has left only cycles and what leads to them, as the last open URLs of a chain that
    ends do reach it.  Ends are appended, only open URLs are joined again.

    outcome: ``ok``; ``too_many`` (an end exists, beyond ``most`` moves); ``loop`` (no end);
    ``no_location`` (a 3xx that leads nowhere); ``unknown`` (an address that was not asked).
    """
    moves = F.col("status").between(300, 399) & F.col("location").isNotNull()
    ends = hops.where(~F.coalesce(moves, F.lit(False))).select(F.col("url").alias("end"), F.col("status").cast("int").alias("status"), F.when(F.col("status").between(300, 399), "no_location").otherwise("ok").alias("kind"))
    moving = hops.where(moves).select("url", F.col("location").alias("end"))
    first = persist(moving.join(moving.select(F.col("url").alias("end"), F.lit(True).alias("open")), "end", "left").select("url", F.lit(1).cast("long").alias("hops"), "end", F.coalesce("open", F.lit(False)).alias("open")))
    done = [first.where("NOT open")]
    left, before = first.where("open"), -1
    while (n := left.count()) not in (0, before):
        known = functools.reduce(DataFrame.unionByName, [*done, left])
        on = known.select(F.col("url").alias("end"), F.col("hops").alias("more"), F.col("end").alias("next"), F.col("open").alias("still"))
        jumped = persist(left.join(on, "end").select("url", (F.col("hops") + F.col("more")).alias("hops"), F.col("next").alias("end"), F.col("still").alias("open")))
        done.append(jumped.where("NOT open"))
        left, before = jumped.where("open"), n
    loops = left.select("url", F.lit(None).cast("long").alias("hops"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("int").alias("status"), F.lit("loop").alias("outcome"))
    at_end = hops.where(~F.coalesce(moves, F.lit(False))).select("url", F.lit(0).cast("long").alias("hops"), F.col("url").alias("end"))
    ended = functools.reduce(DataFrame.unionByName, [at_end, *[d.drop("open") for d in done]]).join(ends, "end", "left")
    outcome = F.when(F.col("hops") > most, "too_many").otherwise(F.coalesce("kind", F.lit("unknown")))
    return ended.select("url", "hops", F.col("end").alias("final_url"), "status", outcome.alias("outcome")).unionByName(loops)
