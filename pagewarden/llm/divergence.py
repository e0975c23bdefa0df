"""Source divergence audit: how far the word use of each source of a language is from every other's.

A group is a (lang, source); its share of a term is ``p = 1 + floor(scale * (count + add) / (N + add * V))``
over the V terms of the language that are in enough of its documents.  The distance of two groups is
the sum of ``|p - q|`` over all V terms.  It is not computed term by term: a pair starts at V times the
distance of two zero counts, and only the inverted index (term to the groups that have it) corrects it:

* a term that one group of a pair has corrects the pair as if the other lacked it.  These corrections
  depend on the other group by its share of a zero count alone, so a running sum over a group's shares,
  ordered, tells them for all other groups at once;
* a term that both have emits what is still missing, if that is not zero.  Terms meet by a join of the
  postings with themselves; sums are made before rows are moved.

Terms are counted in Arrow batches, one row for each term, group and batch; all else is native.

Defined results: null text, lang and source are empty strings; a group without terms has share p of a
zero count for every term; a language without terms has V = 0 and distances 0; a group whose language
has no other source has no pair row.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, dealt, discard, hint_small, join_spread, scratch, tidy

LEAST_DOCS, ADD, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows in an Arrow batch; its bytes are bounded too.  A batch is what terms are counted in first.
ROWS = 16_384
#: Letters of a term: A-Z become a-z, all of ASCII but letters is a space, bytes beyond ASCII stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of docs(text, lang, source): a row for each term, group and Arrow batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = pa.StructArray.from_arrays([b["lang"], b["source"]], ["lang", "source"])
            of: dict = {}
            group = np.array([of.setdefault((x["lang"], x["source"]), len(of)) for x in groups.to_pylist()], np.int64)
            words = [t.as_py().translate(LETTERS).split() for t in b["text"].cast(pa.binary())]
            sizes = np.array([len(w) for w in words], np.int64)
            coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
            del words
            k = max(1, len(coded.dictionary))
            cells, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * k + coded.indices.to_numpy(), return_counts=True)
            order = np.argsort(cell := group[cells // k] * k + cells % k, kind="stable")
            cell, n = cell[order], n[order]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            cell, held = cell[first], np.diff(np.r_[first, len(n)])
            names = list(of)
            at = pa.array(cell // k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in names], pa.string()).take(at), pa.array([x for _, x in names], pa.string()).take(at), coded.dictionary.cast(pa.string()).take(pa.array(cell % k)), pa.array(total, pa.int64()), pa.array(held, pa.int64())],
                ["lang", "source", "term", "count", "docs"],
            )
        tidy()

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, count long, docs long")


def share(count: Column, n: Column, v: Column, add: int = ADD, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + add) / (n + add * v)) without loss; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = wide(F.lit(scale)) * wide(count + F.lit(add)), wide(n + F.lit(add) * v)
    return F.when(v > 0, F.call_function("div", above, below) + 1)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, add: int = ADD, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others of its language, and its terms.

    ``pair`` rows hold every other source by distance, ``term`` rows the ``top`` terms that the group
    uses more than its language does, by the difference of the shares.
    """
    spark = docs.sparkSession
    told = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    with batches_of(spark, ROWS):
        postings = scratch(term_counts(told).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "postings")
    kept = scratch(postings.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("count").alias("whole")).where(F.col("d") >= least_docs).drop("d"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("n_lang"))
    index = scratch(join_spread(postings.drop("docs"), kept, ["lang", "term"], F.col("source"), kept.count()), "kept-postings")
    discard(postings)
    sizes = index.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    facts = told.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "n_lang"])
    facts = scratch(facts.withColumn("z", share(F.lit(0).cast("long"), F.col("n"), F.col("v"), add, scale)), "groups")
    few = facts.count()
    shares = scratch(
        index.join(hint_small(facts, few), ["lang", "source"]).select(
            "lang", "source", "term", "z", share(F.col("count"), F.col("n"), F.col("v"), add, scale).alias("p"), share(F.col("whole"), F.col("n_lang"), F.col("v"), add, scale).alias("q")
        ),
        "shares",
    )
    discard(index, kept)
    return pair_rows(facts, shares, few).unionByName(term_rows(shares, top))


def pair_rows(facts: DataFrame, shares: DataFrame, few: int) -> DataFrame:
    """The distance of each group of facts(lang, source, v, z) to every other one of its language."""
    a, b = (facts.select("lang", F.col("source").alias(f"s_{x}"), F.col("z").alias(f"z_{x}"), "v") for x in "ab")
    apart = F.abs(F.col("z_a") - F.col("z_b"))
    pairs = a.join(hint_small(b.drop("v"), few), "lang").where(F.col("s_a") != F.col("s_b"))
    base = pairs.select("lang", "s_a", "s_b", F.coalesce(F.col("v") * apart, F.lit(0)).alias("value"))

    # as if the other group had none of the terms: a running sum over the shares, with the others' zero shares between them
    steps = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).select("lang", F.col("source").alias("s_a"), F.col("p").alias("x"), "m", F.lit(None).cast("string").alias("s_b"), F.lit(None).cast("long").alias("z_a"))
    probes = pairs.where(F.col("v") > 0).select("lang", "s_a", F.col("z_b").alias("x"), F.lit(0).cast("long").alias("m"), "s_b", "z_a")
    whole = Window.partitionBy("lang", "s_a")
    upto = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m, s = F.col("m"), F.col("m") * F.col("x")
    swept = steps.unionByName(probes).select("lang", "s_a", "s_b", "x", "z_a", F.sum(m).over(upto).alias("m_le"), F.sum(s).over(upto).alias("s_le"), F.sum(m).over(whole).alias("m_all"), F.sum(s).over(whole).alias("s_all"))
    far = F.col("s_all") - 2 * F.col("s_le") + F.col("x") * (2 * F.col("m_le") - F.col("m_all")) - F.col("m_all") * F.abs(F.col("z_a") - F.col("x"))
    alone = swept.where(F.col("s_b").isNotNull()).select("lang", "s_a", "s_b", far.alias("value"))

    # what is still missing where both have a term
    left, right = (shares.select("lang", "term", F.col("source").alias(f"s_{x}"), F.col("p").alias(f"p_{x}"), F.col("z").alias(f"z_{x}")) for x in "ab")
    more = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("z_b")) - F.abs(F.col("z_a") - F.col("p_b")) + apart
    both = left.join(dealt(right), ["lang", "term"]).where(F.col("s_a") < F.col("s_b")).select("lang", "s_a", "s_b", more.alias("value")).where(F.col("value") != 0)
    both = both.groupBy("lang", "s_a", "s_b").agg(F.sum("value").alias("value"))

    turned = lambda df: df.select("lang", F.col("s_b").alias("s_a"), F.col("s_a").alias("s_b"), "value")
    total = base.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both)).groupBy("lang", "s_a", "s_b").agg(F.sum("value").alias("value"))
    return ranked(total.select("lang", F.col("s_a").alias("source"), F.lit("pair").alias("part"), F.col("s_b").alias("item"), "value"))


def term_rows(shares: DataFrame, top: int) -> DataFrame:
    """The terms that a group has and uses more than its language, the ``top`` largest differences."""
    more = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(more).where(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
