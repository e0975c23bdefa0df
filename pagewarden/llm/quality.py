"""Quality classifier with hierarchical empirical Bayes.

A document classifier (logistic regressions over byte and repetition statistics for quality, over a
learned word list for toxicity) gives each document's evidence.  Grouped aggregation of that
evidence gives posteriors of each host and of each path below it: a sparse path is shrunk toward its
host, a sparse host toward the corpus, by a strength that is fitted from the spread between sites.
A document's odds are its likelihood ratio times the prior odds of its path without itself.

Defined results: a null text is an empty text; a null host or path is a site of its own; with no
labelled rows every posterior is 0.5 and everything is kept; repeated rows each keep a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, hint_small, join_spread, scratch, small_batches, tidy
from .ngrams import fit_logistic

#: Documented bounds of what the document classifier learns from: labelled rows, words of the list.
SAMPLE_ROWS = 6000
LIST_WORDS = 500
#: A word is listed from so many texts on, or this share of the sample's, and from these scores on.
LEAST_DOCS, LEAST_SHARE, LEAST_Z, LEAST_ODDS = 5, 0.002, 6.0, 3.5
KEEP_QUALITY, KEEP_TOXIC = 0.5, 0.5
_EDGE = ".,;:!?\"'()[]%*#$&|"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def terms_of(words: list[str]) -> set[str]:
    """Distinct words without marks at their edges, and the first five letters of longer ones with a star."""
    bare = {y.strip(_EDGE) for y in set(words)}
    return bare | {x[:5] + "*" for x in bare if len(x) > 5}


def style(text: str | None) -> np.ndarray:
    """Square roots of the byte frequencies of the whole text, and six statistics of its words."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(262)
    if raw:
        out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    w = raw.lower().split()
    n = len(w)
    if n:
        kinds = len(set(w))
        same = sum(map(bytes.__eq__, w, w[1:]))
        out[256:] = [kinds / n, same / n, min(n, 1000) / 1000, math.log1p(n) / 10, len(raw) / n / 20, kinds / math.sqrt(n) / 30]
    return out


class Model:
    """Weights of both heads; a head without both classes in its labels is None."""

    def __init__(self, quality, toxic, lexicon: dict[str, float], base: tuple[float, float]):
        self.quality, self.toxic, self.lexicon, self.base = quality, toxic, lexicon, base

    def hits(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        found = [self.lexicon[x] for x in terms_of(w) if x in self.lexicon]
        return np.array([bool(found), math.log1p(sum(found)), max(found, default=0.0) / 5, sum(found) / math.sqrt(len(w) + 1)])

    def evidence(self, text: str | None) -> tuple[float, float]:
        q = _sigmoid(style(text) @ self.quality[0] + self.quality[1]) if self.quality else 0.5
        t = _sigmoid(self.hits(text) @ self.toxic[0] + self.toxic[1]) if self.toxic else self.base[1]
        return q, t


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _head(x: np.ndarray, y: np.ndarray, scale: float):
    if len(y) == 0 or y.min() == y.max():
        return None
    w, b = fit_logistic(x * scale, y[:, None].astype(float), np.ones((len(y), 1)), 1e-5, 400)
    return w[:, 0] * scale, float(b[0])


def fit(docs: DataFrame, labels: DataFrame, rows_bound: int = SAMPLE_ROWS) -> Model:
    """Learn from a sample of the labelled documents, chosen by a hash of doc_id, of at most about rows_bound rows."""
    small_batches(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    n = marks.count()
    if not n:
        return Model(None, None, {}, (0.5, 0.0))
    taken = marks.where(hash_unit(F.col("doc_id"), F.lit("quality")) < min(1.0, rows_bound / n))
    sample = scratch(docs.select("doc_id", "text").join(hint_small(taken, min(n, 2 * rows_bound)), "doc_id"), "labelled")

    # The word list: words that come in more toxic documents than chance would have it.
    bare = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\[\]%*#$&|]+|[.,;:!?\"'()\[\]%*#$&|]+$", ""))
    stems = F.transform(F.filter(bare, lambda w: F.length(w) > 5), lambda w: F.concat(F.substring(w, 1, 5), F.lit("*")))
    word = F.explode(F.array_distinct(F.concat(bare, stems)))
    texts = sample.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("m")).agg(F.first("text").alias("text"), F.max("t").alias("t"))  # copies count once
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    rate = total["t"] / max(1, total["n"])
    seen = texts.select(word.alias("word"), "t").where("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).where(F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * total["n"]))
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(max(rate * (1 - rate), 1e-9)))
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - F.lit(math.log((rate + 1e-9) / (1 - rate + 1e-9)))
    listed = seen.select("word", z.alias("z"), odds.alias("odds")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "word").limit(LIST_WORDS).collect()
    lexicon = {r["word"]: float(r["odds"]) for r in listed}
    shell = Model(None, None, lexicon, (0.5, 0.0))

    @F.arrow_udf("array<double>")
    def describe(texts: pa.Array) -> pa.Array:
        return pa.array([np.concatenate([style(t.as_py()), shell.hits(t.as_py())]).tolist() for t in texts], pa.list_(pa.float64()))

    rows = sample.select("doc_id", "y", "t", describe.asNondeterministic()(F.col("text")).alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    if not rows:
        return Model(None, None, {}, (0.5, 0.0))
    x = np.array([r["x"] for r in rows])
    y, t = np.array([r["y"] for r in rows]), np.array([r["t"] for r in rows])
    return Model(_head(x[:, :262], y, 6.0), _head(x[:, 262:], t, 1.0), lexicon, (float(y.mean()), float(t.mean())))


def evidence_of(model: Model, text: Column) -> Column:
    """struct(q, t): the classifier's probabilities of good and of toxic for a text."""

    @F.arrow_udf("struct<q:double,t:double>")
    def evidence(texts: pa.Array) -> pa.Array:
        pairs = [model.evidence(t.as_py()) for t in texts]
        tidy()
        return pa.StructArray.from_arrays([pa.array([p[i] for p in pairs], pa.float64()) for i in (0, 1)], ["q", "t"])

    return evidence.asNondeterministic()(text)


def _strength(size: Column, mean: Column, prior: Column) -> Column:
    """Beta-binomial strength by moments from sites' sizes and means: prior (1 - prior) / spread - 1, in [1, 10000]."""
    spread = F.sum(size * (mean - prior) * (mean - prior)) / F.sum(size)
    noise = F.sum(prior * (1 - prior)) / F.sum(size)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.coalesce(F.least(F.greatest(F.max(prior * (1 - prior)) / between - 1, F.lit(1.0)), F.lit(1e4)), F.lit(1.0))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, n and, for q and t: sum, host posterior, strength, corpus mean) from evidence(host, path, q, t).

    Only the corpus means and the strengths, one row each, come to the driver.
    """
    paths = scratch(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("s_q"), F.sum("t").alias("s_t")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s_q").alias("h_q"), F.sum("s_t").alias("h_t"))
    w = hosts.agg(F.sum("hn").alias("n"), F.sum("h_q").alias("q"), F.sum("h_t").alias("t")).first()
    world = {x: F.lit(w[x] / w["n"] if w["n"] else 0.5) for x in "qt"}
    k = hosts.agg(*[_strength(F.col("hn"), F.col(f"h_{x}") / F.col("hn"), world[x]).alias(x) for x in "qt"]).first()
    host = hosts.select(F.col("host").alias("_h"), *[((F.col(f"h_{x}") + world[x] * k[x]) / (F.col("hn") + k[x])).alias(f"host_{x}") for x in "qt"])
    both = paths.join(host, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    kp = both.agg(*[_strength(F.col("n"), F.col(f"s_{x}") / F.col("n"), F.col(f"host_{x}")).alias(x) for x in "qt"]).first()
    return scratch(both.withColumns({**{f"kp_{x}": F.lit(kp[x]) for x in "qt"}, **{f"world_{x}": world[x] for x in "qt"}}), "sites")


def combine(p: Column, site: Column, base: Column) -> Column:
    """Posterior: the odds of p, taken at the base rate, times the ratio of the site's odds to the base's."""
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    return 1 / (1 + F.exp(-(logit(p) + logit(site) - logit(base))))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of docs (all by default) with ``__q``, which replaces a column of that name.

    The columns of ``carry`` are written beside the evidence, so that each text is judged once; with
    all of them the texts are judged again instead of written.  ``__q`` is struct(host, path, doc_quality, host_quality, path_quality, quality, doc_toxic, toxic, keep).
    """
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if carry is None else carry) if c != "__q"]
    salt = F.xxhash64("doc_id", F.length("text"))
    judged = docs.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"), salt.alias("salt"), evidence_of(model, F.col("text")).alias("e"))
    judged = judged if carry is None else scratch(judged, "evidence")
    sites = site_posteriors(judged.select("host", "path", "e.q", "e.t"))
    # Hosts and paths may be null, which a join does not match.
    key = lambda c: F.concat(F.lit("="), F.col(c))
    site = F.array(F.coalesce(key("host"), F.lit("")), F.coalesce(key("path"), F.lit(""))).alias("site")
    near = sites.select(site, F.struct(*[c for c in sites.columns if c not in ("host", "path")]).alias("s"))
    rows = join_spread(judged.select("row", "host", "path", "salt", "e", site), near, ["site"], F.col("salt"), sites.count(), "left")
    of = lambda name: F.col(f"s.{name}")
    mean = {x: path_mean(of(f"s_{x}"), F.col("e")[x], of(f"kp_{x}"), of(f"host_{x}"), of("n")) for x in "qt"}
    quality = combine(F.col("e.q"), mean["q"], of("world_q"))
    toxic = combine(F.col("e.t"), mean["t"], of("world_t"))
    # Where nothing was learned for quality there is nothing to reject by.
    keep = (F.lit(not model.quality) | (quality >= KEEP_QUALITY)) & (F.lit(not model.toxic) | (toxic < KEEP_TOXIC))
    out = F.struct("host", "path", F.col("e.q").alias("doc_quality"), of("host_q").alias("host_quality"), mean["q"].alias("path_quality"), quality.alias("quality"), F.col("e.t").alias("doc_toxic"), toxic.alias("toxic"), keep.alias("keep"))
    return rows.select("row.*", out.alias("__q"))


def path_mean(total: Column, own: Column, strength: Column, host: Column, n: Column) -> Column:
    """A path's posterior mean without the document itself, shrunk toward its host."""
    return (total - own + strength * host) / (n - 1 + strength)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; the host is the source, the path the language below it."""
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", "text", "source", "lang")
    return classify(rows, labels, F.col("source"), F.col("lang")).where("__q.keep").select("__row.*")
