"""Mixing sources to target weights with soft membership.

A classifier trained on a labelled table gives every document posteriors over the domains.  The rates
of the documents, nonnegative (or at least ``least``), are fitted by least squares, so that the
expected tokens of each domain, the sum of rate x tokens x posterior, match the targets; of the many
rates that do, a very small ridge takes those nearest to 1.  Such rates are one projected gradient
step from 1, max(least, 1 + a . m), along multipliers m, one for each domain; Newton's method finds
m.  A pass needs only sums over all documents, one small row, so the documents stay where they are
and each has its rate from m alone.

Targets of domains that were not learned are left out; if no wanted tokens are left, every rate is ``least``.
Targets default to the domains' own shares raised to ``ALPHA`` (smoothing), the total to the corpus's
own tokens; a target of 0 is a target.  With ``least`` 1, as in the pipeline, no document is lost: the
total is then the least at which no domain has to shrink.  A document with rate r is taken floor(r)
times and once more with the rest as its probability, by a hash of its id.

Defined results: a null or empty text has no tokens and rate 1; with no labelled rows there is one
domain and every rate is 1; equal rows get equal rates; a null doc_id hashes like any value.  Targets
that no rates meet are met as nearly as least squares can; a fit that has not settled gives its last rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, scratch, small_batches, tidy
from .langid import sample_features
from .ngrams import fit_softmax, softmax, trigram_counts, unit

#: Documented bound of the labelled sample that the classifier learns from.
SAMPLE_ROWS = 4000
ALPHA = 0.7
#: Passes of the start at most (ten to forty are needed), and projected gradient steps after it.
ROUNDS, STEPS = 500, 20
#: Of each domain's own wanted tokens, to stop.
TOLERANCE = 1e-6
#: Of the ridge, in the largest eigenvalue of the Gram matrix.
RIDGE = 1e-8
_SCALE = 30.0


def fit_domains(labelled: DataFrame, rows_bound: int = SAMPLE_ROWS):
    """(domains, weights, bias) from labelled(doc_id, text, domain), or None."""
    labels, x = sample_features(labelled.where(F.col("text").isNotNull() & F.col("domain").isNotNull()), "domain", rows_bound, "mixing")
    if not labels:
        return None
    domains = sorted(set(labels))
    number = {k: i for i, k in enumerate(domains)}
    x *= np.float32(_SCALE)
    w, b = fit_softmax(x, np.array([number[k] for k in labels]), len(domains), 1e-5)
    return domains, np.ascontiguousarray(w.T * _SCALE), b


def membership(docs: DataFrame, model, fitted: tuple | None = None) -> DataFrame:
    """docs with ``__mix``: struct(tokens, p array<double>, rate) of each whole text.

    ``fitted`` is what fit_rates returns; without it rates are 1.  One function gives all of it, as
    each further one in a stage takes another Python worker for each task.
    """
    small_batches(docs.sparkSession)
    k = len(model[0]) if model else 1

    @F.arrow_udf("struct<tokens:bigint,p:array<double>,rate:double>")
    def posteriors(texts: pa.Array) -> pa.Array:
        tidy()
        known = [t.as_py() or "" for t in texts]
        tokens = [len(t.encode("utf-8", "replace").split()) for t in known]
        if model:
            bits = model[1].shape[1].bit_length() - 1
            z = np.array([unit(trigram_counts(t, bits)) @ model[1].T for t in known]).reshape(len(known), k) + model[2]
            p = softmax(z)
        else:
            p = np.ones((len(known), 1))
        rate = np.ones(len(known))
        if fitted is not None:
            m, least, whole = fitted[:3]
            rate = rates(p * np.array(tokens, float)[:, None] / whole, m, least)
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rate, pa.float64())], ["tokens", "p", "rate"])

    return docs.withColumn("__mix", posteriors.asNondeterministic()(F.col("text")))


def rates(a: np.ndarray, m: np.ndarray | None, least: float) -> np.ndarray:
    """The rates of rows a: where they begin, and each projected gradient step after it.

    m has a row for the start and for each step: one number for each domain, and the pull towards 1.
    None: nothing is wanted, so that every rate is the least.
    """
    if m is None:
        return np.full(len(a), float(least))
    m = np.atleast_2d(m)
    k = a.shape[1]
    r = np.maximum(least, 1.0 + a @ m[0, :k])
    for row in m[1:]:
        r = np.maximum(least, r - a @ row[:k] - row[k] * (r - 1.0))
    return r


def gradient_sums(rows: DataFrame, m: np.ndarray, whole: float, least: float, k: int) -> np.ndarray:
    """The tokens of each domain that the rates of rows(tokens, p) give, in units of ``whole``."""
    small_batches(rows.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k)
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            a = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) * t[:, None] / whole
            out += a.T @ rates(a, m, least)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(out)], ["i", "x"])

    found = dict(rows.select("tokens", "p").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x")).collect())
    return np.array([found.get(i, 0.0) for i in range(k)])


def newton_sums(rows: DataFrame, m: np.ndarray, whole: float, least: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the rates r of rows(tokens, p): the sum of what the multipliers minimise, of a r, and of a a' where r > least.

    What they minimise has r as its slope: z + z^2 / 2 at z = a . m, and a straight line below least - 1.
    """
    k = len(m)
    small_batches(rows.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 + k + k * k)
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            a = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) * t[:, None] / whole
            z = a @ m
            on = z > least - 1
            value = np.where(on, z + z * z / 2, least * z - (least - 1) ** 2 / 2)
            out += np.concatenate([[value.sum()], a.T @ np.where(on, 1 + z, least), (a[on].T @ a[on]).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], ["i", "x"])

    found = dict(rows.select("tokens", "p").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x")).collect())
    x = np.array([found.get(i, 0.0) for i in range(1 + k + k * k)])
    return float(x[0]), x[1 : 1 + k], x[1 + k :].reshape(k, k)


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float] | None = None, alpha: float = ALPHA, least: float = 0.0, total: float | None = None):
    """(multipliers, least, unit, wanted shares, tokens) of rows(tokens, p), a narrow table that can be read again.

    The first three define the rates.  ``total`` is the wanted number of tokens.
    """
    k = len(domains)
    _, now, q = newton_sums(rows, np.zeros(k), 1.0, 0.0)
    whole = now.sum()
    if whole <= 0:
        return np.zeros(k), 0.0, 1.0, np.ones(k) / k, now
    q /= whole**2
    share = now / whole
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains]) if targets else np.where(share > 0, share**alpha, 0.0)
    if want.sum() <= 0:
        return None, least, whole, want, now
    want = want / want.sum()
    if total is None:
        total = whole * (max(1.0, least * (share[want > 0] / want[want > 0]).max()) if least else 1.0)
    goal = total * want / whole  # tokens of each domain, in units of the corpus
    top = max(np.linalg.eigvalsh(q)[-1], 1e-300)
    ridge = RIDGE * top * np.eye(k)
    # No smaller than what sums of doubles can tell.
    small = np.maximum(TOLERANCE * np.where(want > 0, goal, goal.sum()), 1e-13 * goal.sum())

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, sums, curve = newton_sums(rows, m, whole, least)
        return value + m @ ridge @ m / 2 - goal @ m, sums + ridge @ m - goal, curve + ridge

    m = np.linalg.solve(q + ridge, goal - share)
    value, g, curve = at(m)
    passes = 1
    while (np.abs(g) > small).any() and passes < ROUNDS:
        d, part = -np.linalg.solve(curve, g), 1.0
        while True:
            passes += 1
            next_value, next_g, next_curve = at(m + part * d)
            # Near the end the value is too flat to tell; a smaller residual will do.
            if next_value <= value + 1e-4 * part * (g @ d) or np.abs(next_g / small).max() < np.abs(g / small).max() / 2 or passes >= ROUNDS:
                break
            part /= 2
        m, value, g, curve = m + part * d, next_value, next_g, next_curve

    step = 1.0 / (top + RIDGE * top)
    path = np.zeros((1, k + 1))
    path[0, :k] = m
    sums = gradient_sums(rows, path, whole, least, k)
    for _ in range(STEPS):
        path = np.vstack([path, [*(step * (sums - goal)), step * RIDGE * top]])
        before, sums = sums, gradient_sums(rows, path, whole, least, k)
        if (np.abs(sums - before) <= small).all():
            break
    return path, least, whole, want, now


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, alpha: float = ALPHA, least: float = 0.0) -> tuple[DataFrame, list[str]]:
    """docs with ``__mix`` (tokens, p, rate), and the domains' names; a column of that name is replaced."""
    model = fit_domains(labelled)
    domains = model[0] if model else ["all"]
    narrow = scratch(membership(docs.select("text"), model).select("__mix.tokens", "__mix.p"), "membership")
    return membership(docs, model, fit_rates(narrow, domains, targets, alpha, least)), domains


def copies(rate: Column, doc_id: Column) -> Column:
    """How often a document of this rate is taken: the whole part, and once more by a hash of its id."""
    return (F.floor(rate) + F.when(hash_unit(doc_id, F.lit("copies")) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs, each repeated as its rate of at least 1 says; none is lost."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("__row"))
    rated, _ = mix(whole, labelled, least=1.0)
    times = F.array_repeat(F.lit(0), copies(F.col("__mix.rate"), F.col("doc_id")))
    return rated.select("__row", F.explode(times)).select("__row.*")
