"""Language ID by error-correcting output codes.

Each learned language has a codeword; for each bit of the code a logistic regression over hashed
byte trigrams predicts that bit.  Decoding weights each bit's loss by how well its classifier does
on held-back texts of that language and takes the nearest codeword; a small lead over the next one
flags ambiguity.

Defined results: a text that is null or has no letter is ``und`` with score 0; with nothing to learn
from every text is ``und``; with one language every other text has that language.  A null doc_id is
not held out and not learned from.  Repeated rows each keep a row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, small_batches, tidy
from .ngrams import fit_logistic, pack, softmax, trigram_counts, unit, unpack

#: Documented bound of the sample to learn from: rows of all languages together.
SAMPLE_ROWS = 4000
FEATURE_BITS = 12
#: Scores under this are ambiguous.
AMBIGUOUS = 0.6
#: One of so many of the learned texts is held back to weigh the bits.
FOLDS = 5
_SNIPPET = 60


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def code_matrix(k: int) -> np.ndarray:
    """Codewords of k languages as rows of -1 and 1: exhaustive for up to 5, else the best of seeded random codes."""
    if k <= 5:
        n = max(1, 2 ** (k - 1) - 1)
        bits = [[(1 if i == 0 else (c >> (i - 1)) & 1) for c in range(n)] for i in range(k)]
        return np.array(bits) * 2 - 1
    n, best, rng = int(np.ceil(10 * np.log2(k))), None, np.random.default_rng(7)
    for _ in range(200):
        m = rng.choice([-1, 1], (k, n))
        m = m[:, np.abs(m.sum(axis=0)) < k]
        apart = ((m[:, None] != m[None]).sum(axis=2) + np.eye(k) * n).min()
        if best is None or apart > best[0]:
            best = (apart, m)
    return best[1]


class Model:
    """Weights of the bit classifiers, the codewords and the weight of each bit's loss for each language."""

    def __init__(self, langs: list[str], w: np.ndarray, b: np.ndarray, codes: np.ndarray, trust: np.ndarray):
        self.langs, self.w, self.b, self.codes, self.trust = langs, w, b, codes, trust

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Posteriors of the languages from the margins of the bits, a row for each text."""
        loss = np.logaddexp(0, -self.codes[None] * margins[:, None])
        return softmax(-(loss * self.trust[None]).sum(axis=2))

    def posteriors(self, texts: list[str]) -> np.ndarray:
        x = np.empty((len(texts), self.w.shape[0]))
        for i, t in enumerate(texts):
            x[i] = unit(trigram_counts(t, FEATURE_BITS)) @ self.w.T
        return self.decode(x + self.b) if len(texts) else np.empty((0, len(self.langs)))


def sample_features(rows: DataFrame, label: str, rows_bound: int, seed: str = "langid") -> tuple[list[str], np.ndarray]:
    """Labels and unit vectors of a sample of rows(doc_id, text, label) that takes as many of each label, by a hash of doc_id.

    Rare labels are taken whole; the expected number of rows is at most ``rows_bound``.  Each text
    is counted whole, and a snippet of it beside, so that short texts are learned as well.
    """
    small_batches(rows.sparkSession)
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(rows_bound).collect()}
    if not counts:
        return [], np.zeros((0, 1 << FEATURE_BITS), np.float32)
    each = max(1, rows_bound // len(counts))
    rate = F.coalesce(*[F.when(F.col(label) == k, F.lit(min(1.0, each / n))) for k, n in counts.items()])

    @F.arrow_udf("struct<whole:binary,part:binary>")
    def count(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            s = t.as_py() or ""
            mid = max(0, len(s) // 2 - _SNIPPET // 2)
            out.append([pack(trigram_counts(x, FEATURE_BITS)) for x in (s, s[mid : mid + _SNIPPET])])
        return pa.StructArray.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], ["whole", "part"])

    taken = rows.where(hash_unit(F.col("doc_id"), F.lit(seed)) < rate)
    found = taken.select("doc_id", F.col(label).alias("label"), count.asNondeterministic()(F.col("text")).alias("c")).select("doc_id", "label", "c.*").toArrow()
    # The same model whatever the order of partitions; by a hash, so that any part of the rows is a sample.
    order = sorted(zip(*(found.column(i).to_pylist() for i in range(4)), strict=True), key=lambda r: (zlib.crc32(repr(r[0]).encode()), *r))
    del found
    x = np.zeros((2 * len(order), 1 << FEATURE_BITS), np.float32)
    labels = [k for _, k, _, _ in order for _ in (0, 1)]
    for n in range(len(order) - 1, -1, -1):
        _, _, whole, part = order.pop()
        unpack(whole, x[2 * n])
        unpack(part, x[2 * n + 1])
    return labels, x


def train(labels: list[str], x: np.ndarray) -> Model | None:
    """x holds a text's unit vector in each row."""
    if not labels:
        return None
    langs = sorted(set(labels))
    codes = code_matrix(len(langs))
    number = {k: i for i, k in enumerate(langs)}
    y = np.array([number[k] for k in labels])
    share = np.bincount(y, minlength=len(langs))[y][:, None]
    target = (codes[y] > 0).astype(np.float32)

    def learn(n: int) -> tuple[np.ndarray, np.ndarray]:
        return fit_logistic(x[:n], target[:n], np.broadcast_to(1.0 / share[:n], target[:n].shape), 1e-6)

    # How far a bit can be trusted for a language shows in texts that its classifier has not seen: the
    # last fifth is held back for that.  A text has two rows.
    cut = len(y) // 2 * (FOLDS - 1) // FOLDS * 2
    if all((y[:cut] == i).any() and (y[cut:] == i).any() for i in range(len(langs))):
        w, b = learn(cut)
        right = ((x[cut:] @ w.astype(np.float32) + b > 0) == (target[cut:] > 0)).astype(float)
        trust = np.array([bit_trust(right[y[cut:] == i]) for i in range(len(langs))])
    else:
        trust = np.ones(codes.shape)
    w, b = learn(len(y))
    return Model(langs, np.ascontiguousarray(w.T), b, codes, trust / trust.sum(axis=1, keepdims=True) * codes.shape[1])


def bit_trust(right: np.ndarray) -> np.ndarray:
    """Weights of the bits of one language from which of its held-back texts each told right: twice the accuracy over chance."""
    accuracy = (right.sum(axis=0) + 1) / (len(right) + 1.5)
    return np.maximum(2 * accuracy - 1, 1e-3)


def fit(docs: DataFrame, rows_bound: int = SAMPLE_ROWS) -> Model | None:
    """Learn from text and non-null lang of documents whose crc32(doc_id) mod 3 is not 1."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 1)).select("doc_id", "text", "lang")
    return train(*sample_features(rows, "lang", rows_bound))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict_column(model: Model | None, text: Column) -> Column:
    """struct(lang_pred, score, runner_up, ambiguous) of a text column."""

    @F.arrow_udf("struct<lang_pred:string,score:double,runner_up:string,ambiguous:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        known = [t.as_py() for t in texts]
        at = [i for i, t in enumerate(known) if model and has_letter(t)]
        p = model.posteriors([known[i] for i in at]) if at else np.empty((0, 1))
        best, score, second = ["und"] * len(known), [0.0] * len(known), [None] * len(known)
        for i, row in zip(at, p, strict=True):
            order = np.argsort(-row, kind="stable")
            best[i], score[i] = model.langs[order[0]], float(row[order[0]])
            second[i] = model.langs[order[1]] if len(order) > 1 else None
        flags = [s < AMBIGUOUS for s in score]
        tidy()
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(flags, pa.bool_())], ["lang_pred", "score", "runner_up", "ambiguous"])

    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a struct ``_lang`` (lang_pred, score, runner_up, ambiguous), which replaces a column of that name."""
    small_batches(docs.sparkSession)
    return docs.withColumn("_lang", predict_column(model, F.col("text")))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language cannot be told: texts with no letters, and ambiguous ones."""
    told = identify(docs.select(F.struct("*").alias("__row"), "text"), fit(docs))
    return told.where((F.col("_lang.lang_pred") != "und") & ~F.col("_lang.ambiguous")).select("__row.*")
