"""Language ID, quality, mixing and nearest neighbours."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import ann, langid, mixing, ogg, quality, simhash
from pagewarden.llm.queries import labelled_domains, op8_language_id, op10_soft_mixing

SF = "/root/testdata/sf0.01"
LETTERS = {"xa": "aeioustrn", "xb": "bcdfghklm", "xc": "pqwzyvjua", "xd": "éèàùçêôîn", "xe": "ñóíáúaerl", "xf": "кдмотвас"}


def text(lang, n, rng):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 8))) for _ in range(n))


def test_codes_are_apart():
    for k in (2, 3, 4, 5, 6, 9):
        m = langid.code_matrix(k)
        assert len({tuple(r) for r in m}) == k
        if k > 2:
            assert ((m[:, None] != m[None]).sum(axis=2) + np.eye(k) * 99).min() >= 2


def test_held_out_languages(spark, docs_schema):
    rng = random.Random(1)
    rows = [(i, text(lang, rng.choice([5, 40, 200]), rng), lang, "s", 0) for i in range(900) for lang in [rng.choice(list(LETTERS))]]
    rows += [(-1, None, "xa", "s", 0), (-2, "", "xa", "s", 0), (-3, "123 %% !", "xb", "s", 0), (None, text("xb", 9, rng), "xb", "s", 0), (-4, text("xc", 60000, rng), None, "s", 0), (0, rows[0][1], rows[0][2], "s", 0)]
    df = spark.createDataFrame(rows, docs_schema)
    out = [(r.doc_id, r.lang, r._lang) for r in langid.identify(df, langid.fit(df)).collect()]
    assert len(out) == len(rows)
    held = [(lang, p.lang_pred) for i, lang, p in out if i is not None and i > 0 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.98
    by = {i: p for i, _, p in out}
    assert [by[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and by[-1].score == 0.0
    assert by[-4].lang_pred == "xc" and all(0 <= p.score <= 1 for _, _, p in out)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {-1, -2, -3}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), langid.fit(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r._lang.lang_pred for r in nothing.collect()} == {"und"}
    one = df.where("lang = 'xa'")
    assert {r._lang.lang_pred for r in langid.identify(one, langid.fit(one)).collect()} <= {"xa", "und"}
    assert langid.keep_identified(df.limit(0)).count() == 0


def test_ambiguous_texts_are_rejected(spark, docs_schema):
    rng = random.Random(3)
    rows = [(i, text(lang, 60, rng), lang, "s", 0) for i in range(300) for lang in [rng.choice(["xa", "xb"])]]
    rows += [(1000 + i, text("xa", n, rng) + " " + text("xb", 60 - n, rng), None, "s", 0) for i, n in enumerate(range(10, 50))]
    df = spark.createDataFrame(rows, docs_schema)
    told = {r.doc_id: r._lang for r in langid.identify(df, langid.fit(df)).collect()}
    unsure = {i for i, p in told.items() if p.score < langid.AMBIGUOUS}
    assert unsure and min(p.score for p in told.values()) >= 0.5  # two languages: never 0.3
    assert {r.doc_id for r in langid.keep_identified(df).collect()} == set(told) - unsure


def test_the_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = op8_language_id(spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[0] >= 0.97 and r[1] > 300


def test_quality_separates_the_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    out = quality.classify(docs, half, F.col("source"), F.col("lang"))
    rest = out.join(labels.join(half, "doc_id", "left_anti").withColumnRenamed("quality", "y"), "doc_id").select("y", "toxic", "__q").collect()
    assert np.mean([(r["__q"].quality >= 0.5) == (r.y == 1) for r in rest]) > 0.95
    clean = [r["__q"].keep for r in rest if r.y == 1 and r.toxic == 0]
    assert np.mean(clean) > 0.97
    assert out.count() == docs.count()


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 0.9, 0.0)] * 500 + [("big", "b", 0.1, 0.0)] * 300 + [("low", "c", 0.2, 0.0)] * 400 + [("one", "d", 0.0, 0.0), (None, None, 1.0, 0.0)]
    sites = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, q double, t double")).collect()}
    world = sites[("big", "a")].world_q
    assert abs(sites[("low", "c")].host_q - 0.2) < 0.02  # many documents: its own mean
    assert 0.0 < sites[("one", "d")].host_q <= world and sites[(None, None)].host_q < 1.0  # one document: toward the corpus


def test_posteriors_against_hand_computation(spark, docs_schema):
    """The whole hierarchy by plain loops, from the document classifier's own evidence."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0").withColumns({"__q": F.lit("clash"), "row": F.lit("clash"), "host": F.lit("clash"), "site": F.lit("clash")})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels, F.when(F.col("source") != "web", F.col("source")), F.col("lang")).collect()
    assert rng and set(out[0].asDict()) == set(docs.columns) and out[0].host == "clash"
    rows = [r["__q"] for r in out]
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for x, doc, post in (("q", "doc_quality", "quality"), ("t", "doc_toxic", "toxic")):
        sums = lambda key: {k: (len(v), sum(v)) for k, v in by(key).items()}

        def by(key):
            found = {}
            for r in rows:
                found.setdefault(key(r), []).append(r[doc])
            return found

        hosts, paths = sums(lambda r: r.host), sums(lambda r: (r.host, r.path))
        n = len(rows)
        world = sum(r[doc] for r in rows) / n

        def strength(groups, prior):
            spread = sum(m * (s / m - prior(k)) ** 2 for k, (m, s) in groups.items()) / n
            noise = sum(prior(k) * (1 - prior(k)) for k in groups) / n
            return min(max(max(prior(k) * (1 - prior(k)) for k in groups) / max(spread - noise, 1e-9) - 1, 1.0), 1e4)

        kh = strength(hosts, lambda k: world)
        host = {k: (s + kh * world) / (m + kh) for k, (m, s) in hosts.items()}
        kp = strength(paths, lambda k: host[k[0]])
        for r in rows:
            m, s = paths[r.host, r.path]
            site = (s - r[doc] + kp * host[r.host]) / (m - 1 + kp)
            want = 1 / (1 + math.exp(-(logit(r[doc]) + logit(site) - logit(world))))
            assert abs(r[post] - want) < 1e-6, x
    assert all(r.keep == (r.quality >= 0.5 and r.toxic < 0.5) for r in rows)


def test_decoding_is_the_nearest_codeword():
    rng = np.random.default_rng(12)
    for k in (2, 4, 7):
        codes = langid.code_matrix(k)
        trust = rng.random(codes.shape) + 0.1
        model = langid.Model([f"l{i}" for i in range(k)], np.zeros((codes.shape[1], 4)), np.zeros(codes.shape[1]), codes, trust)
        margins = rng.standard_normal((50, codes.shape[1])) * 3
        for m, p in zip(margins, model.decode(margins), strict=True):
            loss = [sum(trust[i, j] * math.log(1 + math.exp(-codes[i, j] * m[j])) for j in range(codes.shape[1])) for i in range(k)]
            assert int(p.argmax()) == int(np.argmin(loss)) and abs(p.sum() - 1) < 1e-9
    right = np.array([[1, 1, 0]] * 30 + [[1, 0, 0]] * 10)
    a, b, c = langid.bit_trust(right)
    assert a > b > c > 0  # a bit that misleads for a language counts least


def test_clashing_columns(spark):
    rows = [(1, "the cat sat", "en", "s", 0), (2, "le chat noir", "fr", "s", 0), (3, None, None, None, None)]
    clash = ["_lang", "__row", "__mix", "__q", "media", "n_bytes", "payload_bytes", "feature", "row", "e", "read", "fp", "v"]
    df = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (langid.keep_identified(df), quality.keep_good(df, labels), simhash.keep_one_of_each(df), mixing.mixed(df, labelled_domains(df, labels))):
        assert out.columns == df.columns and all(r["__row"] == "__row" for r in out.collect())
    coded = ogg.decode_media(ogg.encode_media(df))
    assert len(set(coded.columns)) == len(coded.columns) and {r.payload_bytes for r in coded.collect()} == {64}


def test_quality_of_odd_rows(spark, docs_schema):
    df = spark.createDataFrame([(1, None, None, None, 0), (None, "", "en", "s", 0), (2, "x " * 90000, "en", "s", 0), (2, "x", "en", "s", 0)], docs_schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in quality.keep_good(df, none).collect()) == ["1", "2", "2", "None"]
    some = spark.createDataFrame([(1, 0, 0), (2, 1, None), (77, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(df, some, F.col("source"), F.col("lang")).count() == 4
    assert quality.keep_good(df.limit(0), some).count() == 0


def fitted(spark, p, t, domains, targets=None, **more):
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>")
    m, least, whole, want, now = mixing.fit_rates(rows, domains, targets, **more)
    a = p * np.array(t)[:, None] / whole
    r = mixing.rates(a, m, least)
    assert (r >= least).all()
    return a, r, a.T @ r, want


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(0)
    soft, t = rng.dirichlet([0.3, 0.3, 0.3], 4000), rng.integers(1, 500, 4000)
    two = np.array([[0.9, 0.1], [0.1, 0.9]])[rng.integers(0, 2, 4000)]
    for p, targets in ((soft, {"a": 0.6, "b": 0.3, "c": 0.1}), (soft, {"a": 0.6, "b": 0.4}), (two, {"a": 0.85, "b": 0.15})):
        _, _, got, want = fitted(spark, p, t, list("abc")[: p.shape[1]], targets)
        assert np.abs(got - want).max() < 2e-4  # the corpus's own tokens in all


def test_rates_are_those_of_plain_projected_gradient(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(1, 500, 600)
    two = np.array([[0.9, 0.1], [0.1, 0.9]])[rng.integers(0, 2, 600)]
    soft = rng.dirichlet([0.3, 0.3, 0.3], 600)
    # Also targets that no rates meet.
    for p, targets, least in ((soft, {"a": 0.6, "b": 0.3, "c": 0.1}, 0.0), (two, {"a": 1.0, "b": 0.0}, 0.0), (two, {"a": 0.95, "b": 0.05}, 0.5)):
        a, r, got, want = fitted(spark, p, t, list("abc")[: p.shape[1]], targets, least=least, total=float(t.sum()))
        slow, step = np.ones(len(t)), 1.0 / np.linalg.eigvalsh(a.T @ a)[-1]
        for _ in range(20000):
            slow = np.maximum(least, slow - step * (a @ (a.T @ slow - want)))
        assert np.abs(a.T @ slow - got).max() < 1e-4, targets


def test_rates_meet_rare_targets(spark):
    for shares in ([0.985, 0.013, 0.002], [0.892, 0.1046, 0.0017, 0.0017]):
        for least in (0.0, 1.0):
            rng = np.random.default_rng(1)
            k, n = len(shares), 8000
            y = rng.choice(k, n, p=shares)
            z = np.exp(rng.standard_normal((n, k)) + 12 * np.eye(k)[y])
            _, _, got, want = fitted(spark, z / z.sum(axis=1, keepdims=True), rng.integers(1, 500, n), list("abcd")[:k], least=least)
            assert np.abs(got / got.sum() / want - 1).max() < 1e-3  # of each domain's own target


def test_targets_that_want_nothing(spark):
    rng = np.random.default_rng(4)
    p, t = rng.dirichlet([0.5, 0.5], 50), rng.integers(1, 9, 50)
    for targets in ({"a": 0.0, "b": 0.0}, {"none": 1.0}, {"a": -1.0}):
        for least in (0.0, 0.5):
            _, r, _, _ = fitted(spark, np.vstack([p, [[1.0, 0.0]]]), [*t, 0], ["a", "b"], targets, least=least)
            assert (r == least).all()
    _, _, got, want = fitted(spark, p, t, ["a", "b"], {"a": 0.5, "b": 0.5, "none": 9.0})
    assert np.allclose(want, 0.5) and np.abs(got - want).max() < 1e-4


def test_steps_alone_go_down_and_end(spark, monkeypatch):
    """Without the start, projected gradient steps are those of plain loops; a fit that has not settled gives its last rates."""
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 500, 300)
    lost = []
    for steps in (0, 5, 30):
        monkeypatch.setattr(mixing, "STEPS", steps)
        rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>")
        m, least, whole, want, _ = mixing.fit_rates(rows, list("abc"), {"a": 0.9, "b": 0.05, "c": 0.05}, least=0.3)
        a = p * t[:, None] / whole
        r = np.maximum(least, 1 + a @ m[0, :3])
        goal = want * (r.size and (np.maximum(1.0, 0.3 * (a.sum(axis=0) / want).max())))
        q = np.linalg.eigvalsh(a.T @ a)[-1]
        for _ in range(len(m) - 1):
            r = np.maximum(least, r - (a @ (a.T @ r - goal) + mixing.RIDGE * q * (r - 1)) / (q * (1 + mixing.RIDGE)))
        assert np.allclose(r, mixing.rates(a, m, least), atol=1e-9)
        lost.append(((a.T @ r - goal) ** 2).sum())
    assert lost[0] > lost[1] > lost[2]


def test_mixing_keeps_every_document(spark, docs_schema):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = mixing.mixed(docs, labelled_domains(docs, labels))
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert len(times) == docs.count() and max(times.values()) > 1
    q = op10_soft_mixing(spark, SF).agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{k}")).alias(k) for k in ("de", "en", "es", "fr")], *[F.sum(F.col("tokens") * F.col(f"p_{k}")).alias(f"n_{k}") for k in ("de", "en", "es", "fr")]).first()
    now = np.array([q[f"n_{k}"] for k in ("de", "en", "es", "fr")])
    got = np.array([q[k] for k in ("de", "en", "es", "fr")])
    want = (now / now.sum()) ** mixing.ALPHA
    assert np.abs(got / got.sum() - want / want.sum()).max() < 0.01
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, "s", 0), (2, "a b", "en", "s", 0)], docs_schema)
    empty = spark.createDataFrame([], "doc_id long, text string, domain string")
    assert mixing.mixed(odd, empty).count() == 3
    assert mixing.mixed(odd.limit(0), empty).count() == 0


def test_the_language_query_against_plain_loops(spark):
    """Every document's prediction again, trigram by trigram and bit by bit, with the weights that were learned."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    bits = model.w.shape[1].bit_length() - 1
    want = {}
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").lower().encode()
        kept = [32, *(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in raw), 32]
        counts = {}
        for a, b, c in zip(kept, kept[1:], kept[2:]):
            if (a, b, c) != (32, 32, 32):
                h = (a * 65599 * 65599 + b * 65599 + c) * 2654435761 % 2**32 >> (32 - bits)
                counts[h] = counts.get(h, 0) + 1
        space = (32 * 65599 * 65599 + 32 * 65599 + 32) * 2654435761 % 2**32 >> (32 - bits)
        counts.pop(space, None)
        n = sum(counts.values())
        margins = [bias + sum(math.sqrt(k / n) * w[h] for h, k in counts.items()) for w, bias in zip(model.w, model.b, strict=True)]
        loss = [sum(t * math.log1p(math.exp(-c * m)) for c, m, t in zip(code, margins, trust, strict=True)) for code, trust in zip(model.codes.tolist(), model.trust.tolist(), strict=True)]
        low = min(loss)
        p = [math.exp(low - x) for x in loss]
        best = min(range(len(p)), key=lambda i: (loss[i], i))
        letters = any(map(str.isalpha, r.text or ""))
        want[r.doc_id] = (model.langs[best], p[best] / sum(p)) if letters else ("und", 0.0)
    got = {r.doc_id: r for r in op8_language_id(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (lang, score) in want.items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-6 and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, 16))).round(4)
    x[100:900] = x[100]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0]), (5, x[5].tolist()), (5005, [])]
    vectors = ann.valid_vectors(spark.createDataFrame(rows, "id long, v array<double>").repartition(6), "id", "v")
    assert vectors.count() == 3000
    out = ann.search(vectors, vectors.where("id % 20 = 0"), trees=6, leaf=128, least=900, share=0.0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    recall = []
    for q in range(0, 3000, 20):
        s = np.array([sum(a * b for a, b in zip(x[q], v, strict=True)) for v in x])
        best = [int(j) for j in np.lexsort((np.arange(3000), -s)) if j != q][:20]
        assert len(got[q]) == 20 and all(score == s[i] for i, score in got[q])
        assert [p for p in sorted(got[q], key=lambda p: (-p[1], p[0]))] == got[q]
        recall.append(len({i for i, _ in got[q]} & set(best)) / 20)
    assert np.mean(recall) >= 0.9, np.mean(recall)
    few = vectors.where("id < 4")
    assert [r.rank for r in ann.search(few, few.where("id = 0")).orderBy("rank").collect()] == [1, 2, 3]
    assert ann.search(vectors.where("id < 0"), vectors).count() == 0


@pytest.mark.parametrize("n, spread", [(500, None), (2000, None), (12000, None), (2000, 0.3), (12000, 0.3)])
def test_recall_and_work_at_the_querys_own_parameters(n, spread):
    """Vectors without structure, and around centres: the leaves of a query hold 0.9 of its nearest, and are not all leaves."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64)) if spread is None else rng.standard_normal((40, 64))[rng.integers(0, 40, n)] + spread * rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.fit_forest(x[:12000], n, 1.0, leaf=ann.leaf_size(n))
    share, leaves = ann.tuned_share(forest, x, n), forest.leaves(x)
    found, seen, opened = [], [], []
    for i in range(n - 50, n):  # none of the queries that the share was set by
        s = x @ x[i]
        s[i] = -9
        order = forest.search(x[i], share * n)
        here = np.zeros(n, bool)
        for t, node in order:
            here |= leaves[:, t] == node
        found.append(here[np.argsort(-s)[:20]].mean())
        seen.append(here.mean())
        opened.append(len(order) / (len(forest.planes) << forest.depth))
    assert np.mean(found) >= 0.9 and np.mean(opened) < 0.3 and np.mean(seen) < (0.9 if spread is None else 0.35), (np.mean(found), np.mean(seen), np.mean(opened))


def test_ties_in_a_leaf_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8))
    for m in (1, 5, 21, 700, 900):
        q, c, score = ann.best_of(x.round(0), x[:9].round(0), m)
        want = []
        for i in range(9):
            s = ann.dots(x.round(0), x[i].round(0))
            want += [(i, int(j), s[j]) for j in np.lexsort((np.arange(700), -s))[:m]]
        assert list(zip(q.tolist(), c.tolist(), score.tolist(), strict=True)) == want
    # Five candidates score 2, all others 1; copies of a vector are one class.
    rows = [(i, [1.0, 0.0, float(i)]) for i in range(1, 600)] + [(600 + i, [2.0, 0.0, float(i)]) for i in range(5)]
    vectors = ann.valid_vectors(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v")
    query = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "id long, v array<float>")
    out = ann.search(vectors, query, leaf=64, least=700, share=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(600 + i, 2.0) for i in range(5)] + [(i, 1.0) for i in range(1, 16)]


def test_recall_at_the_querys_own_parameters(spark):
    rng = np.random.default_rng(9)
    n = 12000
    for x in (rng.standard_normal((n, 32)), rng.standard_normal((60, 32))[rng.integers(0, 60, n)] + 0.3 * rng.standard_normal((n, 32))):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
        got = {}
        for r in ann.search(rows, rows.where("id % 400 = 0")).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        recall, y = [], x.astype(np.float64)
        for q in range(0, n, 400):
            s = ann.dots(y, y[q])
            best = [int(j) for j in np.lexsort((np.arange(n), -s)) if j != q][:20]
            assert all(score == s[i] for i, score in got[q].values())
            recall.append(len({i for i, _ in got[q].values()} & set(best)) / 20)
        assert np.mean(recall) >= 0.9


def test_leaves_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 40)  # eight leaves of about 112 vectors, each in four parts
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    out = ann.search(rows, rows.where("id % 100 = 0"), leaf=8, least=1800, trees=2)
    for q in range(0, 900, 100):
        s = ann.dots(x, x[q])
        assert [r.vec_id for r in out.where(f"query_id = {q}").orderBy("rank").collect()] == [int(j) for j in np.lexsort((np.arange(900), -s)) if j != q][:20]
