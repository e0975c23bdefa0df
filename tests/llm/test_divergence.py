import random
from collections import Counter, defaultdict

from pagewarden.llm import divergence


def slow_audit(rows, least, add, scale, top):
    docs = [(t or "", lang or "", source or "") for t, lang, source in rows]
    terms = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in t).split(" ")
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in docs:
        found = [x for x in terms(t) if x]
        held[lang].update(set(found))
        counts[lang, source].update(found)
        counts[lang, None].update(found)
    out = []
    for lang, source in {(lang, s) for _, lang, s in docs}:
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(s, lang=lang, kept=kept):
            n = sum(counts[lang, s][t] for t in kept)
            return {t: 1 + scale * (counts[lang, s][t] + add) // (n + add * len(kept)) for t in kept}

        p, q = shares(source), shares(None)
        pairs = [(sum(abs(p[t] - r[t]) for t in kept), s) for s in {s for _, x, s in docs if x == lang and s != source} for r in [shares(s)]]
        more = [(p[t] - q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", more)):
            for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or k <= top:
                    out.append((lang, source, part, item, value, k))
    return sorted(out)


def audited(spark, rows, **how):
    df = spark.createDataFrame([(i, *r, "odd") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(5)
    return sorted(map(tuple, divergence.audit(df, **how).collect()))


def test_audit_against_plain_sums(spark):
    rng = random.Random(3)
    words = ["the", "of", "Été", "ÉTÉ", "a b", "x_y", "don't", "Zeta", "zeta", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "b", "c", None, ""])) for _ in range(300)]
    rows += [("", "en", "empty"), (None, "en", "nulls"), ("only once", "fr", "lone"), ("rare", "fr", "other")] + [("twin words", "en", "b")] * 5
    want = slow_audit(rows, 4, 5, 10**9, 7)
    assert {r[0] for r in want} == {"en", "de", "", "fr"}
    assert audited(spark, rows, least_docs=4, top=7) == want
    assert any(r[2] == "pair" and r[0] == "fr" and r[4] == 0 for r in want)


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(*[divergence.F.lit(x).cast("long") for x in (4 * 10**12, 9 * 10**12, 10**6)]).alias("p")).first()
    assert row.p == 1 + 10**9 * (4 * 10**12 + 5) // (9 * 10**12 + 5 * 10**6)


def test_no_documents(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []
    assert audited(spark, [(None, None, None), ("x", None, "s")]) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_a_side_that_is_repeated_is_not_broadcast(spark, tmp_path):
    """Its file is small, its rows are many: Spark's own estimate would broadcast all copies of them."""
    from pagewarden.llm.common import BROADCAST_ROWS, join_spread

    spark.range(50).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/small")
    small, big = spark.read.parquet(f"{tmp_path}/small"), spark.range(500).selectExpr("id % 50 as k", "id")
    out = join_spread(big, small, ["k"], big["id"], BROADCAST_ROWS + 1)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 500
