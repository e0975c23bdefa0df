import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pagewarden.llm import simhash


def slow_fingerprint(text, n=3):
    w = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split() if x]
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, linked):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return {(r[0], least[find(i)]) for i, r in enumerate(rows)}


def test_counters_agree_with_popcount():
    rng = np.random.default_rng(3)
    for bits, radius in ((64, 2), (64, 0), (256, 55), (256, 7)):
        base = rng.integers(0, 256, bits // 8, dtype=np.uint8)
        fps = []
        for k in range(200):
            x = np.unpackbits(base)
            x[rng.choice(bits, min(bits, k // 3), replace=False)] ^= 1
            fps.append(np.packbits(x).tobytes())
        vertical, full = simhash.planes(fps), (1 << len(fps)) - 1
        for f in fps[::20]:
            row = [full if b else 0 for b in np.unpackbits(np.frombuffer(f, np.uint8))]
            want = sum(1 << j for j, g in enumerate(fps) if (int.from_bytes(f) ^ int.from_bytes(g)).bit_count() <= radius)
            assert simhash.within(row, vertical, radius, 0, full) == want


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)  # several tiles in the large blocks
    rng = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    texts = [None, "", " \n", "one", "one two", "One\tTWO", "é É x y"]
    for _ in range(6):
        long = rng.choices(words, k=600)
        texts += [" ".join(long)] * 2
        for _ in range(12):
            changed = list(long)
            changed[rng.randrange(600)] = "new"
            texts.append(" ".join(changed))
    rows = list(enumerate(texts, 10)) + [(10, None), (12, " \n")]
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    fp = [(i, slow_fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id, int(r.fingerprint, 16)) for r in out) == sorted(fp)
    assert {(r.doc_id, r.component_id) for r in out} == slow_components(fp, lambda a, b: (a[1] ^ b[1]).bit_count() <= 2)


def test_long_chains_are_one_component(spark, monkeypatch):
    tables = []
    scratch = simhash.scratch
    monkeypatch.setattr(simhash, "scratch", lambda df, name: tables.append(name) or scratch(df, name))
    n = 1000
    chain = [(i.to_bytes(2), (i + 1).to_bytes(2)) for i in range(n - 1)]  # in ascending order
    edges = spark.createDataFrame([*chain, (b"\xff\xfe", b"\xff\xff")], "a binary, b binary").coalesce(1)
    out = {bytes(r.v): bytes(r.root) for r in simhash.components(edges).collect()}
    assert len({out[i.to_bytes(2)] for i in range(n)}) == 1 and out[b"\xff\xfe"] == out[b"\xff\xff"] != out[b"\0\0"]
    assert len(out) == n + 2 and tables.count("contract") <= 20


def test_hot_blocks_break_into_smaller_ones(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(7)
    base = rng.getrandbits(64)
    low = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {base ^ rng.getrandbits(20) for _ in range(200)})
    rows = spark.createDataFrame([(x.to_bytes(8),) for x in low], "v binary")
    blocks = simhash.exact_blocks(rows, 64, 2).toPandas()
    assert blocks.key.str.count(":").max() > 1
    found = simhash.components(simhash.forest(rows, simhash.exact_blocks(rows, 64, 2), 2)).collect()
    root = {int.from_bytes(r.v): bytes(r.root) for r in found}
    groups = defaultdict(set)
    for i, x in enumerate(low):
        groups[root.get(x, x)].add(i)
    want = slow_components(list(enumerate(low)), lambda a, b: (a[1] ^ b[1]).bit_count() <= 2)
    assert {(i, min(g)) for g in groups.values() for i in g} == want


@pytest.mark.parametrize("tile, stars", [(4, 1), (12, 1), (3, 4)])
def test_large_blocks_are_starred(spark, docs_schema, monkeypatch, tile, stars):
    """Many near copies of one text, and many texts that share a passage: against all pairs."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "STAR_TILES", stars)
    rng = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    base, passage, texts = rng.choices(words, k=120), rng.choices(words, k=60), []
    for _ in range(40):
        near = list(base)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            near[at] = "n%d" % rng.randrange(10**6)
        texts.append(near)
    for _ in range(40):
        own = rng.choices(words, k=30)
        texts += [own + passage] + ([[*own[:-1], "x", *passage]] if rng.random() < 0.4 else [])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    want = slow_components([(i, s) for (i, _), s in zip(rows, sets, strict=True)], lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs_schema)
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == {least for _, least in want}


def test_the_stage_keeps_one_of_each(spark, docs_schema):
    rng = random.Random(4)
    words = ["term%d" % i for i in range(5000)]
    rows, groups = [], []
    for g in range(40):
        base = rng.choices(words, k=rng.choice([60, 200, 900]))
        rows.append((100 * g, " ".join(base)))
        groups.append(g)
        for c in range(1, 4):
            near = list(base)
            near[rng.randrange(len(near))] = "changed%d" % c
            rows.append((100 * g + c, " ".join(near)))
    alone = [(9000 + i, " ".join(rng.choices(words, k=50)) + " " + " ".join(rng.choices(words, k=20))) for i in range(50)]
    passage = " ".join(rng.choices(words, k=60))
    shared = [(9500 + i, " ".join(rng.choices(words, k=150)) + " " + passage + " " + " ".join(rng.choices(words, k=150))) for i in range(30)]
    odd = [(9900, ""), (9901, None), (9902, "a b"), (9903, "A  b"), (9904, "c"), (9904, "c"), (None, "z z z"), (None, "y y y")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + alone + shared + odd], docs_schema)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    want = [100 * g for g in groups] + [i for i, _ in alone + shared] + [9900, 9902, 9904, -1, -1]
    missing, extra = set(want) - set(ids), [i for i in ids if i not in set(want)]
    assert not missing and len(extra) <= 2, (missing, extra)  # block keys can miss a link, rarely
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 700])
def test_sketch_similarity_is_exact_for_short_texts(n):
    a, b = np.arange(n, dtype=np.uint32), np.arange(1, n + 1, dtype=np.uint32)
    if n < simhash.STAGE["sketch"]:
        assert simhash.jaccard(a, b) == (n - 1) / (n + 1)


def test_the_radius_holds_repeated_lines_and_short_texts(spark, docs_schema):
    rng = random.Random(6)
    words = ["term%d" % i for i in range(5000)]
    texts = []
    for copies in (10, 40):
        for _ in range(5):
            base = rng.choices(words, k=300)
            texts += [base, base + base[-12:] * copies]
    short = [rng.sample(words, 9) for _ in range(300)]
    texts += [t for s in short for t in (s[:8], s)]  # four and five shingles: similarity 0.8
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], docs_schema)
    fps = [int.from_bytes(r.fp) for r in simhash.signatures(df).orderBy("doc_id").select("fp").collect()]
    far = [i for i in range(0, len(fps), 2) if (fps[i] ^ fps[i + 1]).bit_count() > simhash.STAGE["radius"]]
    assert not far
    assert {r.doc_id for r in simhash.keep_one_of_each(df.where("doc_id < 20")).collect()} == set(range(0, 20, 2))


def test_long_texts_near_the_bound_are_told_exactly(spark, docs_schema):
    rng = random.Random(8)
    rows, want = [], []
    for g in range(40):
        base = ["w%d" % rng.randrange(10**9) for _ in range(3000)]
        near = list(base)
        for i in range(0, 5 * (64 + g % 7), 5):  # a similarity of 0.79 to 0.81
            near[i] = "n%d" % rng.randrange(10**9)
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, near))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
        want += [2 * g] if len(a & b) / len(a | b) >= 0.8 else [2 * g, 2 * g + 1]
    assert 40 < len(want) < 80
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs_schema)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(df).collect()) == want


@pytest.mark.parametrize("tile, values", [(simhash.TILE, simhash.SET_VALUES), (16, 8000)])
def test_doubtful_pairs_take_a_row_for_each_text(spark, docs_schema, monkeypatch, tile, values):
    """Long near copies around the bound: a row for each text of a block, and the components of all pairs."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SET_VALUES", values)
    rng = random.Random(12)
    base = ["w%d" % rng.randrange(10**9) for _ in range(700)]
    texts = []
    for _ in range(60):
        near = list(base)
        for at in rng.sample(range(0, 700, 5), rng.randint(7, 13)):
            near[at] = "n%d" % rng.randrange(10**9)
        texts.append(near)
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], docs_schema)
    vertices = simhash.scratch(simhash.signatures(df).select("v", "fp", "keys", "sketch"), "vertices")
    blocks, star = simhash.similar_blocks(vertices, simhash.STAGE["radius"], simhash.STAGE["similarity"])
    links = simhash.forest(vertices, blocks, simhash.STAGE["radius"], simhash.STAGE["similarity"])
    tiles = -(-60 // tile)
    assert star is None and 0 < links.where("NOT sure").count() <= tiles * blocks.count()
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    want = slow_components(list(enumerate(sets)), lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))
    assert 1 < len({least for _, least in want}) < 60
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == {least for _, least in want}


def test_overlap_counts_common_values():
    rng = np.random.default_rng(5)
    lanes = [np.unique(rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint32)) for _ in range(40)]
    overlap = simhash.Overlap(lanes)
    for row in lanes:
        assert overlap.common(row).tolist() == [len(np.intersect1d(row, x)) for x in lanes]


def test_no_long_pair_at_the_bound_is_hopeless():
    """Cut sketches of sets at a similarity of 0.8, of all proportions of sizes."""
    rng, k = np.random.default_rng(6), simhash.STAGE["sketch"]
    least = 1.0
    for _ in range(300):
        n = int(rng.integers(k, 4000))
        both, left = int(0.8 * n), int(rng.integers(0, n - int(0.8 * n) + 1))
        h = rng.permutation(rng.choice(1 << 31, n, replace=False))
        a, b = np.sort(h[: both + left])[:k], np.sort(np.concatenate([h[:both], h[both + left :]]))[:k]
        c = len(np.intersect1d(a, b))
        least = min(least, c / (len(a) + len(b) - c))
    assert least > simhash.STAGE["hopeless"] + 0.05


def test_enough_block_keys():
    assert (1 - simhash.STAGE["similarity"]) ** simhash.STAGE["keys"] < 2e-7
