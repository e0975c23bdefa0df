import itertools
import random

import numpy as np
import pytest

from pagewarden.llm import jaccard


def slow_sets(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def slow_join(rows, percent=80):
    sets, root = slow_sets([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(((doc, len(s), least.get(find(k))) for k, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(spark, rows, parts=5, **how):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n long, v string").repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, **how).collect()), key=repr)


def hard_rows(seed):
    """Groups of near copies, texts of a few stock passages only, shared passages, all sizes, ties and repeats."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)] + ["É", " x"]
    texts = []
    for size, n in ((120, 60), (30, 30), (9, 12), (400, 6)):
        base = rng.choices(words, k=size)
        for _ in range(n):
            near = list(base)
            for at in rng.sample(range(size), rng.randint(0, max(1, size // 30))):
                near[at] = rng.choice(words)
            texts.append(near)
    stock = [rng.choices(words, k=40) for _ in range(6)]
    texts += [sum((stock[i] for i in rng.sample(range(6), rng.choice([2, 3, 5]))), []) for _ in range(50)]
    texts += [rng.choices(words, k=rng.randint(20, 200)) + stock[0] for _ in range(30)]
    texts += [rng.choices(words, k=k) for k in range(1, 12)] * 2
    rows = [(10 + i, rng.choice([" ", "\n ", "\t"]).join(t).upper() if rng.random() < 0.2 else " ".join(t)) for i, t in enumerate(texts)]
    rows += [(5, rows[0][1]), (10, rows[0][1]), (11, None), (12, " \n\t"), (13, ""), (None, rows[3][1]), (None, "no other text is like this one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rare, few, tile, span", [(64, 32, 256, 1 << 21), (3, 4, 8, 500), (2, 0, 5, 64)])
def test_components_against_all_pairs(spark, monkeypatch, rare, few, tile, span):
    for name, value in (("RARE", rare), ("FEW", few), ("TILE", tile), ("RANGE_TOKENS", span)):
        monkeypatch.setattr(jaccard, name, value)
    rows = hard_rows(rare)
    assert joined(spark, rows) == slow_join(rows)


def test_linked_sets_meet_in_a_signature():
    rng = np.random.default_rng(5)
    for percent, rare in ((80, 4), (60, 2), (90, 8)):
        for _ in range(400):
            n = int(rng.integers(2, 90))
            counts = rng.choice([2, 3, rare, rare * rare, rare**3], size=4 * n).astype(np.uint32)
            keys = rng.permutation(4 * n).astype(np.uint64)
            a = np.arange(n)
            b = np.r_[a[int(rng.integers(0, n // 4 + 1)) :], n + np.arange(int(rng.integers(0, n // 4 + 1)))]
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common) and len(a) > 1 and len(b) > 1:
                one, two = (set(jaccard.signatures(len(x), keys[x], counts[x], percent, rare)) for x in (a, b))
                assert one & two


def test_hashes_of_long_words_and_slices(monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE", 64)
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(40) for _ in range(500)] + [b"x" * 9000, b"y", b"x" * 9000]
    _, hashes = jaccard.word_hashes(b" \t".join(words))
    seen = {}
    assert len(hashes) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


def test_no_documents(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    assert joined(spark, [(2, "one"), (1, "One"), (3, "one two")]) == [(1, 1, 1), (2, 1, 1), (3, 1, 3)]
