import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewarden.llm import collocations


def slow_phrases(rows, least, longest, absorb, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = []
        frequent = {p: a for p, a in count.items() if a >= least}
        for p, a in frequent.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= absorb * a and inside(q) for q, b in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(t, lang, 1, "odd") for t, lang in rows], "text string, lang string, n long, phrase string").repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "É", "l'eau", "a b", "x", "y", "z"]
    rows = []
    for _ in range(150):
        w = []
        for _ in range(rng.randint(0, 40)):
            w += rng.choice([["new", "York", "city"], ["the", "the", "the"], ["one", "of", "the", "most", "often"], [rng.choice(words)]])
            w.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ;: "]))
        rows.append((" ".join(w), rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, ("", "en"), (None, "en"), ("only once", "fr"), *[("again and again", "fr")] * 9]


@pytest.mark.parametrize("least, longest, absorb, top", [(5, 5, 100, 2000), (3, 4, 60, 11), (9, 2, 100, 50), (10**6, 5, 100, 9)])
def test_phrases_against_plain_counts(spark, monkeypatch, least, longest, absorb, top):
    monkeypatch.setattr(collocations, "BLOCK_ROWS", 7)
    rows = texts(least)
    want = slow_phrases(rows, least, longest, absorb, top)
    assert mined(spark, rows, least=least, longest=longest, absorb=absorb, top=top) == want
    assert (least > 10**5) == (not want)


def test_long_gaps_take_four_bytes():
    lists = [[3, 9, 70_000, 70_001], [0], [65_535], [65_536], [1, 65_536]]
    places, ends = np.array(sum(lists, [])), np.cumsum([len(x) for x in lists])
    short, two, four = collocations.packed(places, ends)
    assert short.tolist() == [False, True, True, False, True]
    assert [np.cumsum(np.frombuffer(g, np.uint16), dtype=np.int64).tolist() for g in two.to_pylist()] == [[0], [65_535], [1, 65_536]]
    assert [np.cumsum(np.frombuffer(g, np.uint32), dtype=np.int64).tolist() for g in four.to_pylist()] == [lists[0], [65_536]]


def test_no_documents(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("...", "en")]) == []


def test_pairs_are_numbers_and_back():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 1000, 2**20 + 1, 2**32):
        space = collocations.Space(size)
        pre, suf = rng.integers(0, size, 2000), rng.integers(0, size, 2000)
        keys = space.key(pre, suf)
        assert (keys <= space.mask).all() and all((a == b).all() for a, b in zip(space.pair(keys), (pre, suf), strict=True))


@pytest.mark.parametrize("span", [50, 700])
def test_many_ranges(spark, monkeypatch, span):
    monkeypatch.setattr(collocations, "RANGE_PLACES", span)
    monkeypatch.setattr(collocations, "RANGE_WORDS", span // 10)
    rows = texts(span)
    assert mined(spark, rows, least=4) == slow_phrases(rows, 4, 5, 100, 2000)
