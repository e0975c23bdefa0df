import random

import numpy as np
import pyarrow as pa
import pytest

from pagewarden.llm import spiece

TEXTS = [
    "Hello world", "  two  spaces ", "line\nbreak\n\nend", "éê ñ 漢字 ☃ \U0001f600", "a" * 70, "x", " ", "\n", "word. word, (word) %%% the the", "tab\there", "▁lower one ▁", "aa bb " * 300,
    " \n x", "   ", "  the", "a   the b    c\n  d \n\n e", "ab▁▁cd", " " * 40 + "x" + " " * 17 + "the", "nospacesatall" * 40, "=" * 100,
]


@pytest.fixture(scope="module")
def proto():
    with open(spiece.MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(proto):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def chunked(v, text, size):
    parts = [(s, pad, n) for pad, n, s in spiece.chunks_of(spiece.normalised(text), size, v.span)]
    states = spiece.border_states([v.matrix(*p) for p in parts])
    return ids(b"".join(v.backtrace((*p, states[k], states[k + 1]) for k, p in enumerate(parts))))


def odd_texts(library):
    rng = random.Random(5)
    words = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000, 17)]
    return TEXTS + ["".join(rng.choices(words, k=200)) for _ in range(40)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000))]


def test_ids_are_those_of_the_model(proto, library):
    v, d = spiece.Vocabulary(proto), spiece.Surfaces(proto)
    texts = odd_texts(library)
    got = v.encode_all(texts)
    for t, x in zip(texts, got, strict=True):
        assert ids(x) == library.encode(t), t
        assert ids(v.one(spiece.normalised(t))) == ids(x)  # without words, in one segment
    back = d.decode(spiece._ids_array(got)).to_pylist()
    assert [b for b, t in zip(back, texts, strict=True) if "▁" not in t] == [t for t in texts if "▁" not in t]
    assert d.decode(pa.array([None, [], [3 + 0xC3]], pa.list_(pa.int32()))).to_pylist() == ["", "", "�"]


@pytest.mark.parametrize("size", [16, 17, 50, 256, 1024])
def test_ids_do_not_depend_on_chunks(proto, library, size):
    v = spiece.Vocabulary(proto)
    for t in odd_texts(library):
        assert chunked(v, t, size) == library.encode(t), t


def test_the_path_is_the_only_one(proto):
    """Brute force: of all sequences of pieces, one has only compatible neighbours, and it is the encoding."""
    v = spiece.Vocabulary(proto)
    for text in ("▁hello", "▁the▁then", "aaaaaaa", "▁▁▁a"):

        def paths(at, last):
            if at == len(text):
                yield []
            for q, x in v.from_(text, at, len(text)) if at < len(text) else ():
                if v.fits(last, x):
                    for rest in paths(q, x):
                        yield [x, *rest]

        assert list(paths(0, v.other)) == [v.symbols(text)]


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random(shape) < 0.5, spiece._NEG, rng.integers(-99, 99, shape)) for shape in ((2, 4), (4, 3), (3, 5)))
    assert (spiece.times(spiece.times(a, b), c) == spiece.times(a, spiece.times(b, c))).all()


def test_columns(spark, library):
    giant = " ".join(f"word{i} thing" for i in range(9000)) + "x" * 5000
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "né"), (5, giant), (5, giant + "!")]
    clash = ["ids", "row", "k", "s", "size", "pad", "decoded"]
    df = spark.createDataFrame([(a, b, *clash) for a, b in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    want = sorted((a or 0, b or "", library.encode(b or "")) for a, b in rows)
    for chunk in (256, 4096, 1 << 20):
        out = spiece.decode(spiece.encode(df, chunk=chunk)).collect()
        assert sorted((r.doc_id or 0, r.decoded, list(r.ids)) for r in out) == want
    assert spiece.encode(df.limit(0)).count() == 0
