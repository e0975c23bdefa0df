"""Phrase collocation mining on vertical positional inverted lists.

Texts are cut into blocks (Arrow batches).  Every place of a word in a block has a number; pieces and
documents are a number apart.  A list holds the places of one phrase in one block, so the lengths of its
lists sum to the exact frequency of the phrase.  Phrases of
k words come from those of k - 1: a block merges its lists of phrases with the lists of the adjacent
words, that is of the places one further on.  From the second step on, an adjacent word's list is taken
from the phrases of k - 1 words that begin there and end in the word, as no other place of the word can
end a frequent phrase.  The block tells every range of the space of such pairs the lengths of its merged
lists, in one packed row; the range sums them over the blocks, numbers the frequent ones and answers
which of the block's lists these are; words are told so too.  Blocks are bucketed, so only words, pairs
and answers move, and lists never do.

A candidate's cuts need the frequencies of its first and last words, which are frequent phrases too: each
phrase carries those of all its heads and tails, taken over from the two phrases that it was made of.

Defined results: null text is an empty text, null lang is ``und``; repeated rows count as often as they
occur; a language without candidates has no rows.  Arithmetic is exact, in decimals of 38 digits.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, discard, scratch, tidy
from .jaccard import gaps, ungaps, word_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
#: A candidate inside a longer one goes if the longer one has at least this percentage of its frequency.
ABSORB = 100
#: Rows and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 8 << 20
#: Places in blocks for each range of the space of pairs, words of blocks for each range of hashes.
RANGE_PLACES, RANGE_WORDS = 1 << 21, 1 << 19

#: A-Z become a-z, every mark that ends a piece a full stop, tab a space.
_MARKS = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))


def packed(places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Lists (one after another, ending at ends) as differences: which lists fit in two bytes each, those, and the others in four.

    Every list is ascending and starts anew from 0.
    """
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    d = np.diff(places, prepend=0).astype(np.int64)
    d[starts] = places[starts]
    short = np.maximum.reduceat(d, starts) < 1 << 16
    n = ends - starts
    each = np.repeat(short, n)
    parts = []
    for pick, kind in ((short, np.uint16), (~short, np.uint32)):
        data = d[each if kind is np.uint16 else ~each].astype(kind)
        offsets = np.r_[0, np.cumsum(n[pick])].astype(np.int32) * data.itemsize
        parts.append(pa.BinaryArray.from_buffers(pa.binary(), int(pick.sum()), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]))
    return short, *parts


WORDS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("ends", pa.binary()), ("short", pa.binary()), ("two", pa.binary()), ("four", pa.binary()), ("places", pa.int64())])
WORDS_SQL = "block long, lang string, words array<string>, ends binary, short binary, two binary, four binary, places long"


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs(text, lang): the words of a language in an Arrow batch, in the order of their hashes, and a list for each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for b in batches:
            by_lang: dict[str, list[int]] = {}
            for i, x in enumerate(b["lang"].to_pylist()):
                by_lang.setdefault(x, []).append(i)
            texts = b["text"].cast(pa.binary())
            for lang, rows in by_lang.items():
                words: list[bytes] = []
                for i in rows:
                    words += texts[i].as_py().translate(_MARKS).replace(b".", b" . ").split()
                    words.append(b".")
                coded = pa.array(words, pa.binary()).dictionary_encode()
                del words
                names = coded.dictionary.to_pylist()
                rank = np.empty(len(names), np.int64)  # of each word by its hash; the mark is no word
                order = np.argsort(word_hashes(b" ".join(names))[1], kind="stable")
                order = order[order != names.index(b".")]
                rank[:] = -1
                rank[order] = np.arange(len(order))
                which = rank[coded.indices.to_numpy()]
                at = np.argsort(which, kind="stable")
                at = at[np.searchsorted(which[at], 0) :]
                if not len(at):
                    continue
                ends = np.searchsorted(which[at], np.arange(len(order)), "right")
                row = {"block": next(number), "lang": lang, "words": [names[i].decode() for i in order.tolist()]} | lists_row(at, ends)
                yield pa.RecordBatch.from_pylist([row], WORDS)
        tidy()

    return docs.mapInArrow(split, WORDS_SQL)


def lists_row(places: np.ndarray, ends: np.ndarray) -> dict:
    """The columns that hold lists, one after another, ending at ends."""
    short, two, four = packed(places, ends)
    return {"ends": ends.astype(np.int64).tobytes(), "short": short.tobytes(), "two": b"".join(two.to_pylist()), "four": b"".join(four.to_pylist()), "places": len(places)}


def lists_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The places of a row's lists, one list after another, and the lists' lengths."""
    ends, short = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["short"], bool)
    n = np.diff(np.r_[0, ends])
    d = np.empty(int(ends[-1]), np.int64)
    each = np.repeat(short, n)
    d[each] = np.frombuffer(row["two"], np.uint16)
    d[~each] = np.frombuffer(row["four"], np.uint32)
    run = np.cumsum(d)
    first = ends - n
    return run - np.repeat(run[first] - d[first], n), n


def word_sums(blocks: DataFrame, least: int) -> DataFrame:
    """What the ranges of words' hashes say of word_blocks, as range_sums does of pairs.

    Rows without a block hold a range's frequent words with languages and frequencies.
    """
    bits = 0
    while RANGE_WORDS << bits < (blocks.agg(F.sum(F.size("words"))).first()[0] or 0):
        bits += 1
    strings, low = pa.list_(pa.string()), np.uint64(64 - bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, words, ends in zip(*(b[c].to_pylist() for c in ("block", "lang", "words", "ends")), strict=True):
                n = np.diff(np.r_[0, np.frombuffer(ends, np.int64)])
                hashes = word_hashes(" ".join(words).encode())[1]
                cut = np.r_[np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << low) if bits else [0], len(words)]
                some = [(r, i, j) for r, (i, j) in enumerate(itertools.pairwise(cut.tolist())) if j > i]
                cells = [[r for r, _, _ in some], [block] * len(some), [i for _, i, _ in some], [lang] * len(some), [words[i:j] for _, i, j in some], [least_bytes(n[i:j]) for _, i, j in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.string(), strings, pa.binary()), strict=True)], ["range", "block", "at", "lang", "words", "times"])

    names = ["range", "block", "at", "langs", "words", "counts", "hits", "ranks"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), strings, strings, pa.list_(pa.int64()), pa.binary(), pa.binary())

    def answer(r: int, rows: list[tuple]) -> pa.RecordBatch | None:
        sums: dict[str, dict[str, int]] = {}
        for _, _, lang, words, times in rows:
            of = sums.setdefault(lang, {})
            for w, n in zip(words, numbers(times, len(words)).tolist(), strict=True):
                of[w] = of.get(w, 0) + n
        often = [(lang, w, n) for lang, of in sums.items() for w, n in of.items() if n >= least]
        if not often:
            return None
        rank = {(lang, w): k for k, (lang, w, _) in enumerate(often)}
        out = [(r, None, None, *map(list, zip(*often, strict=True)), None, None)]
        for block, at, lang, words, _ in rows:
            hits = [(k, i) for k, w in enumerate(words) if (i := rank.get((lang, w))) is not None]
            if hits:
                out.append((r, block, at, None, None, None, *(np.array(c, np.uint32).tobytes() for c in zip(*hits, strict=True))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    asked = blocks.select("block", "lang", "words", "ends").mapInArrow(ask, "range long, block long, at long, lang string, words array<string>, times binary")
    by_range = grouped(("block", "at", "lang", "words", "times"), answer)
    return asked.repartition("range").sortWithinPartitions("range").mapInArrow(by_range, "range long, block long, at long, langs array<string>, words array<string>, counts array<long>, hits binary, ranks binary")


def grouped(names: tuple[str, ...], answer: Callable[[int, list[tuple]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows that come range by range: what ``answer`` makes of the rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for b in batches:
            for r, *row in zip(*(b[c].to_pylist() for c in ("range", *names)), strict=True):
                if r != now and held:
                    if out := answer(now, held):
                        yield out
                    held = []
                now = r
                held.append(tuple(row))
        if held and (out := answer(now, held)):
            yield out
        tidy()

    return run


def first_blocks(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks of the lists of frequent words."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                places, n = lists_of(row)
                number = told_numbers(row["told"], len(n))
                on = number >= 0
                yield block_row(row["block"], number[on], places[np.repeat(on, n)], np.cumsum(n[on]))
        tidy()

    return blocks.select("block", "ends", "short", "two", "four").join(told(answers), "block").mapInArrow(keep, BLOCK_SQL)


def told(answers: DataFrame) -> DataFrame:
    """The answers(block, at, hits, ranks, offset) of each block together: an entry for each range."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("at", "hits", "ranks", "offset")).alias("told"))


def told_numbers(entries: list[dict], n: int) -> np.ndarray:
    """The number of each of a block's n phrases, -1 for those that are not frequent."""
    number = np.full(n, -1, np.int64)
    for t in entries:
        number[t["at"] + np.frombuffer(t["hits"], np.uint32).astype(np.int64)] = t["offset"] + np.frombuffer(t["ranks"], np.uint32).astype(np.int64)
    return number


BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("short", pa.binary()), ("two", pa.binary()), ("four", pa.binary()), ("places", pa.int64())])
BLOCK_SQL = "block long, ids binary, ends binary, short binary, two binary, four binary, places long"


def block_row(block: int, ids: np.ndarray, places: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": block, "ids": ids.astype(np.int64).tobytes()} | lists_row(places, ends)], BLOCK)


def merged(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: ids, and the places at which one list is followed by another one place on, with the indices of both."""
    places, n = lists_of(row)
    order = np.argsort(places)
    at = places[order]
    which = np.repeat(np.arange(len(n)), n)[order]
    next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
    return np.frombuffer(row["ids"], np.int64), at[next_to], which[next_to], which[next_to + 1]


class Space:
    """Pairs of numbers below ``size`` as numbers of an even count of bits, dealt out evenly, without loss."""

    ODD = 0x9E3779B97F4A7C15

    def __init__(self, size: int) -> None:
        self.half = max(1, (size - 1).bit_length())
        self.mask = np.uint64((1 << 2 * self.half) - 1)

    def key(self, pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
        x = (pre.astype(np.uint64) << np.uint64(self.half)) | suf.astype(np.uint64)
        for _ in range(2):
            x = (x * np.uint64(self.ODD)) & self.mask
            x ^= x >> np.uint64(self.half)
        return x

    def pair(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back = np.uint64(pow(self.ODD, -1, 1 << 64))
        for _ in range(2):
            x = x ^ (x >> np.uint64(self.half))
            x = (x * back) & self.mask
        return (x >> np.uint64(self.half)).astype(np.int64), (x & np.uint64((1 << self.half) - 1)).astype(np.int64)


def least_bytes(n: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    return n.astype(np.uint8 if n.max() < 1 << 8 else np.uint16 if n.max() < 1 << 16 else np.uint32).tobytes()


def numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.int64)


def range_sums(blocks: DataFrame, size: int, least: int) -> DataFrame:
    """What the ranges of pairs say of blocks whose phrases are numbered below ``size``.

    Rows without a block hold a range's frequent pairs (keys) and their frequencies (counts); the others
    tell a block which of its pairs of a range, from number ``at`` on, are frequent (hits), and their
    places among the range's frequent ones (ranks).
    """
    space, ranges = Space(size), 1
    while ranges * RANGE_PLACES < (blocks.agg(F.sum("places")).first()[0] or 0) and ranges < 1 << 2 * space.half:
        ranges *= 2
    low = np.uint64(2 * space.half - ranges.bit_length() + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, _, left, right = merged(row)
                pairs, n = np.unique(space.key(ids[left], ids[right]), return_counts=True)
                cut = np.r_[np.searchsorted(pairs, np.arange(ranges, dtype=np.uint64) << low), len(pairs)]
                some = [(r, i, j) for r, (i, j) in enumerate(itertools.pairwise(cut.tolist())) if j > i]
                cells = [[r for r, _, _ in some], [row["block"]] * len(some), [i for _, i, _ in some], [j - i for _, i, j in some], [gaps(pairs[i:j] - (np.uint64(r) << low)) for r, i, j in some], [least_bytes(n[i:j]) for _, i, j in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(),) * 4 + (pa.binary(),) * 2, strict=True)], ["range", "block", "at", "n", "keys", "times"])

    names = ["range", "block", "at", "keys", "counts", "hits", "ranks"]
    kinds = (pa.int64(),) * 3 + (pa.binary(),) * 4

    def answer(r: int, rows: list[tuple]) -> pa.RecordBatch | None:
        keys = [ungaps(x[3], x[2]) for x in rows]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every, times = every[order], np.concatenate([numbers(x[4], x[2]) for x in rows])[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        sums = np.add.reduceat(times, first)
        often = sums >= least
        known = every[first][often]
        if not len(known):
            return None
        out = [(r, None, None, (known + (np.uint64(r) << low)).tobytes(), sums[often].astype(np.int64).tobytes(), None, None)]
        for k, x in zip(keys, rows, strict=True):
            rank = np.searchsorted(known, k)
            hit = np.flatnonzero(known[np.minimum(rank, len(known) - 1)] == k)
            if len(hit):
                out.append((r, x[0], x[1], None, None, hit.astype(np.uint32).tobytes(), rank[hit].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    asked = blocks.mapInArrow(ask, "range long, block long, at long, n long, keys binary, times binary")
    return asked.repartition("range").sortWithinPartitions("range").mapInArrow(grouped(("block", "at", "n", "keys", "times"), answer), "range long, block long, at long, keys binary, counts binary, hits binary, ranks binary")


def frequent_pairs(said: DataFrame, size: int) -> DataFrame:
    """(range, rank, pre, suf, a) of what range_sums says."""
    space = Space(size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, keys, counts in zip(b["range"].to_pylist(), b["keys"].to_pylist(), b["counts"].to_pylist(), strict=True):
                pre, suf = space.pair(np.frombuffer(keys, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pre), r)), pa.array(np.arange(len(pre))), pa.array(pre), pa.array(suf), pa.array(np.frombuffer(counts, np.int64))], ["range", "rank", "pre", "suf", "a"])

    return said.where("block IS NULL").select("range", "keys", "counts").mapInArrow(rows, "range long, rank long, pre long, suf long, a long")


def next_blocks(blocks: DataFrame, answers: DataFrame, size: int) -> DataFrame:
    """Blocks of the lists of the frequent pairs of blocks whose phrases are numbered below ``size``."""
    space = Space(size)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, at, left, right = merged(row)
                pairs, place = np.unique(space.key(ids[left], ids[right]), return_inverse=True)
                own = told_numbers(row["told"], len(pairs))[place]
                on = np.flatnonzero(own >= 0)
                on = on[np.argsort(own[on], kind="stable")]
                ends = np.r_[np.flatnonzero(np.diff(own[on])) + 1, len(on)]
                yield block_row(row["block"], own[on][ends - 1], at[on], ends)
        tidy()

    return blocks.join(told(answers), "block").mapInArrow(keep, BLOCK_SQL)


def offsets(rows: DataFrame, key: str, n: F.Column) -> DataFrame:
    """(key, offset): how many there are before each key, of a table of few rows (ranges or partitions)."""
    sums = rows.groupBy(key).agg(F.sum(n).alias("n"))
    return sums.select(key, (F.sum("n").over(Window.orderBy(key)) - F.col("n")).alias("offset"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of phrases of 1, 2, ... words with a frequency of ``least`` or more, and (lang, total) words.

    A phrase has id, lang, phrase, last (word), a (frequency), pre and suf (ids of its first and last
    words but one), heads and tails (frequencies of its first and last words, by the place of the cut).
    """
    spark = docs.sparkSession
    told_docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    with batches_of(spark, BLOCK_ROWS, BLOCK_BYTES):
        texts = scratch(word_blocks(told_docs), "word-blocks", "block")
    totals = scratch(texts.groupBy("lang").agg(F.sum("places").alias("total")), "totals")
    none, no = F.lit(None).cast("long"), F.array().cast("array<long>")
    with batches_of(spark, 64):
        said = scratch(word_sums(texts, least), "ranges")
        before = offsets(said.where("block IS NULL"), "range", F.size("words"))
        each = said.where("block IS NULL").join(before, "range").select("offset", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("rank", "w"))
        word = F.col("w.words")
        levels = [scratch(each.select((F.col("rank") + F.col("offset")).alias("id"), F.col("w.langs").alias("lang"), word.alias("phrase"), word.alias("last"), F.col("w.counts").alias("a"), none.alias("pre"), none.alias("suf"), no.alias("heads"), no.alias("tails")), "phrases")]
        size = levels[0].count()
        blocks = scratch(first_blocks(texts, said.where("block IS NOT NULL").join(before, "range")), "lists", "block")
        discard(texts, said)
    with batches_of(spark, 64):
        for k in range(2, longest + 1):
            said = scratch(range_sums(blocks, size, least), "ranges")
            found = frequent_pairs(said, size)
            before = offsets(said.where("block IS NULL"), "range", F.octet_length("counts") / 8).withColumn("offset", F.col("offset").cast("long"))
            a, b = (levels[-1].select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("lang", "phrase", "last", "a", "heads", "tails")]) for x in ("pre", "suf"))
            whole = found.join(before, "range").join(a, "pre").join(b, "suf").select(
                (F.col("rank") + F.col("offset")).alias("id"), F.col("pre_lang").alias("lang"), F.concat_ws(" ", "pre_phrase", "suf_last").alias("phrase"), F.col("suf_last").alias("last"), "a", "pre", "suf",
                F.concat("pre_heads", F.array("pre_a")).alias("heads"), F.concat(F.array("suf_a"), "suf_tails").alias("tails"),
            )
            levels.append(scratch(whole, "phrases"))
            rows = levels[-1].count()
            if k < longest and rows:
                answers = said.where("block IS NOT NULL").join(before, "range").select("block", "at", "hits", "ranks", "offset")
                old, blocks = blocks, scratch(next_blocks(blocks, answers, size), "lists", "block")
                discard(old)
            discard(said)
            size = rows
            if not rows:
                break
    discard(blocks)
    return levels, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language.

    The score of a cut is ``floor(1000 * a * n / (l * r))``, a phrase's that of its lowest-scoring cut.
    A phrase goes if a longer one holds it and has ``absorb`` percent of its frequency: a phrase one word
    longer then does as well, as it is at least as frequent.
    """
    levels, totals = frequent_phrases(docs, least, longest)
    parts = []
    for k, phrases in enumerate(levels[1:], 1):
        if k + 1 < len(levels):
            longer = levels[k + 1].select(F.explode(F.array("pre", "suf")).alias("id"), F.col("a").alias("more")).groupBy("id").agg(F.max("more").alias("more"))
            phrases = phrases.join(longer, "id", "left").where(F.coalesce(F.lit(100) * F.col("more") < F.lit(absorb) * F.col("a"), F.lit(True)))
        parts.append(phrases.select("lang", "phrase", "a", "heads", "tails"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    wide = "CAST({} AS DECIMAL(19, 0))"
    score = f"(CAST(1000 AS DECIMAL(4, 0)) * {wide.format('a')} * {wide.format('total')}) div ({wide.format('heads[i]')} * {wide.format('tails[i]')})"
    cut = F.expr(f"array_min(transform(sequence(0, size(heads) - 1), i -> struct({score} AS score, i AS cut, heads[i] AS l, tails[i] AS r)))")
    scored = candidates.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("cut", cut)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
