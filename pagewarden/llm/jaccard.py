"""N-gram Jaccard join by token-combination prefixes: which documents share enough of their word shingles.

A document's set holds the hashes of its distinct shingles.  Two sets link if
``100 * common >= percent * union``.  Equal sets are one class; the classes are joined in three steps.

1. **Which tokens are shared.**  Sets travel in blocks: one row holds the sorted tokens of some thousand
   documents.  Each block tells every range of the token space which tokens it has and how often, so a
   token that every document has is one entry a block; the range answers with the number of sets that
   have a token, if there is more than one.  A set that links shares at least ``percent`` of its tokens,
   so all other sets are done.  This runs twice, the second time over the distinct sets that are left.
2. **Prefixes of combinations.**  Tokens are ordered by the number of sets that have them, rarest first.
   Class 1 holds those of fewer than ``RARE`` sets, class 2 those of fewer than ``RARE ** 2``, class 3 the
   rest; classes 2 and 3 are dealt by hash into subclasses.  A set that misses t of its tokens (the most
   that a link allows) keeps k common tokens in some subclass of class k if its prefix holds, summed over
   the subclasses, ``max(0, tokens - (k - 1)) > t``: the prefix is extended until it does.  Its signatures
   are then the single tokens of class 1 and the k-token combinations of each other subclass.  Of two
   linked sets, the one whose prefix ends first has all its common tokens in both prefixes, so they meet
   in a signature.  The number of subclasses follows from a band of set sizes, and a set is indexed in
   each band that a partner can be in.
3. **Verification.**  The sets of a signature are first compared with one of them.  Those that are not in
   one component then are compared with all: few of them as distinct pairs, many in tiles of the sets
   of a signature, or of signatures that have sets in common, where each set is sent once for a tile.
   Every comparison is of whole sets.

Defined results: null text is an empty text; an empty text has no set and links with nothing; fewer
words than a shingle's are one shingle, which equals no longer one.  Tokens are 48 bits of a hash of the
words: two different shingles of a pair of documents of 10 000 words are one with a probability of 1e-6.
Repeated rows and doc_ids are rows of their own; a class is named by its smallest doc_id.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, join_spread, scratch, tidy
from .simhash import class_components, components

SHINGLE, PERCENT = 5, 80
#: Sets that may have a token of class 1.
RARE = 64
#: Tokens of one range of the token space, on average; ranges are counted from the tokens of all blocks.
RANGE_TOKENS = 1 << 21
#: Sets of a signature that are compared as distinct pairs; more of them meet in tiles of TILE.
FEW, TILE = 32, 256
#: Rows and bytes of a block (its documents are numbered with 16 bits).
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
#: Bytes that are hashed at once.
SLICE = 1 << 20
KEY_BITS = 48

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of each 64-bit number spread over all of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of raw begins, and a hash of it; words are divided by ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data):  # a word is never cut
            hit = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end += int(hit[0]) if len(hit) else min(4096, len(data) - end)
            if len(hit):
                break
        part = data[at:end]
        word = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        if len(first):
            # a polynomial over the bytes of each word, by differences of one running sum
            sums = np.r_[np.uint64(0), np.cumsum(_BYTES[part] * _powers(_ODD, len(part)))]
            back = _powers(pow(_ODD, -1, 1 << 64), len(part))
            hashes.append(mixed((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)))
            starts.append(first + at)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles, A-Z lower-cased."""
    texts = [(t or b"").lower() for t in texts]
    starts, words = word_hashes(b" ".join(texts))
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    factors = _powers(0xD6E8FEB86659FD93, shingle + 1)
    every = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for k in range(shingle):
        every += words[k : k + len(every)] * factors[k]
    every = mixed(every)
    out, begin = [], 0
    for end in ends.tolist():
        if end - begin >= shingle:
            out.append(np.unique(every[begin : end - shingle + 1]))
        elif end > begin:  # the whole text, with its number of words so that it is no longer shingle
            few = words[begin:end]
            out.append(mixed((few * factors[: len(few)]).sum(keepdims=True) ^ np.uint64(len(few))))
        else:
            out.append(np.empty(0, np.uint64))
        begin = end
    return out


# ---------------------------------------------------------------- blocks of sets


def gaps(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, of four bytes each if those do and of eight if not."""
    d = np.diff(keys, prepend=np.uint64(0))
    return d.astype(np.uint32).tobytes() if not len(d) or d.max() < 1 << 32 else d.tobytes()


def ungaps(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint64 if len(raw) == 8 * n else np.uint32), dtype=np.uint64)


def block_of(sets: list[np.ndarray]) -> dict:
    """Sorted tokens of a block's sets and the set that each belongs to."""
    packed = np.concatenate([(s << np.uint64(64 - KEY_BITS)) | np.uint64(i) for i, s in enumerate(sets)] or [np.empty(0, np.uint64)])
    packed.sort()
    return {"keys": gaps(packed >> np.uint64(64 - KEY_BITS)), "owners": (packed & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), "tokens": len(packed)}


BLOCK = pa.schema([("block", pa.int64()), ("v", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("keys", pa.binary()), ("owners", pa.binary()), ("tokens", pa.int64())])
BLOCK_SQL = "block long, v array<binary>, n array<long>, keys binary, owners binary, tokens long"


def blocks_of_texts(docs: DataFrame, shingle: int) -> DataFrame:
    """Blocks of docs(doc_id, text), with doc_ids: a block is an Arrow batch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for b in batches:
            for at in range(0, b.num_rows, 1 << 16):
                part = b.slice(at, 1 << 16)
                sets = shingle_sets(part["text"].cast(pa.binary()).to_pylist(), shingle)
                v = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                row = {"block": next(number), "v": v, "n": [len(s) for s in sets]} | block_of([s >> np.uint64(64 - KEY_BITS) for s in sets])
                ids = part["doc_id"]
                out = pa.RecordBatch.from_pylist([row], BLOCK)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], [*BLOCK.names, "doc_ids"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(make, f"{BLOCK_SQL}, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>")


def blocks_of_sets(sets: DataFrame) -> DataFrame:
    """Blocks of sets(v, n, keys): those that come one after another, to the size of a block of texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            row = {"block": next(number), "v": [r[0] for r in held], "n": [r[1] for r in held]} | block_of([r[2] for r in held])
            held.clear()
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for b in batches:
            for v, n, keys in zip(b["v"].to_pylist(), b["n"].to_pylist(), b["keys"].to_pylist(), strict=True):
                held.append((v, n, np.frombuffer(keys, np.uint64)))
            if len(held) > BLOCK_ROWS or sum(len(r[2]) for r in held) > BLOCK_BYTES // 8:
                yield block()
        if held:
            yield block()
        tidy()

    return sets.select("v", "n", "keys").mapInArrow(make, BLOCK_SQL)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n has in common with one that it links with, at least."""
    return -(-percent * n // 100)


def shared_sets(blocks: DataFrame, percent: int) -> DataFrame:
    """(v, n, keys, counts) of the sets that share enough tokens: these tokens, and the sets that have each.

    ``blocks`` is bucketed by block, so that the answers of the ranges move and the blocks do not.
    """
    ranges = 1
    while ranges * RANGE_TOKENS < (blocks.agg(F.sum("tokens")).first()[0] or 0):
        ranges *= 2
    low = np.uint64(KEY_BITS - ranges.bit_length() + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys, n in zip(b["block"].to_pylist(), b["keys"].to_pylist(), b["tokens"].to_pylist(), strict=True):
                own, times = np.unique(ungaps(keys, n), return_counts=True)
                cut = np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64) << low)
                rows = [(r, i, j) for r, (i, j) in enumerate(itertools.pairwise(cut.tolist())) if j > i]
                many = [times[i:j].astype(np.uint32).tobytes() if times[i:j].max() > 1 else None for _, i, j in rows]
                cells = [[r for r, _, _ in rows], [block] * len(rows), [i for _, i, _ in rows], [j - i for _, i, j in rows], [gaps(own[i:j] - (np.uint64(r) << low)) for r, i, j in rows], many]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "block", "at", "n", "keys", "times"])

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (block, at, n, keys, times) of one range."""
        keys = [ungaps(r[3], r[2]) for r in rows]
        every = np.sort(np.concatenate(keys))
        repeated = [k[np.frombuffer(r[4], np.uint32) > 1] for k, r in zip(keys, rows, strict=True) if r[4]]
        known = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *repeated]))
        if not len(known):
            return
        counts = np.searchsorted(every, known, "right") - np.searchsorted(every, known, "left")
        for k, r in zip(keys, rows, strict=True):
            if r[4]:
                more = np.frombuffer(r[4], np.uint32).astype(np.int64) - 1
                counts[np.searchsorted(known, k[more > 0])] += more[more > 0]
        out = []
        for k, r in zip(keys, rows, strict=True):
            at = np.searchsorted(known, k)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == k)
            if len(hit):
                out.append((r[0], r[1], hit.astype(np.uint32).tobytes(), np.minimum(counts[at[hit]], 0xFFFFFFFF).astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "hits", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for b in batches:
            for r, *row in zip(*(b[c].to_pylist() for c in ("range", "block", "at", "n", "keys", "times")), strict=True):
                if r != now and held:
                    yield from answer(held)
                    held = []
                now = r
                held.append(tuple(row))
        if held:
            yield from answer(held)
        tidy()

    asked = blocks.select("block", "keys", "tokens").mapInArrow(ask, "range long, block long, at long, n long, keys binary, times binary")
    answers = asked.repartition("range").sortWithinPartitions("range").mapInArrow(count, "block long, at long, hits binary, counts binary")
    told = answers.groupBy("block").agg(F.collect_list(F.struct("at", "hits", "counts")).alias("told"))  # one entry a range

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens, owners = ungaps(row["keys"], row["tokens"]), np.frombuffer(row["owners"], np.uint16)
                own, place = np.unique(tokens, return_inverse=True)
                counts = np.zeros(len(own), np.uint32)
                for t in row["told"]:
                    counts[t["at"] + np.frombuffer(t["hits"], np.uint32).astype(np.int64)] = np.frombuffer(t["counts"], np.uint32)
                had = counts[place]
                n = np.array(row["n"], np.int64)
                common = np.bincount(owners[had > 1], minlength=len(n))
                stay = np.flatnonzero((common >= needed(n, percent)) & (n > 0))
                keep = np.zeros(len(n), bool)
                keep[stay] = True
                at = np.flatnonzero((had > 1) & keep[owners])
                at = at[np.argsort(owners[at], kind="stable")]
                ends = np.r_[0, np.cumsum(common[stay])].tolist()
                found = [(row["v"][i], int(n[i]), tokens[at[j:k]].tobytes(), had[at[j:k]].tobytes()) for i, (j, k) in zip(stay.tolist(), itertools.pairwise(ends), strict=True)]
                for k in range(0, len(found), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[k : k + 1024], strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["v", "n", "keys", "counts"])
        tidy()

    return blocks.join(told, "block").select("v", "n", "keys", "owners", "tokens", "told").mapInArrow(pick, "v binary, n long, keys binary, counts binary")


# ---------------------------------------------------------------- signatures


def bands(n: int, percent: int) -> list[int]:
    """The bands of set sizes (powers of four) that a set of n or a set that it links with is in."""
    band = lambda x: max(1, x).bit_length() // 2
    return sorted({band(-(-percent * n // 100)), band(n), band(n * 100 // percent)})


def subclasses(band: int, percent: int) -> tuple[int, int]:
    """How many subclasses the classes 2 and 3 have in a band; 0: the class does not exist.

    They lose one and two tokens each at most, all together fewer than the common tokens of the band's smallest set.
    """
    least = max(2, -(-percent * max(1, 4**band // 2) // 100))
    room = -(-percent * least // 100) - 1
    return (1, 0) if room < 8 else (room // 4, room // 4)


def signatures(n: int, keys: np.ndarray, counts: np.ndarray, percent: int, rare: int) -> list[int]:
    """Hashes of the single tokens and combinations of the prefix of a set of n tokens, of which keys are shared by counts sets."""
    order = np.lexsort((keys, counts))
    tokens, often = keys[order].tolist(), counts[order].tolist()
    loose = n - int(needed(np.int64(n), percent)) - (n - len(tokens))  # tokens of these that a link may lack
    out: list[int] = []
    for band in bands(n, percent):
        two, three = subclasses(band, percent)
        full, groups = 0, defaultdict(list)
        singles = []
        for token, c in zip(tokens, often, strict=True):
            if c < rare:
                singles.append(token)
                full += 1
            else:
                k = 3 if three and c >= rare * rare else 2
                group = groups[k, token % (three if k == 3 else two)]
                group.append(token)
                full += len(group) >= k
            if full > loose:
                break
        out += [xxhash.xxh3_64_intdigest(b"%d" % t) for t in singles]
        for (k, _), group in groups.items():
            out += [xxhash.xxh3_64_intdigest(b"%d:%d" % (band, k) + b"".join(b",%d" % t for t in sorted(c))) for c in itertools.combinations(group, k)]
    return list(set(out))


def index(sets: DataFrame, percent: int, rare: int) -> DataFrame:
    """(sig, id, n) of sets(id, n, keys, counts)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, ids, sizes = [], [], []
            for i, n, keys, counts in zip(*(b[c].to_pylist() for c in ("id", "n", "keys", "counts")), strict=True):
                own = signatures(n, np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32), percent, rare)
                sigs += own
                ids += [i] * len(own)
                sizes += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["sig", "id", "n"])

    return sets.select("id", "n", "keys", "counts").mapInArrow(make, "sig long, id long, n long")


# ---------------------------------------------------------------- verification


def links(one: int, other: int, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (one + other - common)


def verified(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among cells(cell, id, root, asks): every set that asks against all of its cell in another component.

    A cell's sets are held by one task; those that ask come first.
    """

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """rows: (id, root, asks, n, keys)."""
        n = np.array([r[3] for r in rows], np.int64)
        root = np.array([r[1] for r in rows], np.int64)
        keys = [np.frombuffer(r[4], np.uint64) for r in rows]
        every, owner = np.concatenate(keys), np.repeat(np.arange(len(rows)), [len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for i, r in enumerate(rows):
            if not r[2]:
                break
            others = (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if not others.any():
                continue
            lo, hi = np.searchsorted(every, keys[i], "left"), np.searchsorted(every, keys[i], "right")
            size = hi - lo
            at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            common = np.bincount(owner[at], minlength=len(rows))
            for j in np.flatnonzero(others & links(n[i], n, common, percent)).tolist():
                if root[j] != root[i]:  # one link of two components is enough
                    root[root == root[j]] = root[i]
                    yield r[0], rows[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, found = None, []
        for b in batches:
            for cell, *row in zip(*(b[c].to_pylist() for c in ("cell", "id", "root", "asks", "n", "keys")), strict=True):
                if cell != now and held:
                    found += compare(held)
                    held = []
                now = cell
                held.append(tuple(row))
        if held:
            found += compare(held)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
        tidy()

    whole = cells.join(sets.select("id", "n", "keys"), "id")
    return whole.repartition("cell").sortWithinPartitions("cell", F.desc("asks"), "id").select("cell", "id", "root", "asks", "n", "keys").mapInArrow(run, "a long, b long")


def cells_of_pairs(pairs: DataFrame) -> DataFrame:
    """Cells of pairs(a, b, root_a, root_b): a set b that asks, with at most TILE partners a in each."""
    dealt = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).join(pairs, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / F.lit(float(TILE)))))
    cell = F.xxhash64(F.lit("pairs"), "b", "salt").alias("cell")
    asked = dealt.select(cell, F.col("b").alias("id"), F.col("root_b").alias("root"), F.lit(True).alias("asks")).distinct()
    return asked.union(dealt.select(cell, "a", "root_a", F.lit(False)))


def similar(n: str, m: str, percent: int) -> F.Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def star_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the sets of each signature of met(sig, id, n) and the one of them whose hash is the least."""
    first = F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("b"), F.col("n").alias("n_b"))).alias("pivot")
    pivots = met.groupBy("sig").agg(first).select("sig", "pivot.b", "pivot.n_b")
    pairs = met.join(pivots, "sig").where((F.col("id") != F.col("b")) & similar("n", "n_b", percent)).select(F.col("id").alias("a"), "b").distinct()
    return verified(cells_of_pairs(pairs.withColumn("root_a", F.col("a")).withColumn("root_b", F.col("b"))), sets, percent)


def with_main(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, id, root) with the size of its key, the key's largest component (main) and that one's size (most)."""
    kinds = rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("m"))
    of = kinds.groupBy(key).agg(F.sum("m").alias("size"), F.max(F.struct("m", "root")).alias("main"))
    return rows.join(of.select(key, "size", F.col("main.root").alias("main"), F.col("main.m").alias("most")), key)


def tiles(n: F.Column) -> F.Column:
    return F.ceil(n / F.lit(float(TILE)))


def copies(size: F.Column, most: F.Column) -> F.Column:
    """Rows that the cells of a key of so many sets take, of which ``most`` are in one component."""
    return (size - most) * tiles(size) + size * tiles(size - most)


def tiled(rows: DataFrame, key: str) -> DataFrame:
    """Cells of rows(key, id, root, size, main, most): those outside of the main component ask, tile by tile, all of the key."""
    tile = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), tiles(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    rest = F.col("size") - F.col("most")
    asks = rows.where(F.col("root") != F.col("main")).select(key, tile(rest).alias("i"), F.explode(upto(tiles(F.col("size")))).alias("j"), "id", "root", F.lit(True).alias("asks"))
    told = rows.where(rest > 0).select(key, F.explode(upto(tiles(rest))).alias("i"), tile(F.col("size")).alias("j"), "id", "root", F.lit(False).alias("asks"))
    cells = asks.union(told).groupBy(key, "i", "j", "id", "root").agg(F.max("asks").alias("asks"))
    return cells.select(F.xxhash64(F.lit(key), key, "i", "j").alias("cell"), "id", "root", "asks")


def rest_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a signature of met(sig, id, n, root), not known yet.

    A set of a group of near copies meets the same sets in many large signatures.  Large signatures that
    have sets in common are one group then, in which each set is sent once for a tile, unless that takes more rows
    than tile by tile of each signature.
    """
    open_ = scratch(with_main(met, "sig").where(F.col("most") < F.col("size")), "open-signatures")
    few = open_.where(F.col("size") <= FEW)
    a, b = (few.select("sig", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
    pairs = a.join(b, "sig").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & similar("n_a", "n_b", percent)).select("a", "b", "root_a", "root_b").distinct()

    many = open_.where(F.col("size") > FEW)
    firsts = many.groupBy("sig", "size", "most").agg(F.min("id").alias("first"))
    edges = many.join(firsts.select("sig", "first"), "sig").where(F.col("id") != F.col("first")).select(F.col("id").alias("a"), F.col("first").alias("b"))
    groups = components(edges).select(F.col("v").alias("id"), F.col("root").alias("group"))
    grouped = scratch(with_main(many.select("id", "root").distinct().join(groups, "id"), "group"), "groups")
    apart = firsts.join(groups.withColumnRenamed("id", "first"), "first").groupBy("group").agg(F.sum(copies(F.col("size"), F.col("most"))).alias("apart"))
    together = grouped.select("group", copies(F.col("size"), F.col("most")).alias("rows")).distinct().join(apart, "group").where(F.col("rows") <= F.col("apart")).select("group")
    alone = many.join(groups.join(together, "group", "left_anti").select("id"), "id", "left_semi")  # a signature's sets are of one group
    cells = cells_of_pairs(pairs).union(tiled(grouped.join(together, "group"), "group")).union(tiled(alone, "sig"))
    return verified(cells, sets, percent)


# ---------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text): sets link at ``percent`` of their union or more."""
    spark = docs.sparkSession
    with batches_of(spark, BLOCK_ROWS, BLOCK_BYTES):
        blocks = scratch(blocks_of_texts(docs, shingle), "blocks", "block")
    with batches_of(spark, 64):
        near = scratch(shared_sets(blocks, percent).groupBy("v").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "shared")
        members = scratch(blocks.select(F.explode(F.arrays_zip("doc_ids", "v", "n")).alias("d")).select(F.col("d.doc_ids").alias("doc_id"), F.col("d.v").alias("v"), F.col("d.n").alias("n")), "members")
        discard(blocks)
        again = scratch(blocks_of_sets(near), "blocks", "block")
        sets = scratch(shared_sets(again, percent).select(F.monotonically_increasing_id().alias("id"), "v", "n", "keys", "counts"), "sets")
        discard(near, again)
        seen = scratch(index(sets, percent, RARE), "signatures")
        met = scratch(seen.join(seen.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("sig"), "sig"), "met")
        discard(seen)
        edges = scratch(star_links(met, sets, percent), "star-links")
        stars = components(edges).withColumnRenamed("v", "id")
        labelled = scratch(met.join(stars, "id", "left").withColumn("root", F.coalesce("root", "id")), "labelled")
        discard(met)
        edges = scratch(edges.union(rest_links(labelled, sets, percent)), "links")
        roots = components(edges)
        named = roots.join(sets.select(F.col("id").alias("v"), F.col("v").alias("of")), "v").select(F.col("of").alias("v"), "root")
        classes = scratch(class_components(members.where(F.col("v").isNotNull()), named), "classes")
    found = join_spread(members, classes, ["v"], F.col("doc_id"), classes.count(), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
