"""SimHash near-duplicates, compared bit-sliced inside blocks.

A fingerprint's bit is set if it is set in over half of the shingles' hashes.  Fingerprints that can
be near meet in blocks: for a small radius r the blocks share two of r + 2 chunks of bits, which is
exact; for a similarity they share a minimum of the shingles' hashes.  In a block the fingerprints
are stored as bit planes, one big integer for each bit with a lane for each fingerprint.  One
fingerprint is compared with all lanes at once: differing planes are added two by two with a
carry-save adder into bit-sliced counters, which overflow past the radius; a row is abandoned once
every lane has overflowed.  A block gives the edges of a spanning forest, not its pairs.

Blocks of more than TILE fingerprints are compared tile by tile, and large ones are made smaller.  For
a small radius, the bits that a block does not share are cut into chunks again: two chunks of them
agree as well, so a block breaks into blocks that share ever more bits, with no pair lost.  For a
similarity, every member of a block of more than STAR_TILES tiles is first compared with one pivot;
those that link to it need no comparison with each other.  The rest is compared with all, in blocks
that share two minima if it is still large.

Components come from contracting each vertex into its neighbour of the smallest hash, by another hash
in each round, so that chains halve at least about every second round; every round is written to the
shared folder.

Defined results: null text is an empty text; an empty text has fingerprint zero and is linked like
any other; fewer words than a shingle's are one shingle; null doc_ids are never a component's id
unless all of its documents have none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hint_small, join_spread, scratch, small_batches, tidy

SEED = 42
TILE = 2048
#: Blocks of a similarity search of more tiles than this are starred; below it, tiles copy a row less often than a star costs.
STAR_TILES = 16
#: Whole sets of a group of doubtful pairs are compared so many values at a time (16 MB).
SET_VALUES = 1 << 21
#: Of the pipeline's stage: words in a shingle, bits, similarity, bits that may differ before the exact
#: check (at a Jaccard similarity of 0.8 a bit differs with probability 0.15, and at most 0.1875, of 4
#: and 5 shingles, so that 88 bits are six deviations off), block keys (all differ once in ten million), sketch.
#: A sketch's similarity is within "sure" (six standard errors) of the sets'; nearer to the bound the
#: whole sets decide.  Of cut sketches the values in common, over all in either, are 0.66 at least at a
#: similarity of 0.8 (one set a part of the other), and never under "hopeless" (seven standard errors).
STAGE = {"sure": 0.106, "hopeless": 0.5, "shingle": 5, "bits": 256, "similarity": 0.8, "radius": 88, "keys": 10, "sketch": 512}


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the whole text, A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)  # noqa: B905


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of hashes (the finaliser of splitmix64)."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, bits: int = 64) -> bytes:
    """Big-endian; bit i of the j-th word from the right is that of the j-th hash."""
    out = []
    for k in range(bits // 64):
        x = h if k == 0 else mix(h, k)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            part = x[at : at + (1 << 16)]
            ones += np.add.reduce(np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint32)
        out.append(np.packbits(2 * ones > len(x)).tobytes())
    return b"".join(reversed(out))


# ---------------------------------------------------------------- comparing inside a block


def planes(fps: list[bytes]) -> list[int]:
    """Bit planes: the integer of a bit has a lane for each fingerprint, the first in the lowest place."""
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in packed]


def within(row: list[int], vertical: list[int], radius: int, done: int, full: int) -> int:
    """Lanes not in ``done`` that differ from the row in at most ``radius`` bits; row holds 0 or ``full`` for each bit."""
    width = (radius + 1).bit_length() if radius else 1
    start = (1 << width) - 1 - radius
    counter = [full if start >> i & 1 else 0 for i in range(width)]
    over = done
    for i in range(0, len(vertical) - 1, 2):
        a, b = vertical[i] ^ row[i], vertical[i + 1] ^ row[i + 1]
        low = counter[0]
        u = low ^ a
        carry = (low & a) | (u & b)
        counter[0] = u ^ b
        for k in range(1, width):
            if not carry:
                break
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if over == full:
            return 0
    return full & ~over


def compare(rows: list[bytes], lanes: list[bytes] | None, radius: int, agree=None, doubts: list | None = None) -> Iterator[tuple[int, int]]:
    """Edges (row, lane) of a spanning forest of the links; within the rows themselves if lanes is None.

    ``agree(i)`` says of each lane whether it links with row i (1), not (0), or in doubt (2).  Rows and lanes
    that doubtful pairs connect go to ``doubts`` as a group, a list of (is a lane, place), so that they take a place
    each and not one for each pair.  Lanes that are already in a row's component are skipped.
    """
    own = lanes is None
    lanes = rows if own else lanes
    full = (1 << len(lanes)) - 1
    vertical = planes(lanes)
    bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1).astype(bool)
    n = len(lanes)
    parent = list(range(n if own else n + len(rows)))
    members = [1 << i for i in range(n)] + [0] * (len(parent) - n)  # lanes of each root's component
    open_: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        me = i if own else n + i
        done = members[find(me)] | ((1 << i) - 1 if own else 0)
        if done == full:
            continue
        row = [full if x else 0 for x in bits[i].tolist()]
        near = within(row, vertical, radius, done, full)
        unsure = 0
        if near and agree is not None:
            says, mask = agree(i), _lanes(near, n)
            near, unsure = _bits(mask & (says == 1)), _bits(mask & (says == 2))
        while near:
            j = (near & -near).bit_length() - 1
            yield i, j
            a, b = find(me), find(j)
            parent[b] = a
            members[a] |= members[b]
            near &= ~members[a]
        if unsure:
            open_.append((i, unsure))
    if not open_:
        return
    # Pairs that a link joins need no telling; of the others the groups that they connect.
    sure = [members[find(i if own else n + i)] for i, _ in open_]
    parent[:], members[:] = range(len(parent)), [1 << i for i in range(n)] + [0] * (len(parent) - n)
    touched = set()
    for (i, unsure), known in zip(open_, sure, strict=True):
        me = i if own else n + i
        left = unsure & ~known
        if left:
            touched.add(me)
        left &= ~members[find(me)]
        while left:
            j = (left & -left).bit_length() - 1
            touched.add(j)
            a, b = find(me), find(j)
            parent[b] = a
            members[a] |= members[b]
            left &= ~members[a]
    groups: dict[int, list[tuple[bool, int]]] = {}
    for x in sorted(touched):
        groups.setdefault(find(x), []).append((x < n, x if x < n else x - n))
    doubts += groups.values()


def _lanes(mask: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little").astype(bool)


def _bits(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


class Overlap:
    """How many values the sketch of a row has in common with each lane's, by lists of the lanes that have a value."""

    def __init__(self, lanes: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in lanes])
        flat = np.concatenate(lanes) if lanes else np.empty(0, np.uint32)
        order = np.argsort(flat, kind="stable")
        self.flat, self.lane = flat[order], np.repeat(np.arange(len(lanes)), self.sizes)[order]

    def common(self, row: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.flat, row, "left"), np.searchsorted(self.flat, row, "right")
        hit = np.flatnonzero(b > a)
        if not len(hit):
            return np.zeros(len(self.sizes), np.int64)
        size = b[hit] - a[hit]
        at = np.repeat(a[hit] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.lane[at], minlength=len(self.sizes))


# ---------------------------------------------------------------- blocks, edges, components


def shared_pairs(key: Column, rest: Column, digits: int, radius: int) -> Column:
    """Blocks of an exact search: two of radius + 2 chunks of the rest agree in near fingerprints.

    ``rest`` holds ``digits`` hex digits; each block is (key, rest), the rest without the two chunks.
    """
    size = digits // (radius + 2)
    part = lambda i: F.substring(rest, i * size + 1, size)
    blocks = []
    for k, (i, j) in enumerate(itertools.combinations(range(radius + 2), 2)):
        others = [part(x) for x in range(radius + 2) if x not in (i, j)]
        blocks.append(F.struct(F.concat(key, F.lit(f"{k}:"), part(i), part(j)).alias("key"), (F.concat(*others) if others else F.lit("")).alias("rest")))
    return F.array(*blocks)


def exact_blocks(vertices: DataFrame, bits: int, radius: int) -> DataFrame:
    """v, fp, key, far, n_near, n_far of blocks in which all fingerprints v that differ in up to ``radius`` bits meet."""
    digits, out = bits // 4, None
    if digits % (radius + 2):
        raise ValueError("the chunks must be whole hex digits")
    rows = vertices.select("v", F.lit("").alias("key"), F.hex("v").alias("rest"))
    while True:
        keyed = rows.select("v", F.explode(shared_pairs(F.col("key"), F.col("rest"), digits, radius)).alias("b")).select("v", "b.key", "b.rest")
        sizes = scratch(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "blocks")
        digits -= 2 * (digits // (radius + 2))
        more = digits >= radius + 2 and digits % (radius + 2) == 0 and not sizes.where(F.col("n") > TILE).isEmpty()
        held = keyed.join(sizes, "key")
        here = held.where(F.col("n") <= TILE) if more else held
        here = here.select("v", F.col("v").alias("fp"), "key", F.lit(False).alias("far"), F.col("n").alias("n_near"), F.lit(0).cast("long").alias("n_far"))
        out = here if out is None else out.unionByName(here)
        if not more:
            return out
        rows = scratch(held.where(F.col("n") > TILE).select("v", "key", "rest"), "hot")


def similar_blocks(vertices: DataFrame, radius: int, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """(blocks, star edges): v, key, far, n_near, n_far of blocks in which vertices with a common minimum meet.

    In a block of more than STAR_TILES tiles, ``far`` tells those that link to its pivot: they are not compared with each other.
    """
    spark = vertices.sparkSession
    keyed = vertices.select("v", F.explode("keys").alias("key"))
    sizes = scratch(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("v").alias("h"), "v"))["v"].alias("pivot")).where("n > 1"), "blocks")
    none = F.lit(0).cast("long")
    most = TILE * STAR_TILES
    plain = keyed.join(sizes.where(F.col("n") <= most), "key").select("v", "key", F.lit(False).alias("far"), F.col("n").alias("n_near"), none.alias("n_far"))
    hot = sizes.where(F.col("n") > most)
    n_hot = hot.count()
    if not n_hot:
        return plain, None

    @F.arrow_udf("int")
    def linked(fp: pa.Array, sketch: pa.Array, pivot_fp: pa.Array, pivot_sketch: pa.Array) -> pa.Array:
        out = []
        for a, x, b, y in zip(fp.to_pylist(), sketch.to_pylist(), pivot_fp.to_pylist(), pivot_sketch.to_pylist(), strict=True):
            near = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= radius
            out.append(verdict(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) if near else 0)
        return pa.array(out, pa.int32())

    small_batches(spark)
    size = 4 * STAGE["sketch"] + 100
    pivots = scratch(hot.select("key", F.col("pivot").alias("v")).join(vertices.select("v", "fp", "sketch"), "v").select("key", F.col("v").alias("pivot"), F.col("fp").alias("p_fp"), F.col("sketch").alias("p_sketch")), "pivots")
    members = keyed.join(hint_small(hot.select("key"), n_hot), "key", "left_semi").join(vertices.select("v", "fp", "sketch"), "v")
    judged = join_spread(members, pivots, ["key"], F.col("v"), n_hot, row_bytes=size)
    star = scratch(judged.select("v", "key", "pivot", linked.asNondeterministic()("fp", "sketch", "p_fp", "p_sketch").alias("says")), "star")
    linked_ = star.where((F.col("says") > 0) & (F.col("v") != F.col("pivot")))
    edges = linked_.where("says = 1").select(F.col("pivot").alias("a"), F.col("v").alias("b"), F.lit(True).alias("sure"))
    # In doubt, a vertex and the pivot are a group of two.
    both = linked_.where("says = 2").select(F.explode(F.array("pivot", "v")).alias("a"), F.unhex(F.md5(F.concat(F.least("pivot", "v"), F.greatest("pivot", "v")))).alias("b"))
    edges = edges.union(both.withColumn("sure", F.lit(False)))
    far = F.col("says") == 1
    counts = [F.count_if(~F.col("far")).alias("n_near"), F.count_if(F.col("far")).alias("n_far")]
    told = star.select("v", "key", far.alias("far"))
    left = scratch(told.groupBy("key").agg(*counts).where("n_near > 0"), "left")
    n_left = left.count()
    # The rest of a block is small: it meets the whole block.
    first = join_spread(told, left.where(F.col("n_near") <= most), ["key"], F.col("v"), n_left).select("v", "key", "far", "n_near", "n_far")
    # It is large: it meets those that share another minimum as well.
    wide = join_spread(told, left.where(F.col("n_near") > most).select("key"), ["key"], F.col("v"), n_left).join(vertices.select("v", "keys"), "v")
    pair = F.explode(F.transform(F.filter("keys", lambda k: k != F.col("key")), lambda k: F.concat("key", k))).alias("key")
    wide = wide.select("v", "far", pair)
    second = wide.join(wide.groupBy("key").agg(*counts).where("n_near > 0 AND n_near + n_far > 1"), "key").select("v", "key", "far", "n_near", "n_far")
    return plain.unionByName(first).unionByName(second), edges


def verdict(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Of two sketches: 1 if they link, 0 if not, 2 if only the whole sets can tell."""
    s = jaccard(a, b)
    if max(len(a), len(b)) >= STAGE["sketch"] and abs(s - similarity) <= STAGE["sure"]:
        return 2
    return int(s >= similarity)


def forest(vertices: DataFrame, blocks: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """Edges (a, b) between vertices(v binary, fp binary[, sketch binary]) that link and meet in a block.

    Vertices are distinct.  With a similarity, a pair within the radius links if the sketches agree;
    a third column says whether they tell for sure.  Where they do not, a is a vertex and b the group of those
    that only whole sets can tell from each other: a row for each vertex in a block, not for each pair.
    """
    small_batches(vertices.sparkSession)
    checked = similarity is not None
    extra = ["sketch"] if checked else []
    carried = [] if checked else ["fp"]
    tiles = lambda n: F.ceil(F.col(n) / F.lit(float(TILE)))
    many = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    t, near, far = F.col("tile"), tiles("n_near"), tiles("n_far")
    cell = lambda lo, hi, kind: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(kind).alias("far"))
    with_near = F.transform(many(near), lambda o: cell(F.least(t, o), F.greatest(t, o), False))
    with_far = F.when(far > 0, F.transform(many(F.greatest(far, F.lit(1))), lambda o: cell(t, o, True))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint,far:boolean>>"))
    at = F.when(F.col("far"), F.transform(many(near), lambda o: cell(o, t, True))).otherwise(F.concat(with_near, with_far))
    cells = (
        blocks.withColumn("tile", F.pmod(F.xxhash64("v"), F.when(F.col("far"), far).otherwise(near)))
        .select("v", *carried, "key", "tile", "far", F.explode(at).alias("at"))
        .select("v", *carried, F.xxhash64("key", "at").alias("cell"), "key", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), F.col("at.far").alias("with_far"), "far", "tile")
    )
    if checked:
        cells = cells.join(vertices.select("v", "fp", *extra), "v")
    ordered = cells.repartition("cell").sortWithinPartitions("cell", "key", "lo", "hi", "v")

    def link(group: list[dict]) -> Iterator[tuple]:
        lo, hi, mixed = group[0]["lo"], group[0]["hi"], group[0]["with_far"]
        own = lo == hi and not mixed
        first = group if own else [r for r in group if not r["far"] and r["tile"] == lo]
        second = first if own else [r for r in group if r["far"] == mixed and r["tile"] == hi]
        if not first or not second or len(group) < 2:
            return
        agree, doubts = None, []
        if checked:
            mine = [np.frombuffer(r["sketch"], np.uint32) for r in first]
            others = mine if own else [np.frombuffer(r["sketch"], np.uint32) for r in second]
            overlap, most = Overlap(others), STAGE["sketch"]

            def agree(i: int) -> np.ndarray:
                a, common = mine[i], overlap.common(mine[i])
                alike = common / np.maximum(1, len(a) + overlap.sizes - common)
                out = (alike >= similarity).astype(np.int8)  # exact for whole sets
                cut = (len(a) >= most) | (overlap.sizes >= most)
                out[cut] = 0
                for j in np.flatnonzero(cut & (alike >= STAGE["hopeless"])).tolist():
                    out[j] = verdict(a, others[j], similarity)
                return out

        sure = (True,) if checked else ()
        for i, j in compare([r["fp"] for r in first], None if own else [r["fp"] for r in second], radius, agree, doubts):
            yield first[i]["v"], second[j]["v"], *sure
        for places in doubts:
            vs = sorted((second if lane else first)[i]["v"] for lane, i in places)
            name = xxhash.xxh3_128_digest(b"".join(vs))  # the same in every block in which they meet
            for v in vs:
                yield v, name, False

    kinds = {"a": pa.binary(), "b": pa.binary()} | ({"sure": pa.bool_()} if checked else {})

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    names = ["v", "fp", *extra, "tile", "far", "lo", "hi", "with_far", "cell", "key"]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in ("cell", "key", "lo", "hi", "with_far")):
                    out += link(held)
                    held = []
                held.append(row)
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if held:
            out += link(held)
        yield batch_of(out)

    return ordered.select(*names).mapInArrow(edges, "a binary, b binary, sure boolean" if checked else "a binary, b binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of the sets whose smallest values a and b hold, sorted: exact if both are whole sets."""
    k = STAGE["sketch"]
    both = np.union1d(a, b)
    if max(len(a), len(b)) >= k:
        both = both[: max(1, min(k, len(both)))]
    shared = np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)
    return len(shared) / max(1, len(both))


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex of edges(a, b) and one vertex of its component."""
    edges = scratch(edges.distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
        order = lambda c, k=len(maps): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("u"))
        step = scratch(both.groupBy("v").agg(F.min(order("u")).alias("least")).select("v", F.least("least", order("v"))["u"].alias("p")), "contract")
        maps.append(step)
        moved = edges.join(step.withColumnRenamed("v", "a").withColumnRenamed("p", "pa"), "a").join(step.withColumnRenamed("v", "b").withColumnRenamed("p", "pb"), "b")
        before, edges = edges, scratch(moved.where(F.col("pa") != F.col("pb")).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(before)
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = maps[-1].withColumnRenamed("p", "root")
    for n, step in enumerate(reversed(maps[:-1])):
        before, found = found, scratch(step.join(found.select(F.col("v").alias("p"), "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root")), "roots")
        discard(before if n else maps[-1], step)
    return found


def class_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, component_id) for the classes of members(doc_id, v) that have more than one document or a link."""
    classes = members.groupBy("v").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = classes.join(roots, "v", "left")
    linked = joined.where(F.col("root").isNotNull())
    least = scratch(linked.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    return join_spread(linked, least, ["root"], F.col("v"), least.count()).select("v", "component_id").union(joined.where(F.col("root").isNull() & (F.col("n") > 1)).select("v", "least"))


# ---------------------------------------------------------------- the operators


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint v of every whole text."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in texts], pa.binary())

    return docs.select("doc_id", fp.asNondeterministic()(F.col("text")).alias("v"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: fingerprints link at ``radius`` bits or fewer, exactly."""
    members = scratch(fingerprints(docs, shingle), "fingerprints")
    vertices = members.select("v").distinct()
    classes = scratch(class_components(members, components(forest(vertices, exact_blocks(vertices, 64, radius), radius))), "classes")
    return join_spread(members, classes, ["v"], F.col("doc_id"), classes.count(), "left").select("doc_id", F.lower(F.hex("v")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5 and, over the stage's distinct shingles: v (of the words), fp, keys, sketch (smallest hashes, sorted)."""
    small_batches(docs.sparkSession)
    n, bits, k, s = STAGE["shingle"], STAGE["bits"], STAGE["keys"], STAGE["sketch"]

    @F.arrow_udf("struct<v:binary,fp:binary,keys:array<binary>,sketch:binary>")
    def sign(texts: pa.Array) -> pa.Array:
        v, fp, keys, sketch = [], [], [], []
        for t in texts:
            text = t.as_py()
            h = np.unique(shingle_hashes(text, n))  # distinct, as the similarity is
            v.append(xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "replace").lower().split())))
            fp.append(fingerprint(h, bits))
            keys.append([bytes([i]) + int(mix(h, 100 + i).min()).to_bytes(8, "big") for i in range(k)] if len(h) else [])
            small = np.unique((mix(h, 99) >> np.uint64(32)).astype(np.uint32))
            sketch.append(small[:s].tobytes())
        tidy()
        return pa.StructArray.from_arrays([pa.array(v, pa.binary()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.binary())), pa.array(sketch, pa.binary())], ["v", "fp", "keys", "sketch"])

    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), sign.asNondeterministic()(F.col("text")).alias("s")).select("doc_id", "text_md5", "s.*")


def verified(docs: DataFrame, signed: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links within groups(v, group, root), of vertices of different roots.

    The whole sets of shingles, made anew of the texts, decide.  A group of more than SET_VALUES shingles is compared part by part.
    """
    n = STAGE["shingle"]

    @F.arrow_udf("binary")
    def whole(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_py(), n)).tobytes() for t in texts], pa.binary())

    needed = groups.select("v").distinct()
    # One text for each v; texts of the same words have the same shingles.
    texts = scratch(signed.join(needed, "v").groupBy("v").agg(F.min("text_md5").alias("text_md5")), "doubtful")
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_md5", F.md5("text")).join(hint_small(texts, texts.count()), "text_md5")
    sets = scratch(found.select("v", whole.asNondeterministic()(F.col("text")).alias("s")).dropDuplicates(["v"]), "sets")
    sized = groups.join(sets.select("v", F.length("s").alias("bytes")), "v")
    parts = sized.groupBy("group").agg(F.greatest(F.ceil(F.sum("bytes") / F.lit(8.0 * SET_VALUES)), F.lit(1).cast("long")).alias("parts"))
    t = F.pmod(F.xxhash64("v"), F.col("parts"))
    cells = groups.join(parts, "group").withColumn("part", t)
    cells = cells.select("v", "root", "group", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("o"))
    cells = cells.select("v", "root", "group", "part", F.least("part", "o").alias("lo"), F.greatest("part", "o").alias("hi")).join(sets, "v")
    ordered = cells.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "v")

    def link(held: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        lo, hi = held[0]["lo"], held[0]["hi"]
        rows = [r for r in held if r["part"] == lo]
        lanes = rows if lo == hi else [r for r in held if r["part"] == hi]
        if not rows or not lanes or len(held) < 2:
            return
        names: dict[bytes, int] = {}
        mine, others = (np.array([names.setdefault(r["root"], len(names)) for r in side]) for side in (rows, lanes))
        comp = np.arange(len(names))
        sets = [np.frombuffer(r["s"], np.uint64) for r in rows]
        overlap = Overlap(sets if lo == hi else [np.frombuffer(r["s"], np.uint64) for r in lanes])
        for i, a in enumerate(sets):
            apart = comp[others] != comp[mine[i]]
            if not apart.any():
                continue
            common = overlap.common(a)
            near = apart & (common / np.maximum(1, len(a) + overlap.sizes - common) >= similarity)
            for j in np.flatnonzero(near).tolist():
                x, y = comp[mine[i]], comp[others[j]]
                if x != y:
                    yield rows[i]["v"], lanes[j]["v"]
                    comp[comp == y] = x

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in ("group", "lo", "hi")):
                    out += link(held)
                    held = []
                held.append(row)
            yield _pairs(out)
        if held:
            yield _pairs(link(held))

    return ordered.mapInArrow(edges, "a binary, b binary")


def _pairs(out: Iterable[tuple[bytes, bytes]]) -> pa.RecordBatch:
    rows = list(out)
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in rows], pa.binary()) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): the stage's signatures, and component_id of the classes of more than one document."""
    signed = scratch(signatures(docs), "signatures")
    # One vertex for each distinct sequence of words; copies need no comparison.
    vertices = signed.select("v", "fp", "keys", "sketch").dropDuplicates(["v"])
    vertices = scratch(vertices, "vertices")
    blocks, star = similar_blocks(vertices, STAGE["radius"], STAGE["similarity"])
    links = forest(vertices, blocks, STAGE["radius"], STAGE["similarity"])
    links = scratch(links if star is None else links.union(star), "links")
    sure = links.where("sure").select("a", "b")
    roots = components(sure)
    # Groups whose vertices are not of one component already.
    groups = links.where("NOT sure").select(F.col("a").alias("v"), F.col("b").alias("group")).distinct()
    groups = scratch(groups.join(roots, "v", "left").select("v", "group", F.coalesce("root", "v").alias("root")), "groups")
    apart = groups.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("group")
    doubts = scratch(groups.join(apart, "group", "left_semi"), "doubts")
    if not doubts.isEmpty():
        roots = components(sure.union(verified(docs, signed, doubts, STAGE["similarity"])))
    return signed, scratch(class_components(signed.select("doc_id", "v"), roots), "classes")


def _row_key(doc_id: Column, text_md5: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_md5)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: that with the smallest doc_id.

    Of a group without doc_ids the smallest text digest stays, and of wholly equal rows one row.
    """
    key = "__pagewarden_key"
    signed, classes = near_duplicates(docs)
    rows = join_spread(signed.select("doc_id", "text_md5", "v"), classes, ["v"], F.struct("doc_id", "text_md5"), classes.count())
    rows = rows.select("doc_id", "text_md5", F.coalesce(F.col("component_id").cast("string"), F.hex("v")).alias("gid"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    first = scratch(rows.groupBy("gid").agg(F.min(order).alias("w")), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("text_md5") == F.col("w.text_md5"))
    held = join_spread(rows, first, ["gid"], F.struct("doc_id", "text_md5"), first.count())
    gone = scratch(held.where(~stays).select(_row_key(F.col("doc_id"), F.col("text_md5")).alias(key)).distinct(), "gone")
    again = scratch(signed.groupBy(_row_key(F.col("doc_id"), F.col("text_md5")).alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    keyed = docs.withColumn(key, _row_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))))
    kept = keyed.join(hint_small(gone, gone.count()), key, "left_anti")
    repeats = again.count()
    if repeats:
        small = hint_small(again, repeats)
        one = kept.join(small, key, "left_semi").groupBy(key).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
        return kept.join(small, key, "left_anti").select(*docs.columns).union(one)
    return kept.select(*docs.columns)
