"""SentencePiece encoding and decoding by a max-plus parallel scan.

The ids are those of the model file itself, whose pieces are joined by rank (BPE): the best pair of
neighbours is joined, the leftmost of equals, until no pair is a piece.  Such an encoding is the one
path of pieces through a text on which every two neighbours are *compatible*, that is, encoded by
themselves they stay as they are.  (A join over the seam of two final pieces would need a state that
the two also pass through when they are encoded alone.)  So encoding is a max-plus problem with the
weight 0 for two compatible neighbours and minus infinity for others.

A giant document is split into chunks at any place.  The state at a border is the piece that holds
the last character before it; the pieces that can be are listed from the characters around the
border, by both of its chunks alike.  A chunk's matrix says, from each state at its begin to each at
its end, the best sum.  The matrices of a document are combined associatively (max-plus products),
which gives the states on the one path of weight 0, and each chunk is then traced back by itself.
The result does not depend on the size of chunks; a document of one chunk is the same problem with
one state at each end.

Between two *cuts*, places that no piece crosses, a segment does not depend on the rest.  If no piece
has U+2581 after another character and none a line feed (checked when the model is loaded), words are
such segments; distinct ones are encoded once, many of a length at a time.

A character with no piece becomes its UTF-8 bytes.

Defined results: a null or empty text has no tokens; decoding gives back the text, with U+2581
turned to a space as in any SentencePiece model; repeated rows and null doc_ids each keep a row;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters in a chunk; documents of more are split.
CHUNK = 1 << 14
SPACE = "▁"
#: Words that a worker remembers, twice.
_CACHE = 150_000
#: Segments of up to so many characters are encoded many at once.
_WIDE = 40
_NEG = -(1 << 62)
_NONE = np.int32(1 << 30)
State = tuple[int, int]


class Vocabulary:
    def __init__(self, proto: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(m.get_piece_size())
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        self.unk_id, self.top = m.unk_id(), m.get_piece_size()
        normal = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.span = max(map(len, normal))
        #: Symbols: pieces by their id, from ``top`` on characters that are only inside pieces, then one for all others.
        self.symbol = {p: i for p, (i, _) in normal.items()}
        for k, c in enumerate(sorted({c for p in normal for c in p} - self.symbol.keys())):
            self.symbol[c] = self.top + k
        self.other = self.top + len(self.symbol) - len(normal)
        self.text = {i: p for p, i in self.symbol.items()}
        rank = {s: k for k, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        #: (left symbol, right symbol) -> (rank, joined symbol); equal ranks go from left to right.
        self.joins = {(self.symbol[p[:k]], self.symbol[p[k:]]): (rank[s], i) for p, (i, s) in normal.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol}
        self._table()
        self.bigrams = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        self.begins = {p[:k] for p in normal for k in range(1, len(p) + 1)} | self.symbol.keys()
        self._fits: dict[State, bool] = {}
        self._stays: dict[int, bool] = {}
        #: Whether text can be cut before every U+2581 that does not follow another, and around line feeds.
        self.words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal)
        self.feed = self.one("\n")
        #: Ids, little-endian, of words without the U+2581 before them and, under a line feed and the word, of a
        #: line's first word with the line feed; and what was thrown out last.
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _table(self) -> None:
        """The joins as a hash table with linear probing, to look up many pairs at once."""
        size = 1 << max(4, (2 * len(self.joins)).bit_length())
        self.mask = size - 1
        self.key, self.rank, self.to = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        pairs = np.array([a << 32 | b for a, b in self.joins], np.int64)
        for slot, key, (rank, joined) in zip(self._slot(pairs).tolist(), pairs.tolist(), self.joins.values(), strict=True):
            while self.key[slot] >= 0:
                slot = slot + 1 & self.mask
            self.key[slot], self.rank[slot], self.to[slot] = key, rank, joined

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).view(np.int64) & self.mask

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of each pair of symbols; the rank is _NONE for none."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys.ravel()).reshape(keys.shape)
        found = self.key[slot]
        miss = np.nonzero((found != keys) & (found >= 0))
        while len(miss[0]):
            slot[miss] = slot[miss] + 1 & self.mask
            found = self.key[slot[miss]]
            go = (found != keys[miss]) & (found >= 0)
            miss = tuple(x[go] for x in miss)
        return self.rank[slot], self.to[slot]  # a search that fails ends on an empty slot

    # ------------------------------------------------------------ segments

    def symbols(self, s: str) -> list[int]:
        """The encoding of a segment in symbols: the best pair is joined, the leftmost of equals, until none is left."""
        joins, sym = self.joins, [self.symbol.get(c, self.other) for c in s]
        n = len(sym)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joins[p][0], k, *p) for k, p in enumerate(zip(sym, sym[1:], strict=False)) if p in joins]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = ahead[k]
            if sym[k] != a or j >= n or sym[j] != b:
                continue
            sym[k], sym[j] = joins[a, b][1], -1
            ahead[k] = ahead[j]
            if ahead[k] < n:
                behind[ahead[k]] = k
            for x, y in ((behind[k], k), (k, ahead[k])):
                if x >= 0 and y < n and (sym[x], sym[y]) in joins:
                    heapq.heappush(heap, (joins[sym[x], sym[y]][0], x, sym[x], sym[y]))
        return [x for x in sym if x >= 0]

    def ids(self, symbols: list[int], s: str) -> bytes:
        """Token ids of the symbols of s: characters with no piece become bytes."""
        if max(symbols, default=0) < self.top:
            return np.array(symbols, "<i4").tobytes()
        out, at = [], 0
        for x in symbols:
            if x < self.top:
                out.append(x)
                at += len(self.text[x])
            else:
                out += [self.bytes.get(b, self.unk_id) for b in s[at].encode("utf-8", "replace")] if self.bytes else [self.unk_id]
                at += 1
        return np.array(out, "<i4").tobytes()

    def one(self, s: str) -> bytes:
        return self.ids(self.symbols(s), s)

    def fill(self, words: set[str]) -> None:
        """Put the ids of distinct words into the cache; words of one length are encoded at once."""
        if len(self.cache) > _CACHE:
            self.old, self.cache = self.cache, {}
        cache, old, by = self.cache, self.old, {}
        for w in words:
            if w in old:
                cache[w] = old[w]
            else:
                by.setdefault((len(w), w[:1] == "\n"), []).append(w)
        for (n, bare), group in by.items():
            if n == 1 and bare:
                cache["\n"] = self.feed
                continue
            strings = [w[1:] for w in group] if bare else [SPACE + w for w in group]
            n += 1 - 2 * bare
            if n > _WIDE or len(group) < 8:
                found = map(self.one, strings)
            else:
                found = (x for at in range(0, len(group), 4096) for x in self.many(strings[at : at + 4096], n))
            for w, ids in zip(group, found, strict=True):
                cache[w] = self.feed + ids if bare else ids

    def many(self, group: list[str], n: int) -> list[bytes]:
        """Ids of strings of n characters: the best pair of each is joined, all strings at a time."""
        out = [b""] * len(group)
        chars = np.frombuffer("".join(group).encode("utf-32-le", "replace"), np.uint32)
        kinds, at = np.unique(chars, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), self.other) for c in kinds.tolist()], np.int32)[at].reshape(-1, n)
        rows, (rank, to) = np.arange(len(group)), self.look(sym[:, :-1], sym[:, 1:])
        while True:
            r, w = np.arange(len(rows)), sym.shape[1]
            k = rank.argmin(axis=1) if w > 1 else np.zeros(len(rows), np.int64)
            go = rank[r, k] < _NONE if w > 1 else np.zeros(len(rows), bool)
            ends = np.flatnonzero(~go)
            if len(ends):
                done = np.ascontiguousarray(sym[ends], "<i4")
                raw, odd = done.tobytes(), (done >= self.top).any(axis=1).tolist()
                for i, at in enumerate(rows[ends].tolist()):
                    out[at] = self.ids(done[i].tolist(), group[at]) if odd[i] else raw[4 * w * i : 4 * w * (i + 1)]
                if len(ends) == len(rows):
                    return out
                sym, rank, to, rows, k = sym[go], rank[go], to[go], rows[go], k[go]
                r = r[: len(rows)]
            sym[r, k] = to[r, k]
            keep = np.ones(sym.shape, bool)
            keep[r, k + 1] = False
            sym = sym[keep].reshape(len(rows), w - 1)
            keep = keep[:, 1:]
            rank, to = rank[keep].reshape(len(rows), w - 2), to[keep].reshape(len(rows), w - 2)
            for rows_of, left in ((np.flatnonzero(k > 0), -1), (np.flatnonzero(k < w - 2), 0)):
                at = k[rows_of] + left
                rank[rows_of, at], to[rows_of, at] = self.look(sym[rows_of, at], sym[rows_of, at + 1])

    def words_of(self, text: str) -> list[str]:
        """Keys of the words of a text that follows a U+2581."""
        if SPACE not in text and "  " not in text and text[:1] != " ":
            return text.replace("\n", " \n").split(" ")
        # A run of U+2581 belongs to the word after it.
        return [w if w[0] == "\n" else w[1:] for w in _RUNS.findall(SPACE + text.replace(" ", SPACE))]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; the new words of all of them are encoded at once."""
        if not self.words:
            return [self.one(SPACE + t.replace(" ", SPACE)) if t else b"" for t in texts]
        out: list[bytes] = [b""] * len(texts)
        late, lacks, get = [], set(), self.cache.get
        for n, t in enumerate(texts):
            if t:
                words = self.words_of(t)
                got = list(map(get, words))
                if None in got:
                    lacks.update([w for w, g in zip(words, got, strict=True) if g is None])
                    late.append((n, words, got))
                else:
                    out[n] = b"".join(got)
        if lacks:
            self.fill(lacks)
        now = self.cache
        for n, words, got in late:
            out[n] = b"".join([now[w] if g is None else g for w, g in zip(words, got, strict=True)])
        return out

    # ------------------------------------------------------------ chunks

    def stays(self, x: int) -> bool:
        """Whether a piece's own text is encoded as that piece; no other can be in an encoding."""
        if x not in self._stays:
            self._stays[x] = x >= self.top or self.symbols(self.text[x]) == [x]
        return self._stays[x]

    def fits(self, a: int, b: int) -> bool:
        """Whether two symbols are compatible as neighbours: weight 0, else minus infinity."""
        if a == self.other or b == self.other:
            return True
        if (a, b) not in self._fits:
            if len(self._fits) > _CACHE:
                self._fits.clear()
            self._fits[a, b] = self.symbols(self.text[a] + self.text[b]) == [a, b]
        return self._fits[a, b]

    def from_(self, s: str, p: int, end: int) -> Iterator[tuple[int, int]]:
        """(end, symbol) of what can start at p and ends by ``end``."""
        yield p + 1, self.symbol.get(s[p], self.other)
        for q in range(p + 1, min(end, p + self.span) + 1):
            t = s[p:q]
            if t not in self.begins:
                return
            x = self.symbol.get(t)
            if x is not None and q > p + 1 and self.stays(x):
                yield q, x

    def border(self, s: str, c: int) -> list[tuple[int, int, int]]:
        """States at c: (begin, end, symbol) of what can hold the character before c."""
        return [(p, q, x) for p in range(max(0, c - self.span), c) for q, x in self.from_(s, p, len(s)) if q >= c]

    def forward(self, s: str, symbol: int, begin: int, stop: int) -> dict[int, int]:
        """The last symbol of the one path of weight 0 to each place that has one, from a symbol that ends at begin."""
        last = {begin: symbol}
        for p in range(begin, stop):
            if p in last:
                a = last[p]
                for q, x in self.from_(s, p, len(s)):
                    if self.fits(a, x):
                        last[q] = x
        return last

    def path(self, last: dict[int, int], begin: int, end: int) -> list[int]:
        out = []
        while end > begin:
            x = last[end]
            out.append(x)
            end -= 1 if x == self.other else len(self.text[x])
        return out[::-1]

    def cuts(self, s: str, begin: int, end: int) -> tuple[int, int]:
        """The first and last place in [begin, end) that no piece crosses, or (-1, -1)."""
        ok = lambda c: c == 0 or s[c - 1 : c + 1] not in self.bigrams
        first = next((c for c in range(begin, end) if ok(c)), -1)
        return first, -1 if first < 0 else next(c for c in range(end - 1, begin - 1, -1) if ok(c))

    def ins(self, s: str, pad: int) -> list[tuple[int, int, int]]:
        """States at a chunk's begin: one if the document begins there."""
        return self.border(s, pad) if pad else [(0, 0, self.other)]

    def matrix(self, s: str, pad: int, size: int) -> np.ndarray:
        """Max-plus matrix of the chunk s[pad : pad + size]; s holds up to ``span`` characters more on either side."""
        ins, outs = self.ins(s, pad), self.border(s, pad + size)
        first, final = self.cuts(s, pad, pad + size)
        t = np.full((len(ins), len(outs)), _NEG, np.int64)
        if first >= 0:  # what lies between the cuts has a path from any state
            head = [first in self.forward(s, x, q, first) for _, q, x in ins]
            last = self.forward(s, self.other, final, pad + size)
            tail = [p in last and self.fits(last[p], x) for p, _, x in outs]
            t[np.ix_(head, tail)] = 0
            return t
        for i, (_, q, x) in enumerate(ins):
            last = self.forward(s, x, q, pad + size)
            t[i, [p in last and self.fits(last[p], y) for p, _, y in outs]] = 0
        return t

    def ends(self, s: str, pad: int, size: int, i: int, j: int) -> tuple[bytes, str, bytes]:
        """Of what starts in the chunk and up to the state j at its end, from state i at its begin: ids, text between cuts, ids."""
        _, begin, x = self.ins(s, pad)[i]
        p, end, y = self.border(s, pad + size)[j]
        first, final = self.cuts(s, pad, pad + size)
        if first < 0:
            found = self.path(self.forward(s, x, begin, pad + size), begin, p)
            return self.ids([*found, y], s[begin:end]), "", b""
        head = self.path(self.forward(s, x, begin, first), begin, first)
        tail = self.path(self.forward(s, self.other, final, pad + size), final, p)
        return self.ids(head, s[begin:first]), s[first:final], self.ids([*tail, y], s[final:end])

    def backtrace(self, chunks: Iterable[tuple]) -> list[bytes]:
        """Ids of chunks (s, pad, size, i, j), each by itself; the new words of all of them are encoded at once."""
        sides, rest = [], []
        for chunk in chunks:
            head, between, tail = self.ends(*chunk)
            at = between.find(SPACE) if self.words else -1
            at = at if 0 <= at < len(between) - 1 else len(between)
            sides.append((head + self.one(between[:at]), tail))
            rest.append(between[at + 1 :].replace(SPACE, " "))
        return [b"".join([head, ids, tail]) for (head, tail), ids in zip(sides, self.encode_all(rest), strict=True)]


_RUNS = re.compile(rf"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")


class Surfaces:
    """The bytes that each id stands for: all that decoding needs."""

    def __init__(self, proto: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(m.get_piece_size())
        self.of = pa.array([b"" if m.is_control(i) else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).encode() for i in ids], pa.binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids; null lists are empty."""
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        taken = self.of.take(ids.flatten())
        at = np.concatenate([[0], np.cumsum(size)])
        if len(taken):
            ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
            raw = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends[at].tobytes()), taken.buffers()[2]])
        else:
            raw = pa.array([b""] * len(ids), pa.binary())
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:  # ids of bytes that are no UTF-8
            text = pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())
        text = pc.replace_substring(text, SPACE, " ")
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, associative; _NEG stands for no path."""
    s = a[:, :, None] + b[None]
    s[(a == _NEG)[:, :, None] | (b == _NEG)[None]] = _NEG
    return s.max(axis=1, initial=_NEG)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by combining pairs first: the depth is the logarithm of the length."""
    if len(matrices) <= 1:
        return list(matrices)
    pairs = scan([times(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else times(pairs[k // 2 - 1], matrices[k]))
    return out


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """The states 0 .. n on the best path through n chunks."""
    before = scan(matrices)
    states = [0] * (len(matrices) + 1)
    states[-1] = int(before[-1][0].argmax())
    for k in range(len(matrices) - 1, 0, -1):
        row = before[k - 1][0]
        ahead = matrices[k][:, states[k + 1]]
        states[k] = int(np.where((row == _NEG) | (ahead == _NEG), _NEG, row + ahead).argmax())
    return states


_loaded: dict[tuple, Vocabulary | Surfaces] = {}


def loaded(kind: type, proto: bytes):
    """A vocabulary, or surfaces, built once in each Python worker."""
    key = kind, hashlib.md5(proto).digest()
    if key not in _loaded:
        _loaded[key] = kind(proto)
    return _loaded[key]


def vocabulary(proto: bytes) -> Vocabulary:
    return loaded(Vocabulary, proto)


def normalised(text: str | None) -> str:
    """With the model's identity normaliser: spaces become U+2581, and one is put before a text that is not empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunks_of(s: str, chunk: int, span: int) -> Iterator[tuple[int, int, str]]:
    """(pad, size, text) of the chunks of s, of at least ``span`` characters each, with ``span`` more on either side."""
    chunk = max(chunk, span)
    at = [*range(0, max(1, len(s) - span + 1), chunk), len(s)]
    for a, z in zip(at, at[1:], strict=False):
        pad = min(a, span)
        yield pad, z - a, s[a - pad : z + span]


def _ids_array(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    with open(model, "rb") as f:
        proto = f.read()
    small_batches(docs.sparkSession)
    span = vocabulary(proto).span

    @F.arrow_udf("array<int>")
    def whole(texts: pa.Array) -> pa.Array:
        v = vocabulary(proto)
        out = _ids_array(v.encode_all(texts.to_pylist()))
        tidy()
        return out

    giant = F.coalesce(F.length("text"), F.lit(0)) >= chunk
    short = docs.where(~giant).select("doc_id", whole.asNondeterministic()(F.col("text")).alias("ids"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "k", "pad", "size", "s"]
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for at in itertools.batched(enumerate(chunks_of(normalised(text), chunk, span)), 64):
                    columns = [pa.array([row] * len(at), pa.int64()), pa.array([doc_id] * len(at), pa.int64()), pa.array([k for k, _ in at], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array([c[i] for _, c in at], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]], names)

    rows = docs.where(giant).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = scratch(rows.mapInArrow(split, "row long, doc_id long, k int, pad int, size int, s string").repartition("row", "k"), "chunks")

    @F.arrow_udf("struct<n:int,path:binary>")
    def matrices(text: pa.Array, pads: pa.Array, sizes: pa.Array) -> pa.Array:
        v = vocabulary(proto)
        found = [v.matrix(*x) for x in zip(text.to_pylist(), pads.to_pylist(), sizes.to_pylist(), strict=True)]
        tidy()
        return pa.StructArray.from_arrays([pa.array([len(m) for m in found], pa.int32()), pa.array([(m == 0).tobytes() for m in found], pa.binary())], ["n", "path"])

    # A document has at most 2^31 characters, so 2^17 matrices, of about 1 kB each.
    def states(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        paths = [np.frombuffer(m["path"], bool).reshape(m["n"], -1) for m in group["m"].to_pylist()]
        found = border_states([np.where(p, 0, _NEG) for p in paths])
        return pa.table({"row": group["row"], "k": group["k"], "i": pa.array(found[:-1], pa.int32()), "j": pa.array(found[1:], pa.int32())})

    borders = chunks.select("row", "k", matrices.asNondeterministic()("s", "pad", "size").alias("m")).groupBy("row").applyInArrow(states, "row long, k int, i int, j int")

    @F.arrow_udf("array<int>")
    def traced(text: pa.Array, pads: pa.Array, sizes: pa.Array, i: pa.Array, j: pa.Array) -> pa.Array:
        v = vocabulary(proto)
        out = _ids_array(v.backtrace(zip(*(c.to_pylist() for c in (text, pads, sizes, i, j)), strict=True)))
        tidy()
        return out

    parts = chunks.join(borders, ["row", "k"]).select("row", "doc_id", "k", traced.asNondeterministic()("s", "pad", "size", "i", "j").alias("ids"))
    long = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.union(long.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "ids"))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with ``decoded``, the text of its ids."""
    with open(model, "rb") as f:
        proto = f.read()
    small_batches(encoded.sparkSession)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        out = loaded(Surfaces, proto).decode(ids)
        tidy()
        return out

    return encoded.withColumn("decoded", text.asNondeterministic()(F.col("ids")))
