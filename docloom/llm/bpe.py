"""Byte-level BPE: pre-tokenisation by class arrays and scans of transition functions, cached pair merging, and decoding.

The slices are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
found without a regex engine. Each code point has a class, each class a transition function between the states of a small automaton. Functions
compose associatively, so the states at all positions of a batch of texts come from a blocked prefix scan over function numbers and one table of
products. A slice starts where (state before, class, class of the next code point) says so.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.common import tidy

# Letters and numbers of Unicode 16 that an older unicodedata does not know, as the common BPE libraries class them.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# The white space of the Unicode property White_Space.
SPACES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

# Classes: letters that a contraction can hold (by what must follow), other letters, numbers, apostrophe, others, space, other white space; and no character.
ONE, RV, E, EL, LETTER, NUMBER, QUOTE, OTHER, SPACE, WHITE, NONE = range(11)
# States: start of a slice, in letters, in numbers, in others, after a space, after other white space, after an opening apostrophe, after 'r or 'v, after 'l.
START, IN_L, IN_N, IN_O, AT_S, AT_W, AT_Q, AT_R, AT_K = range(9)

CHUNK_BYTES = 1 << 18
BLOCK = 256
#: Slices held by each of the two generations of a worker's cache.
CACHE = 150_000


@functools.cache
def code_point_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k is not None:
            table[c] = k
    for ranges, k in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER), (SPACES, WHITE)):
        for a, b in ranges:
            table[a : b + 1] = k
    for chars, k in (("stmd", ONE), ("rv", RV), ("e", E), ("l", EL), ("'", QUOTE), (" ", SPACE)):
        for x in chars:
            table[ord(x)] = k
    return table


def _moves(c: int) -> tuple[int, ...]:
    """The transition function of a class: the state after it, for each state before."""
    if c == QUOTE:
        return tuple(IN_O if s in (IN_O, AT_S, AT_Q) else AT_Q for s in range(9))
    plain = {NUMBER: IN_N, OTHER: IN_O, SPACE: AT_S, WHITE: AT_W}.get(c, IN_L)
    out = [plain] * 9
    for before, needs, then in ((AT_Q, ONE, START), (AT_Q, RV, AT_R), (AT_Q, EL, AT_K), (AT_R, E, START), (AT_K, EL, START)):
        if c == needs:
            out[before] = then
    return tuple(out)


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, and behind them of the same at a text's start; products of functions; state by function and state; slice starts)."""
    identity = tuple(range(9))
    single = [_moves(c) for c in range(10)] + [(_moves(c)[START],) * 9 for c in range(10)]
    found = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in single:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    functions = list(found)
    assert len(functions) <= 256
    product = np.zeros((256, 256), np.uint8)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            product[i, j] = found[tuple(g[x] for x in f)]
    apply = np.zeros((256, 9), np.uint8)
    apply[: len(functions)] = functions
    starts = np.zeros((9, 10, 11), bool)
    for s in range(9):
        for c in range(10):
            for n in range(11):
                if c <= LETTER:
                    opened = s == AT_Q and (c == ONE or c == RV and n == E or c == EL and n == EL)
                    starts[s, c, n] = s in (START, IN_N, IN_O, AT_W) or s == AT_Q and not opened
                elif c == NUMBER:
                    starts[s, c, n] = s not in (IN_N, AT_S)
                elif c in (QUOTE, OTHER):
                    starts[s, c, n] = s not in (IN_O, AT_Q, AT_S)
                else:
                    starts[s, c, n] = s not in (AT_S, AT_W) or n not in (SPACE, WHITE, NONE)
    return np.array([found[f] for f in single], np.uint8), product.ravel(), apply.ravel(), starts.ravel()


def _scan(f: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of function numbers: within blocks side by side, then over the blocks' totals."""
    n = len(f)
    if n <= 2 * BLOCK:
        out, step = f.astype(np.uint16), 1
        while step < n:
            out[step:] = product[(out[:-step] << 8) | out[step:]]
            step *= 2
        return out.astype(np.uint8)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = product[(grid[j - 1].astype(np.uint16) << 8) | grid[j]]
    before = np.zeros(blocks, np.uint16)
    before[1:] = _scan(grid[-1], product)[:-1]
    return product[(before << 8)[None, :] | grid].T.ravel()[:n]


def slice_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions of code points at which a slice starts. firsts: positions at which a text starts, 0 among them."""
    number, product, apply, starts = automaton()
    cls = code_point_classes()[points]
    following = np.empty_like(cls)
    following[:-1] = cls[1:]
    following[-1] = NONE
    following[firsts[1:] - 1] = NONE
    first = np.zeros(len(cls), np.uint8)
    first[firsts] = 10
    scanned = _scan(number[cls + first], product)
    state = np.empty(len(cls), np.uint16)
    state[1:] = apply[scanned[:-1].astype(np.uint16) * 9]  # from START, the state before the first text
    state[firsts] = START
    return np.flatnonzero(starts[(state * 10 + cls) * 11 + following])


class Vocabulary:
    """Ranks of byte strings, merging and decoding."""

    def __init__(self, path: str, content: bytes | None = None):
        """content: that of the file, where it is not at hand."""
        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        lines = [x.split() for x in content.splitlines() if x]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for w, i in self.ranks.items():
            words[i] = w
        self.words = words
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.young: dict[bytes, list[int]] = {}
        self.old: dict[bytes, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one slice: the adjacent pair of lowest rank is joined, the left one first, until none has a rank."""
        rank = self.ranks.get(word)
        if rank is not None:
            return [rank]
        if len(word) > 200:
            return self._merge_long(word)
        get = self.ranks.get
        none = sys.maxsize
        cut = list(range(len(word) + 1))
        pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            del cut[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(word[cut[i] : cut[i + 2]], none)
            if i:
                pairs[i - 1] = get(word[cut[i - 1] : cut[i + 1]], none)
        ranks = self.ranks
        return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same by a heap and linked parts: n log n for a slice of any length."""
        n, get = len(word), self.ranks.get
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop):
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                k = after[i]
                if (r := get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            h = before[i]
            if h >= 0 and (r := get(word[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, i, end[i]))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def missing(self, word: bytes) -> list[int]:
        """For a slice that is not in the young cache: from the old one, or merged."""
        ids = self.old.get(word)
        if ids is None:
            ids = self.merge(word)
        if len(word) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of the given sizes in bytes, one behind the other -> (ids of all, number of ids of each text). No text is empty."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(width)))
        text_at = np.concatenate(([0], np.cumsum(sizes)))
        firsts = np.searchsorted(offset, text_at[:-1])
        at = slice_starts(points, firsts)
        begin = offset[at].tolist()
        finish = begin[1:] + [len(data)]
        ids: list[int] = []
        counts = []
        slices = np.searchsorted(at, np.append(firsts, len(points))).tolist()
        for a, b in zip(slices, slices[1:]):
            had = len(ids)
            get = self.young.get
            for x, y in zip(begin[a:b], finish[a:b]):
                w = data[x:y]
                got = get(w)
                if got is None:
                    got = self.missing(w)
                    get = self.young.get
                ids += got
            counts.append(len(ids) - had)
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one behind the other."""
        size = self.sizes[ids]
        stop = np.cumsum(size)
        if not len(ids) or not stop[-1]:
            return b""
        shift = np.repeat(self.at[ids] - (stop - size), size)
        return self.bytes[shift + np.arange(stop[-1])].tobytes()


class Shipped:
    """A vocabulary file, sent along with the job, so executors need not have it at the driver's path; a worker keeps the last two by their contents."""

    kept: dict[str, Vocabulary] = {}

    def __init__(self, df: DataFrame, path: str):
        with open(path, "rb") as f:
            content = f.read()
        self.digest = hashlib.sha256(content).hexdigest()
        self.content = df.sparkSession.sparkContext.broadcast(content)  # some MB

    def vocabulary(self) -> Vocabulary:
        if self.digest not in Shipped.kept:
            while len(Shipped.kept) > 1:
                Shipped.kept.pop(next(iter(Shipped.kept)))
            Shipped.kept[self.digest] = Vocabulary("", self.content.value)
        return Shipped.kept[self.digest]


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(row numbers, their texts one behind the other, sizes), without null and empty texts, CHUNK_BYTES each or one longer text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    i = 0
    while i < len(full):
        stop = int(np.searchsorted(offsets[full + 1], offsets[full[i]] + CHUNK_BYTES, "right"))
        stop = max(stop, i + 1)
        rows = full[i:stop]
        yield rows, bytes(data[offsets[rows[0]] : offsets[rows[-1] + 1]]), sizes[rows]
        i = stop


def _decoded(vocabulary: Vocabulary, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes that each row's ids decode to."""
    byte_ends = np.concatenate(([0], np.cumsum(vocabulary.sizes[flat])))[ends]
    pieces = [vocabulary.decode(flat[k : k + CHUNK_BYTES]) for k in range(0, len(flat), CHUNK_BYTES)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(byte_ends.astype(np.int64)), pa.py_buffer(b"".join(pieces))]).cast(pa.binary())


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = "offsets", decoded: str | None = None) -> DataFrame:
    """The rows of df with `ids` array<int> and `offsets` array<long>, the first byte of each token in the text's UTF-8 form (None: left out).

    decoded: a column for the bytes that the ids decode to again, as decode_ids gives them but in the same pass and the same Python workers.

    path: a file of base64 byte strings with ranks. Every text is encoded whole, as many slices as it has; special tokens have no meaning.
    Null and empty texts: empty arrays. Columns of df with these names are replaced. Rows map one to one; nothing is shuffled.
    """
    shipped = Shipped(df, path)
    keep = [c for c in df.columns if c.lower() not in (ids.lower(), (offsets or ids).lower(), (decoded or ids).lower())]
    base = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(offsets, T.ArrayType(T.LongType(), False), False)] if offsets else []) + ([T.StructField(decoded, T.BinaryType(), False)] if decoded else []))
    at = keep.index(next(c for c in keep if c.lower() == text.lower()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.vocabulary()
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            parts = []
            for rows, data, sizes in _chunks(batch.column(at)):
                got, n = vocabulary.encode(data, sizes)
                counts[rows] = n
                parts.append(got)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if offsets:
                size = vocabulary.sizes[flat]
                begin = np.cumsum(size) - size
                heads = np.repeat(begin[np.minimum(ends[:-1], max(len(flat) - 1, 0))] if len(flat) else np.zeros(batch.num_rows, np.int64), counts)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(begin - heads)))
            if decoded:
                columns.append(_decoded(vocabulary, flat, ends))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(tidy(run), schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows of df with `decoded` binary, the bytes of the ids. Null or empty ids: no bytes. A column of that name is replaced."""
    shipped = Shipped(df, path)
    keep = [c for c in df.columns if c.lower() != decoded.lower()]
    base = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*base.schema.fields, T.StructField(decoded, T.BinaryType(), False)])
    at = keep.index(next(c for c in keep if c.lower() == ids.lower()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.vocabulary()
        for batch in batches:
            column = batch.column(at)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(vocabulary, flat, ends)], names=[*batch.schema.names, decoded])

    return base.mapInArrow(tidy(run), schema)
