"""Benchmark decontamination: the q-gram lemma over overlapping diagonal bands, then banded alignment.

Texts are compared in a normal form: lower-case letters and digits, every run of other characters one space. An item of length m may be met with
e = min(RATE m, (m - Q) / Q) edits. Wherever a text holds it so, both share at least m - Q + 1 - Q e q-grams, on diagonals (place in the text
less place in the item) at most e apart. Diagonals are dealt to bands of 2 (e + 1), each overlapping half of the next, so one band holds all
of them. Bands with enough shared q-grams are verified by an alignment that stays e diagonals around the band.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.bpe import LETTER, NUMBER, _chunks, code_point_classes
from docloom.llm.common import tidy

Q = 10
RATE = 0.08
MAP_BITS = 22
#: Bytes of benchmark text that are looked for at once; a larger benchmark takes several passes, so what is sent to the executors is bounded.
BLOCK_BYTES = 4 << 20
#: Places where q-grams of items are met that are counted at once; a text that has more is counted for some items after the others.
HITS = 1 << 21
FAR = np.int64(1) << 40
UNIT = np.int64(1) << 24
NO_CHAR = np.uint32(0xFFFFFFFF)


@functools.cache
def _normal() -> np.ndarray:
    """For each code point its lower-case form if it is a letter or a number, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(code_point_classes() <= NUMBER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    assert LETTER < NUMBER
    return table


def normal_form(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one behind the other -> (characters in normal form, 32 for a space; place of each in its text; ends of the texts in the normal form)."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    firsts = np.searchsorted(np.cumsum(width), np.concatenate(([0], np.cumsum(sizes)[:-1])), "right")
    s = _normal()[points]
    keep = s != 0
    gap = ~keep
    keep[1:] |= keep[:-1] & gap[1:]
    keep[0] = True
    keep[firsts] = s[firsts] != 0
    at = np.flatnonzero(keep)
    s = s[at]
    s[s == 0] = 32
    ends = np.searchsorted(at, np.append(firsts[1:], len(points)))
    start = np.repeat(firsts, np.diff(np.concatenate(([0], ends))))
    return s, at - start, ends


def gram_hashes(s: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place; Q - 1 places fewer than characters."""
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
    one = (s.astype(np.uint64) + np.uint64(1)) * b
    two = one[:-1] * a + one[1:]
    four = (two[:-2] ^ (two[:-2] >> np.uint64(29))) * b + two[2:]
    eight = (four[:-4] ^ (four[:-4] >> np.uint64(31))) * c + four[4:]
    ten = (eight[:-2] ^ (eight[:-2] >> np.uint64(30))) * a + two[8:]
    return (ten ^ (ten >> np.uint64(32))) * c


@dataclass
class Items:
    """Benchmark items in normal form, and where each q-gram occurs in them; `grams` are the different ones, and `key` orders their occurrences by (gram, item).
    Items of fewer than Q characters are known by their whole text."""

    ids: list
    text: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    key: np.ndarray
    place: np.ndarray
    possible: np.ndarray
    short: dict[bytes, list]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        """rows: (id, text). Items without letters or digits are left out."""
        kept, short = [], {}
        for item_id, text in rows:
            data = (text or "").encode()
            if data:
                s = normal_form(data, np.array([len(data)]))[0]
                s = s[:-1] if len(s) and s[-1] == 32 else s
                if len(s) >= Q:
                    kept.append((item_id, s))
                elif len(s):
                    short.setdefault(s.tobytes(), []).append(item_id)
        m = np.array([len(s) for _, s in kept], np.int64)
        edits = np.minimum((m * RATE).astype(np.int64), (m - Q) // Q)
        hashes = [gram_hashes(s) for _, s in kept]
        every = np.concatenate(hashes) if kept else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), m - Q + 1) if kept else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if kept else np.zeros(0, np.int64)
        grams, number = np.unique(every, return_inverse=True)
        key = (number.astype(np.int64) << 32) | item
        order = np.argsort(key, kind="stable")
        possible = np.zeros(1 << MAP_BITS, bool)
        possible[(grams >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
        return cls([i for i, _ in kept], [s for _, s in kept], edits, m - Q + 1 - Q * edits, grams, key[order], place[order], possible, short)


def _bands(at: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, begins: np.ndarray, items: Items) -> np.ndarray:
    """(text, item, lowest diagonal) of the bands with enough of these hits; [lo, hi) are the occurrences in items of the gram at each place."""
    times = hi - lo
    row = np.repeat(np.arange(len(at)), times)
    k = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    item = items.key[k] & 0xFFFFFFFF
    diagonal = at[row] - begins[doc[row]] - items.place[k]
    band = diagonal // (items.edits[item] + 1)
    if not len(row):
        return np.zeros((0, 3), np.int64)
    # Text, item and band as one number, so that one sort brings the hits of a band together.
    low = int(band.min()) - 1
    bands, first, n = int(band.max()) - low + 1, int(doc[0]), len(items.text)
    if (int(doc[-1]) - first + 1) * n * bands >= 1 << 63:
        raise OverflowError("a text is too long to be searched in one piece")
    own = ((doc[row] - first) * n + item) * bands + (band - low)
    own = np.sort(np.concatenate((own, own - 1)))
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    key = own[heads]
    item = key // bands % n
    enough = np.diff(np.append(heads, len(own))) >= items.need[item]
    key, item = key[enough], item[enough]
    return np.stack((key // bands // n + first, item, (key % bands + low) * (items.edits[item] + 1)), 1)


def _candidates(s: np.ndarray, ends: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """(text, item, lowest diagonal) of the bands with enough shared q-grams, some texts, or some items of one text, at a time: HITS hits at most, or those of one item."""
    if len(s) < Q or not len(items.grams):
        return
    h = gram_hashes(s)
    at = np.flatnonzero(items.possible[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
    doc = np.searchsorted(ends, at, "right")
    gram = np.searchsorted(items.grams, h[at])
    whole = (at + Q <= ends[doc]) & (items.grams[np.minimum(gram, len(items.grams) - 1)] == h[at])
    at, doc, gram = at[whole], doc[whole], gram[whole].astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))

    def between(rows: slice, first: int, stop: int) -> Iterator[np.ndarray]:
        """The bands of some places and of the items from first to stop."""
        lo, hi = np.searchsorted(items.key, (gram[rows] << 32) | first), np.searchsorted(items.key, (gram[rows] << 32) | stop)
        if int((hi - lo).sum()) <= HITS or stop - first == 1:
            yield _bands(at[rows], doc[rows], lo, hi, begins, items)
        else:
            middle = (first + stop) // 2
            yield from between(rows, first, middle)
            yield from between(rows, middle, stop)

    n = len(items.text)
    times = np.cumsum(np.searchsorted(items.key, (gram + 1) << 32) - np.searchsorted(items.key, gram << 32))
    firsts = np.searchsorted(doc, np.arange(len(ends) + 1))  # places of each text
    i = 0
    while i < len(ends) and firsts[i] < len(at):
        before = times[firsts[i] - 1] if firsts[i] else 0
        last = np.concatenate(([0], times))[firsts[i + 1 :]]
        j = max(i + 1, i + int(np.searchsorted(last, before + HITS, "right")))
        yield from between(slice(firsts[i], firsts[j]), 0, n)
        i = j


def _align(s: np.ndarray, ends: np.ndarray, items: Items, found: np.ndarray) -> np.ndarray:
    """(text, item, first place, end, edits) of the candidates that an alignment within e edits confirms; places in the text's normal form."""
    begins = np.concatenate(([0], ends[:-1]))
    out = []
    widths = 4 * items.edits[found[:, 1]] + 2
    lengths = np.array([len(t) for t in items.text])[found[:, 1]]
    order = np.lexsort((lengths, widths))
    for part in np.array_split(order, max(1, len(order) // 256)):  # alike in size
        f, m, rank = found[part], lengths[part], np.arange(len(part))
        e = items.edits[f[:, 1]]
        width, rows = int(widths[part].max()), int(m.max())
        pattern = np.full((len(f), rows), NO_CHAR - 1, np.uint32)
        for r, k in enumerate(f[:, 1]):
            pattern[r, : m[r]] = items.text[k]
        size = (ends - begins)[f[:, 0]]
        low = f[:, 2] - e
        step = np.arange(width, dtype=np.int64)
        place = low[:, None] + step  # in the text, at row 0
        outside = step[None, :] >= widths[part][:, None]
        cost = np.where((place < 0) | (place > size[:, None]) | outside, FAR, step * 1)
        last = np.full(cost.shape, FAR)
        base = begins[f[:, 0]][:, None]
        for i in range(1, rows + 1):
            if i % 16 == 0:  # what is beyond its edits already is given up
                alive = (cost.min(axis=1) // UNIT <= e[rank]) & (m[rank] >= i)
                if not alive.all():
                    rank, cost, place, outside, base = rank[alive], cost[alive], place[alive], outside[alive], base[alive]
                    if not len(rank):
                        break
            j = place + i
            inside = (j >= 1) & (j <= size[rank][:, None])
            char = np.where(inside, s[np.clip(base + j - 1, 0, len(s) - 1)], NO_CHAR)
            new = cost + np.where(char == pattern[rank, i - 1 : i], 0, UNIT)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + UNIT)
            off = (j < 0) | (j > size[rank][:, None]) | outside
            new[off] = FAR
            new = np.minimum.accumulate(new - step * UNIT, axis=1) + step * UNIT
            new[off] = FAR
            cost = np.minimum(new, FAR)
            done = m[rank] == i
            if done.any():
                last[rank[done]] = cost[done]
        best = last.argmin(axis=1)
        value = last[np.arange(len(f)), best]
        edits, origin = value // UNIT, value % UNIT
        ok = edits <= e
        out.append(np.stack((f[:, 0], f[:, 1], low + origin, low + best + m, edits), 1)[ok])
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def leaks_in(data: bytes, sizes: np.ndarray, items: Items) -> list[tuple]:
    """(text number, item id, start, end, edits); start and end are code points of the original text. Of overlapping finds of one item the one with fewest edits counts."""
    s, origin, ends = normal_form(data, sizes)
    begins = np.concatenate(([0], ends[:-1]))
    out: list[tuple] = []
    for doc in np.flatnonzero((ends > begins) & (ends - begins <= Q)).tolist() if items.short else ():
        own = s[begins[doc] : ends[doc]]
        first, last = int(own[0] == 32), len(own) - int(own[-1] == 32)
        for item_id in items.short.get(own[first:last].tobytes(), ()) if first < last else ():
            out.append((doc, item_id, int(origin[begins[doc] + first]), int(origin[begins[doc] + last - 1]) + 1, 0))
    for found in _candidates(s, ends, items):
        if not len(found):
            continue
        own: list[tuple] = []
        for doc, item, a, b, edits in sorted(map(tuple, _align(s, ends, items, found).tolist())):
            start, end = int(origin[begins[doc] + a]), int(origin[begins[doc] + b - 1]) + 1
            if own and own[-1][:2] == (doc, item) and start < own[-1][3]:
                if edits < own[-1][4]:
                    own[-1] = (doc, item, start, end, edits)
            else:
                own.append((doc, item, start, end, edits))
        out += [(doc, items.ids[item], *rest) for doc, item, *rest in own]
    return out


def _pass(df: DataFrame, items: Items, text: str, leaks: str, kind: T.DataType) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)
    at = next(i for i, c in enumerate(df.columns) if c.lower() == text.lower())
    spans = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]), False)
    schema = T.StructType([*df.schema.fields, T.StructField(leaks, spans, False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        made = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
        for batch in batches:
            lists: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for rows, data, sizes in _chunks(batch.column(at)):
                for doc, item_id, start, end, edits in leaks_in(data, sizes, own):
                    lists[rows[doc]].append({"item_id": item_id, "start": start, "end": end, "edits": edits})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, made)], names=[*batch.schema.names, leaks])

    return df.mapInArrow(tidy(run), schema)


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", leaks: str = "leaks") -> DataFrame:
    """The rows of df with `leaks` array<struct<item_id, start, end, edits>>: where the text holds an item with few edits; a column of that name is replaced.

    Every whole text, very long ones too, is searched for every item. The benchmark is sent out in blocks of about BLOCK_BYTES. Null or empty texts: no leaks. An
    item of fewer than Q characters in normal form is found where it is all of a text; one without letters or digits never. Ids are of any type. Equal items
    are found each under its own id (null ids too), rows of the benchmark that repeat once. An empty benchmark: no leaks. Rows map one to one, repeated
    rows alike, in one pass a block; nothing is shuffled.
    """
    keep = [c for c in df.columns if c.lower() != leaks.lower()]
    out = df.select(*[f"`{c}`" for c in keep])
    asked = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").alias("x")).distinct()
    kind = asked.schema["i"].dataType
    total = asked.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("i", "x"), F.lit(blocks)) == b).collect()
        items = Items.of(sorted(((r["i"], r["x"]) for r in rows), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1] or "")))
        out = _pass(out, items, text, f"{leaks} of block {b}", kind)
        parts.append(F.col(f"`{leaks} of block {b}`"))
    return out.select(*[f"`{c}`" for c in keep], (F.concat(*parts) if len(parts) > 1 else parts[0]).alias(leaks))
