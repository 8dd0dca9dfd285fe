"""Near-duplicate classes by BagMinHash signatures of word shingles, banding, and verification of the multiset overlap.

A text is a multiset of SHINGLE-word shingles. BagMinHash (Ertl, 2018): each shingle owns hierarchical Poisson processes over the plane of weight and
time. The weight axis is discretised to whole multiplicities and cut into dyadic levels [0,1), [1,2), [2,4), ...; a level of length n has points
at rate n, each with a random place in the level and a random register, and a point counts for a text if its place lies below the shingle's
multiplicity there. A register keeps its first point in time, so two texts agree in a register with probability sum(min) / sum(max).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import _chunks
from docloom.llm.common import COPIES, forget, fresh, give_back, in_pieces, matched, sent_if_small, tidy, unfolded, written

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8 as a ratio of whole numbers
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
SPAN = 1 << 19
#: Buckets of up to SMALL texts are compared as pairs, larger ones in tiles of about OUTSIDERS by MEMBERS texts.
SMALL, OUTSIDERS, MEMBERS = 12, 128, 1024
#: Texts of a tile are compared in full if at least this many of their registers agree with another one's: at a similarity of 0.8 fewer do once in 10**7
#: pairs, where the bands miss one in 20,000.
PLAUSIBLE = 75
#: Pairs of one text that are verified in one place.
PAIRS = 4096

# Fixed values of the splitmix64 generator, and an odd base with its inverse for rolling sums.
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


def word_hashes(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind the other -> (hash of each word, number of words of each text). Words are cut at ASCII white space."""
    b = np.frombuffer(data, np.uint8)
    ends = np.cumsum(sizes)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = (ends - sizes)[sizes > 0]
    begins[at] = inside[at]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[ends[sizes > 0] - 1] = inside[ends[sizes > 0] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    n = 1 << max(18, int(len(b)).bit_length())
    power, inverse = _powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])))
    own = (total[stop] - total[start]) * inverse[start]
    return mix(own ^ ((stop - start).astype(np.uint64) << np.uint64(56))), np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def shingles(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, multiplicity) of the different shingles of each text; a text of fewer words is one shingle, one without words none."""
    words, counts = word_hashes(data, sizes)
    each = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(sizes)), each)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.repeat(first - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(len(doc))
    left = np.repeat(counts, each)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    h = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        h = mix(h ^ np.where(k < left, padded[at + k], np.uint64(0)))
    order = np.argsort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], h[heads], np.diff(np.append(heads, len(doc)))


def _points(doc: np.ndarray, seed: np.ndarray, low: np.ndarray, size: np.ndarray, weight: np.ndarray, until: np.ndarray, out: np.ndarray) -> None:
    """Lowers the registers `out` (text x register) by the points of these levels up to each text's time `until`."""
    t = np.zeros(len(doc))
    flat = out.ravel()
    while len(doc):
        seed = mix(seed)
        t = t - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
        on = t <= until[doc]
        doc, seed, low, size, weight, t = doc[on], seed[on], low[on], size[on], weight[on], t[on]
        other = mix(seed ^ MIX1)
        place = low + ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32) * size
        register = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(32)
        hit = place < weight
        np.minimum.at(flat, doc[hit] * REGISTERS + register[hit].astype(np.int64), t[hit])


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """Registers (texts x REGISTERS, times); infinite throughout for a text without shingles."""
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    size = np.where(level > 0, low, 1.0)
    doc_of, weight = doc[row], count[row].astype(np.float64)
    seed = mix(h[row] ^ (level.astype(np.uint64) * MIX2))
    total = np.bincount(doc, count, texts)
    out = np.full((texts, REGISTERS), np.inf)
    open_ = total > 0
    scale = 4.0
    while open_.any():
        until = np.where(open_, REGISTERS * (np.log(REGISTERS) + scale) / np.maximum(total, 1), -1.0)
        own = open_[doc_of]
        _points(doc_of[own], seed[own], low[own], size[own], weight[own], until, out)
        open_ &= ~np.isfinite(out).all(axis=1)
        scale *= 2
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band (texts x BANDS)."""
    bits = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ bits[:, :, k])
    return key.view(np.int64)


def overlap(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of minima, sum of maxima) of the shingle multiplicities of each pair of texts."""
    n = len(a)
    both = [x for pair in zip(a, b) for x in pair]
    doc, h, c = shingles(b"".join(both), np.array([len(x) for x in both]))
    pair = doc >> 1
    order = np.argsort((pair.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), kind="stable")
    pair, h, c = pair[order], h[order], c[order]
    same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
    shared = np.bincount(pair[1:][same], np.minimum(c[1:], c[:-1])[same], n).astype(np.int64)
    return shared, np.bincount(pair, c, n).astype(np.int64) - shared


def sketches(registers: np.ndarray) -> np.ndarray:
    """16 bits of each register (texts x REGISTERS)."""
    return (mix(registers.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _band_rows(texts: DataFrame) -> DataFrame:
    """texts (t, body) -> (t, keys array<long>, sketch binary); texts without words give no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, data, sizes in _chunks(batch.column(1)):
                registers = signatures(*shingles(data, sizes), len(sizes))
                full = np.isfinite(registers[:, 0])
                keys = band_keys(registers[full])
                ends = np.arange(len(keys) + 1, dtype=np.int32) * BANDS
                sketch = pa.array([x.tobytes() for x in sketches(registers[full])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[full]]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())), sketch], names=["t", "keys", "sketch"])

    return texts.mapInArrow(tidy(run), "t long, keys array<long>, sketch binary")


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose texts overlap by SIMILARITY or more. The text of an `a` with many pairs goes to several places, PAIRS of them to each."""
    places, _ = written(pairs.groupBy(F.col("a").alias("of")).agg(F.count(F.lit(1)).alias("n")).withColumn("places", F.ceil(F.col("n") / PAIRS).cast("int")))
    pairs = matched(pairs, places, [("a", "of")], "n").select("a", "b", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
    left = bodies.join(places, F.col("t") == F.col("of")).select(F.col("t").alias("a"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.col("body").alias("x"))
    right = bodies.select(F.col("t").alias("b"), F.col("body").alias("y"))
    num, den = SIMILARITY

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.columns[2:]
            lengths = np.cumsum(pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(y).to_numpy(zero_copy_only=False))
            keep = np.zeros(batch.num_rows, bool)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(lengths, (lengths[i - 1] if i else 0) + SPAN, "right")))
                shared, whole = overlap([v.as_py().encode() for v in x[i:j]], [v.as_py().encode() for v in y[i:j]])
                keep[i:j] = (shared * den >= whole * num) & (whole > 0)
                i = j
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(left, ["a", "place"]).join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(tidy(run), "a long, b long")


def _tile_links(tile: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of components that a link between an outsider and a member of the tile joins, by an inverted index of the outsiders' shingles. Links that
    join nothing new within the tile are left out, so a tile gives fewer pairs than it has components."""
    num, den = SIMILARITY
    out, own = tile[tile["out"]], tile[~tile["out"]]
    found = []
    above: dict[int, int] = {}

    def root(c: int) -> int:
        while above.get(c, c) != c:
            above[c] = above.get(above[c], above[c])
            c = above[c]
        return c

    if len(out) and len(own):
        side = []
        for part in (out, own):
            data = [x.encode() for x in part["body"]]
            side.append(shingles(b"".join(data), np.array([len(x) for x in data])))
        (od, oh, oc), (md, mh, mc) = side
        on, mn = np.bincount(od, oc, len(out)).astype(np.int64), np.bincount(md, mc, len(own)).astype(np.int64)
        order = np.argsort(oh)
        od, oh, oc = od[order], oh[order], oc[order]
        lo, hi = np.searchsorted(oh, mh, "left"), np.searchsorted(oh, mh, "right")
        work = np.cumsum(hi - lo)
        firsts = np.searchsorted(md, np.arange(len(own) + 1))
        i = 0
        while i < len(own):
            base = work[firsts[i] - 1] if firsts[i] else 0
            j = max(i + 1, int(np.searchsorted(work[firsts[i + 1 :] - 1], base + SPAN, "right")) + i)
            a, b = firsts[i], firsts[j]
            times = (hi - lo)[a:b]
            row = np.repeat(np.arange(a, b), times)
            k = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            shared = np.bincount((md[row] - i) * len(out) + od[k], np.minimum(mc[row], oc[k]), (j - i) * len(out)).astype(np.int64).reshape(j - i, len(out))
            whole = mn[i:j, None] + on[None, :] - shared
            m, o = np.nonzero((shared * den >= whole * num) & (whole > 0) & (own["c"].to_numpy()[i:j, None] != out["c"].to_numpy()[None, :]))
            pairs = np.unique(np.stack((out["c"].to_numpy()[o], own["c"].to_numpy()[i:j][m])), axis=1)
            for a_, b_ in pairs.T.tolist():
                if (x := root(a_)) != (y := root(b_)):
                    above[max(x, y)] = min(x, y)
                    found.append((a_, b_))
            i = j
    give_back()
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _plausible(tile: pd.DataFrame) -> pd.DataFrame:
    """The rows (without sketches) of a tile's outsiders and members that agree in PLAUSIBLE registers with a text of the other side and of another component."""
    out, own = tile[tile["out"]], tile[~tile["out"]]
    keep = np.zeros(0, np.int64)
    if len(out) and len(own):
        x, y = (np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(len(part), REGISTERS) for part in (out, own))
        agree = np.zeros((len(out), len(own)), np.uint8)
        for r in range(REGISTERS):
            agree += x[:, r, None] == y[None, :, r]
        hit = (agree >= PLAUSIBLE) & (out["c"].to_numpy()[:, None] != own["c"].to_numpy()[None, :])
        keep = np.concatenate((out.index[hit.any(axis=1)], own.index[hit.any(axis=0)]))
    return tile.loc[keep, ["key", "i", "j", "t", "c", "out"]]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the least node of each connected component, by alternating stars (Kiveris et al., 2014).

    Each round is two aggregations with map-side minima and a join on the node, written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain. It ends when the edges are stars: no node is below two others, or both above one and below another.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        degrees = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
        if degrees.where("up > 1 OR up = 1 AND down > 0").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        step, new = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        forget(spark, path)
        now, path = step, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


def text_classes(texts: DataFrame) -> DataFrame:
    """texts (t, body), copies allowed -> (node, label) of the texts that are near duplicates of another, by connected components.

    Candidates are texts that share a band. In each bucket all are compared with the least one. Then, in buckets that still hold several components, the
    members outside the bucket's largest component are compared with all members of other components: in small buckets as pairs, in larger ones in
    tiles of OUTSIDERS by MEMBERS texts that give verified links only. So every two candidates end in one component or have been compared, whatever the
    size of a bucket, and members that are joined already are not compared with each other.
    """
    spark = texts.sparkSession
    rows, rows_path = written(_band_rows(texts).dropDuplicates(["t"]))
    bands = rows.select("t", F.explode("keys").alias("key"))
    buckets, buckets_path = written(bands.groupBy(F.col("key").alias("k")).agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z").drop("z"))
    members, members_path = written(matched(bands, buckets, [("key", "k")], "n").where("a IS NOT NULL").select("key", "t", "a"))
    # Only candidates' texts are kept, one of each; copies fold before they are moved on.
    wanted, wanted_path = written(members.select("t").distinct())
    bodies, bodies_path = written(texts.join(sent_if_small(wanted), "t", "left_semi").groupBy("t").agg(F.any_value("body").alias("body")))
    stars, stars_path = written(members.where("t <> a").select("a", F.col("t").alias("b")).distinct())
    edges, edges_path = written(_verified(stars, bodies))
    found = components(edges)

    placed, placed_path = written(members.join(found.withColumnRenamed("node", "t"), "t", "left").select("key", "t", "a", F.coalesce("label", "t").alias("c")))
    parts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    # The largest component of a bucket, the one of the least label among equals, is the one that others are compared with.
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", F.bitwise_not("c").alias("inverse"))).alias("main"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi AND n > 2")
    mixed, mixed_path = written(whole.select(F.col("key").alias("of"), F.col("n").alias("rows"), "n", F.col("main.n").alias("most"), F.bitwise_not("main.inverse").alias("main")))
    own, own_path = written(matched(placed, mixed, [("key", "of")], "rows").where("of IS NOT NULL").select("key", "t", "c", (F.col("c") != F.col("main")).alias("out"), "n", (F.col("n") - F.col("most")).alias("k")))

    x, y = (own.where(F.col("n") <= SMALL).select("key", F.col("t").alias(t), F.col("c").alias(f"c{t}")) for t in ("a", "b"))
    cross = x.join(y, "key").where("ca < cb").select("a", "b", "ca", "cb").distinct()
    cross, cross_path = written(cross.join(stars.union(stars.select("b", "a")), ["a", "b"], "left_anti"))
    linked = _verified(cross.select("a", "b"), bodies).join(cross, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    # Large buckets: sketches are compared tile by tile, and the texts of those rows only that may have a partner there.
    large = own.where(F.col("n") > SMALL).join(rows.select("t", "sketch"), "t")
    across, down = F.ceil(F.col("k") / OUTSIDERS).cast("int"), F.ceil(F.col("n") / MEMBERS).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    outsiders = large.where("out").select("key", F.pmod(F.xxhash64("t"), across).cast("int").alias("i"), F.explode(upto(down)).alias("j"), "t", "c", "sketch", F.lit(True).alias("out"))
    everyone = large.select("key", F.explode(upto(across)).alias("i"), F.pmod(F.xxhash64("t"), down).cast("int").alias("j"), "t", "c", "sketch", F.lit(False).alias("out"))
    near, near_path = written(outsiders.unionByName(everyone).groupBy("key", "i", "j").applyInPandas(_plausible, "key long, i int, j int, t long, c long, out boolean"))
    tiles = near.join(bodies, "t").groupBy("key", "i", "j").applyInPandas(_tile_links, "a long, b long")
    late, late_path = written(linked.unionByName(tiles))
    if not late.isEmpty():  # the components that were joined late get one label
        joined = components(late)
        again = found.join(joined.select(F.col("node").alias("label"), F.col("label").alias("l")), "label", "left").select("node", F.coalesce("l", "label").alias("label"))
        found = again.unionByName(joined.join(found.select("node"), "node", "left_anti"))
    found, _ = written(found)
    forget(spark, rows_path, buckets_path, members_path, wanted_path, bodies_path, stars_path, edges_path, placed_path, mixed_path, own_path, cross_path, near_path, late_path)
    return found


def _least(slim: DataFrame, found: DataFrame, value: Column) -> DataFrame:
    """slim (t, .., value, n) and classes (node, label) -> a written table (of, least, n): for each text that has copies or is in a class, the least value of all rows of its class
    or copies, and how many rows of slim have the text."""
    texts, texts_path = written(slim.where("t IS NOT NULL").groupBy("t").agg(F.min(value).alias("v"), F.count(F.lit(1)).alias("r"), F.sum("n").alias("n")))
    classed, classed_path = written(texts.join(found, F.col("t") == F.col("node")).select("t", F.col("label").alias("c"), "v", "r"))
    classes, classes_path = written(classed.groupBy(F.col("c").alias("of")).agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("texts")))
    near = matched(classed, classes, [("c", "of")], "texts").select(F.col("t").alias("of"), "least", F.col("r").alias("n"))
    copies = texts.where("n > 1").join(found, F.col("t") == F.col("node"), "left_anti").select(F.col("t").alias("of"), F.col("v").alias("least"), F.col("r").alias("n"))
    out, _ = written(near.unionByName(copies))
    forget(slim.sparkSession, texts_path, classed_path, classes_path)
    return out


def _with_least(folded: DataFrame, least: DataFrame) -> DataFrame:
    return matched(folded, least.withColumnRenamed("n", "r"), [("t", "of")], "r")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", class_id: str = "class_id") -> DataFrame:
    """One row per row of df: key, class_id, and copies (rows with the same key and text).

    Rows are in one class if a chain of texts with similarity 0.8 or more joins them (see text_classes); class_id is the least key of the class. Equal
    texts are one class whatever their length. A null text, or one without words, is a class of its own with its own key. Null keys: ignored for the
    least key unless a class has no other. Very long texts are compared whole. Empty input: no rows. Other columns are not read.
    Texts are known by a 64-bit hash; two different texts share it once in about 10**19 pairs.
    """
    c = lambda name: F.col(f"`{name}`")
    has_words = F.coalesce(c(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    base = df.select(c(key).alias("k"), F.when(has_words, F.xxhash64(c(text))).alias("t"), c(text).alias("body"))
    found = text_classes(base.where(F.col("t").isNotNull()).select("t", "body"))
    folded, _ = written(base.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n")))
    least = _least(folded, found, F.col("k"))
    out = _with_least(folded, least).select("k", F.when(F.col("of").isNull(), F.col("k")).otherwise(F.col("least")).alias("m"), F.col("n").alias("copies"), "n")
    few, many = out.where(f"n <= {COPIES}"), in_pieces(out.where(f"n > {COPIES}"), "n", "piece")
    many = many.repartition("k", "m", "piece").drop("piece")  # rows that repeat very often are unfolded in many places
    return few.unionByName(many).select(F.col("k").alias(key), F.col("m").alias(class_id), "copies", unfolded("n").alias("copy")).drop("copy")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df (all columns) less near duplicates: of each class the row with the least (key, text hash) stays, nulls first; all texts without words stay."""
    c = lambda name: F.col(f"`{name}`")
    t, k2, t2, n = fresh(df, "text_hash", "key_of", "hash_of", "times")
    has_words = F.coalesce(c(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    base = df.withColumn(t, F.when(has_words, F.xxhash64(c(text))))
    found = text_classes(base.where(c(t).isNotNull()).select(c(t).alias("t"), c(text).alias("body")))
    folded, _ = written(base.where(c(t).isNotNull()).groupBy(c(key).alias("k"), c(t).alias("t")).agg(F.count(F.lit(1)).alias("n")))
    placed = _with_least(folded, _least(folded, found, F.struct("k", "t"))).where("of IS NOT NULL")
    # Rows that go, and rows that stay once though they repeat: both few beside those that stay.
    marked = placed.select("k", "t", "n", F.struct("k", "t").eqNullSafe(F.col("least")).alias("stays")).where("NOT stays OR n > 1")
    marks, _ = written(marked.select(F.col("k").alias(k2), F.col("t").alias(t2), F.col("stays").alias(n)))
    joined = base.join(sent_if_small(marks), (c(t) == c(t2)) & c(key).eqNullSafe(c(k2)), "left").where(c(n).isNull() | c(n))
    plain = joined.where(c(n).isNull())
    once = joined.where(c(n).isNotNull()).dropDuplicates([key, t])
    return plain.union(once).select(*[c(x) for x in df.columns])
