"""Ranked search: weighted BM25 over fields, exact vector search, and fusion of arms. Hits are (id, score float), best first by (score, id)."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text_analysis import stem_all, tokens, tokens_of

K1, B = 1.2, 0.75
RRF_K = 60
BUCKETS = 64
METRICS = ("cosine", "l2", "ip")


def widened(score: Column) -> Column:
    """A float32 score as the double with its shortest decimal."""
    return score.cast("float").cast("string").cast("double")


def query_terms(query: str, stemmed: bool = True) -> tuple[list[str], list[list[str]]]:
    """(different terms, phrases in quotes as term lists). Terms of phrases count as terms too."""
    phrases = [p for q in re.findall(r'"([^"]*)"', query) if (p := tokens_of(q, stemmed))]
    return list(dict.fromkeys(tokens_of(query, stemmed))), phrases


def analyzed(df: DataFrame, id_column: str, fields: dict[str, float], stemmed: bool = False) -> DataFrame:
    """(id, tokens of each field as f0, f1, ...): the inverted index's source. An array field's elements are parted by an empty token, so no phrase spans two."""
    out = [F.col(f"`{id_column}`").alias("id")]
    for i, name in enumerate(fields):
        c = F.col(name)
        if isinstance(df.select(c).schema[0].dataType, T.ArrayType):
            c = F.array_join(c, " docloomgap ")
            own = F.transform(tokens(c, stemmed), lambda t: F.when(t.startswith("docloomgap"), "").otherwise(t))
        else:
            own = tokens(c, stemmed)
        out.append(own.alias(f"f{i}"))
    return df.select(*out)


def variants(index: DataFrame, names: Sequence[str], terms: Sequence[str]) -> dict[str, list[str]]:
    """The tokens of plain `analyzed` rows that have these stems. Stems begin as their words do, so few different tokens are stemmed, each once."""
    starts = sorted({t[:2] for t in terms})
    words = F.filter(F.array_distinct(F.concat(*[F.col(n) for n in names])), lambda t: F.substring(t, 1, 2).isin(starts))
    found = index.select(F.explode(words).alias("word")).distinct().withColumn("stem", stem_all(F.array("word"))[0]).where(F.col("stem").isin(*terms))
    out: dict[str, list[str]] = {t: [] for t in terms}
    for r in found.collect():  # the inflections of the query's terms
        out[r["stem"]].append(r["word"])
    return out


def bm25(index: DataFrame, fields: dict[str, float], query: str, stemmed: bool = True) -> DataFrame:
    """Hits of a query over plain `analyzed` rows: any of its terms, and every phrase contiguous in one field. With stems, the tokens that share the stem of a term count as it.

    One aggregation gives document counts, document frequencies and mean lengths (a few numbers a term, sent to the driver); a second pass scores, all in
    column expressions. A query without terms has no hits.
    """
    terms, phrases = query_terms(query, stemmed)
    names = [f"f{i}" for i in range(len(fields))]
    if not terms:
        return index.where(F.lit(False)).select("id", F.lit(0.0).cast("float").alias("score"))
    words = variants(index, names, terms) if stemmed else {t: [t] for t in terms}
    same = lambda x, t: x.isin(*words[t]) if words[t] else F.lit(False)
    length = {n: F.size(F.filter(F.col(n), lambda t: t != "")) for n in names}
    tf = {(n, t): F.size(F.filter(F.col(n), lambda x: same(x, t))) for n in names for t in terms}  # noqa: B023
    has = [(sum((tf[n, t] for n in names), F.lit(0)) > 0).cast("int") for t in terms]
    any_token = sum((length[n] for n in names), F.lit(0)) > 0
    stats = index.agg(
        F.coalesce(F.sum(any_token.cast("int")), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(length[n]), F.lit(0)).alias(n) for n in names],
        *[F.coalesce(F.sum(h), F.lit(0)).alias(f"t{i}") for i, h in enumerate(has)],
    ).first()
    every = [w for t in terms for w in words[t]]
    wanted = F.arrays_overlap(F.array(*map(F.lit, every)), F.concat(*[F.col(n) for n in names])) if every else F.lit(False)

    def contiguous(n: str, p: list[str]) -> Column:
        def begins(i: Column) -> Column:
            return functools.reduce(lambda a, b: a & b, [F.coalesce(same(F.get(F.col(n), i + k), t), F.lit(False)) for k, t in enumerate(p)])

        return F.exists(F.sequence(F.lit(0), F.greatest(F.size(n) - len(p), F.lit(0))), begins)

    for p in phrases:
        wanted = wanted & functools.reduce(lambda a, b: a | b, [contiguous(n, p) for n in names])
    parts = [(w, tf[n, t].cast("double"), length[n], stats[n] / max(stats["n"], 1) or 1.0, stats[f"t{i}"]) for w, n in zip(fields.values(), names) for i, t in enumerate(terms)]
    score = sum((term_score(w, stats["n"], df, f, size, mean) for w, f, size, mean, df in parts), F.lit(0.0))
    return index.where(wanted).select("id", score.cast("float").alias("score"))


def term_score(weight: float, n: int, df: int, tf: Column, length: Column, mean: float) -> Column:
    """What a term that df of n documents hold adds to a document's score by one field."""
    idf = F.log1p(F.lit((n - df + 0.5) / (df + 0.5)))
    return F.lit(weight) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


# ---- a stored inverted index

POSTINGS = "term string, id {kind}, field int, tf int, length int, places array<int>"


def postings(index: DataFrame) -> DataFrame:
    """(term, id, field, tf, length, places) of `analyzed` rows. Places number the tokens of a field; the gaps between an array's elements count."""
    names = [c for c in index.columns if c != "id"]
    each = None
    for i, n in enumerate(names):
        length = F.size(F.filter(F.col(n), lambda t: t != ""))
        one = index.select("id", F.lit(i).alias("field"), length.alias("length"), F.posexplode(n).alias("place", "term")).where("term <> ''")
        each = one if each is None else each.unionByName(one)
    return each.groupBy("term", "id", "field").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("length").alias("length"), F.sort_array(F.collect_list("place")).alias("places")).select("term", "id", "field", "tf", "length", "places")


def totals(rows: DataFrame, fields: int) -> tuple[int, list[int]]:
    """(documents that have a token, tokens of each field) of postings."""
    own = rows.groupBy("id", "field").agg(F.first("length").alias("length"))
    r = own.agg(F.count_distinct("id"), *[F.coalesce(F.sum(F.when(F.col("field") == i, F.col("length"))), F.lit(0)) for i in range(fields)]).first()
    return r[0], list(r[1:])


def bm25_stored(rows: DataFrame, n: int, lengths: Sequence[int], fields: dict[str, float], query: str, stemmed: bool = True) -> DataFrame:
    """Hits as bm25 gives them, from postings of a collection with n documents of these token counts. Only the rows of the query's terms are read."""
    terms, phrases = query_terms(query, stemmed)
    if not terms:
        return rows.where(F.lit(False)).select("id", F.lit(0.0).cast("float").alias("score"))
    own = rows.where(F.col("term").isin(*terms))
    df = {r["term"]: r["n"] for r in own.groupBy("term").agg(F.count_distinct("id").alias("n")).collect()}  # as many as the query's terms
    score = F.lit(0.0)
    for i, w in enumerate(fields.values()):
        for t in terms:
            part = term_score(w, n, df.get(t, 0), F.col("tf").cast("double"), F.col("length"), lengths[i] / max(n, 1) or 1.0)
            score = score + F.when((F.col("field") == i) & (F.col("term") == t), part).otherwise(0.0)
    hits = own.withColumn("part", score).groupBy("id").agg(F.sum("part").alias("s"), *([F.collect_list(F.struct("field", "term", "places")).alias("held")] if phrases else []))

    def contiguous(i: int, p: list[str]) -> Column:
        def places(t: str) -> Column:
            return F.flatten(F.transform(F.filter("held", lambda h: (h["field"] == i) & (h["term"] == t)), lambda h: h["places"]))

        rest = [places(t) for t in p]
        return F.exists(rest[0], lambda x: functools.reduce(lambda a, b: a & b, [F.array_contains(r, x + k) for k, r in enumerate(rest)]))

    for p in phrases:
        hits = hits.where(functools.reduce(lambda a, b: a | b, [contiguous(i, p) for i in range(len(fields))]))
    return hits.select("id", F.col("s").cast("float").alias("score"))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """float score of two vectors of doubles; cosine is 0 for a zero vector, l2 is 1 / (1 + distance)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "ip":
        return dot(a, b).cast("float")
    if metric == "l2":
        square = F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
        return (1 / (1 + F.sqrt(square))).cast("float")
    if metric != "cosine":
        raise ValueError(f"metric must be one of {METRICS}")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm).cast("float")


def vector_search(df: DataFrame, id_column: str, vector_column: str, query: Sequence[float], metric: str = "cosine", k: int | None = None) -> DataFrame:
    """Exact nearest vectors: one scan and a bounded top-k (k None: all). Another dimension than the query's is an error."""
    v = F.col(f"`{vector_column}`")
    ok = F.when(F.size(v) == len(query), v).otherwise(F.raise_error(F.concat(F.lit(f"the query has {len(query)} dimensions, a vector has "), F.size(v).cast("string"))))
    hits = df.where(v.isNotNull()).select(F.col(f"`{id_column}`").alias("id"), similarity(ok, F.array(*[F.lit(float(x)) for x in query]), metric).alias("score"))
    return hits if k is None else best(hits, k)


# ---- many searches at once

#: Queries that are sent to the executors together, and scores that a task holds at a time.
QUERIES, TILE = 4096, 1 << 22


def scored(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """float32 scores of pairs of rows, added up in the order in which `similarity` adds, so that both give the same bits."""

    def fold(a: np.ndarray, b: np.ndarray, square: bool = False) -> np.ndarray:
        out = np.zeros(len(a))
        for i in range(a.shape[1]):
            out += (a[:, i] - b[:, i]) * (a[:, i] - b[:, i]) if square else a[:, i] * b[:, i]
        return out

    with np.errstate(all="ignore"):
        if metric == "ip":
            return fold(x, q).astype(np.float32)
        if metric == "l2":
            return (1 / (1 + np.sqrt(fold(x, q, True)))).astype(np.float32)
        norm = np.sqrt(fold(x, x)) * np.sqrt(fold(q, q))
        return np.where(norm == 0, 0.0, fold(x, q) / np.where(norm == 0, 1.0, norm)).astype(np.float32)


class Nearest:
    """The k best rows of each query among those that were shown to it, by (score, id). A product of matrices leaves few pairs over, which are scored as `similarity` does."""

    def __init__(self, queries: np.ndarray, metric: str, k: int):
        self.q, self.metric, self.k = queries, metric, k
        self.size = np.sqrt((queries * queries).sum(axis=1))
        self.least = np.full(len(queries), -np.inf)  # no row with a lower score counts
        self.held = pd.DataFrame({"query": np.empty(0, np.int64), "id": np.empty(0, object), "score": np.empty(0, np.float32)})

    def show(self, ids: np.ndarray, x: np.ndarray, which: np.ndarray) -> None:
        """Rows for the queries of these numbers."""
        # Of equal vectors only the k with the least ids can count.
        x = np.ascontiguousarray(x)
        same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((pd.factorize(ids, sort=True)[0], same))
        first = np.r_[True, same[order][1:] != same[order][:-1]]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        kept = order[place < self.k]
        step = max(1, TILE // max(len(which), 1))
        for at in range(0, len(kept), step):
            self._tile(ids[kept[at : at + step]], x[kept[at : at + step]], which)

    def _tile(self, ids: np.ndarray, x: np.ndarray, which: np.ndarray) -> None:
        size, q, own = np.sqrt((x * x).sum(axis=1)), self.q[which], self.size[which]
        most = size.max(initial=0.0)
        with np.errstate(all="ignore"):
            about = q @ x.T
            if self.metric == "cosine":
                norm = own[:, None] * size[None, :]
                about = np.where(norm == 0, 0.0, about / norm)
                slack = np.full(len(which), 2e-6)  # what the product and the rounding to float may differ by
            elif self.metric == "ip":
                slack = 2e-6 * (own * most + np.where(np.isfinite(self.least[which]), np.abs(self.least[which]), 0.0))
            else:
                about = 1 / (1 + np.sqrt(np.maximum(own[:, None] ** 2 + size[None, :] ** 2 - 2 * about, 0.0)))
                slack = 2e-6 * (1 + own + most)
            least = self.least[which]
            few = np.flatnonzero(least == -np.inf)
            if len(few) and about.shape[1] >= self.k:
                least[few] = np.partition(about[few], about.shape[1] - self.k, axis=1)[:, about.shape[1] - self.k]
            n, m = np.nonzero(~(about < (least - slack)[:, None]))
        if len(n):
            fresh = pd.DataFrame({"query": which[n], "id": ids[m], "score": scored(x[m], q[n], self.metric)})
            self._keep(pd.concat([self.held, fresh]) if len(self.held) else fresh)

    def _keep(self, rows: pd.DataFrame) -> None:
        rows = rows.assign(by=-np.where(np.isnan(rows["score"]), np.inf, rows["score"])).sort_values(["query", "by", "id"], kind="stable")
        self.held = rows[rows.groupby("query").cumcount() < self.k].drop(columns="by")
        full = self.held.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.least[full.index.to_numpy()] = full["min"].to_numpy(np.float64)


def search_many(rows: DataFrame, id_column: str, vector_column: str, asked: DataFrame, metric: str = "cosine", k: int = 10, probes: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(query, id, score): for each row of asked (query, v) what vector_search gives, in one job. Rows are dealt over all cores and read once for QUERIES queries; a task keeps k of them for each query.
    A vector with a NULL has no score and is left out. probes: (centres, n) to look only at rows whose `cell` is one of the n nearest a query."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark, v = rows.sparkSession, F.col(f"`{vector_column}`")
    some = rows.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    own = some.select(F.col(f"`{id_column}`").alias("id"), v.cast("array<double>").alias("v"), *(["cell"] if probes else []))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = own.repartition(n, "id")  # a table may come in one piece
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, id {own.schema['id'].dataType.simpleString()}, score float"
    out = spark.createDataFrame([], kinds)
    block: list = []

    def ask(block: list) -> DataFrame:
        names, q = [r["query"] for r in block], np.array([r["v"] for r in block], np.float64)
        near = None
        if probes:
            unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            near = np.argsort(-(unit @ np.asarray(probes[0]).T), axis=1, kind="stable")[:, : probes[1]]
        shared = spark.sparkContext.broadcast((names, q, near))

        def run(batches):
            names, q, near = shared.value
            best = Nearest(q, metric, k)
            for pdf in batches:
                if not len(pdf):
                    continue
                sizes = pdf["v"].map(len)
                if (sizes != q.shape[1]).any():
                    raise ValueError(f"the query has {q.shape[1]} dimensions, a vector has {sizes[sizes != q.shape[1]].iloc[0]}")
                ids, x = pdf["id"].to_numpy(object), np.stack(pdf["v"].to_numpy())
                if near is None:
                    best.show(ids, x, np.arange(len(q)))
                    continue
                cell = pdf["cell"].to_numpy()
                for c in np.unique(cell):
                    which = np.flatnonzero((near == c).any(axis=1))
                    if len(which):
                        best.show(ids[cell == c], x[cell == c], which)
            held = best.held
            yield pd.DataFrame({"query": [names[i] for i in held["query"]], "id": held["id"].to_numpy(), "score": held["score"].to_numpy(np.float32)})

        return own.mapInPandas(run, kinds)

    for r in asked.where("v IS NOT NULL").select("query", F.col("v").cast("array<double>").alias("v")).toLocalIterator():
        block.append(r)
        if len(block) == QUERIES:
            out, block = out.unionByName(ask(block)), []
    if block:
        out = out.unionByName(ask(block))
    return out.withColumn("n", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, id)")).where(F.col("n") <= k).drop("n")


# ---- a bucketed vector index

SAMPLE = 20_000


@dataclass
class Cells:
    """Vectors (id, v, cell) by their nearest centre, and the centres. An opt-in: it looks at some cells only."""

    rows: DataFrame
    centres: list[list[float]]


def build_cells(df: DataFrame, id_column: str, vector_column: str, cells: int, rounds: int = 8, seed: int = 3) -> Cells:
    """Centres are fitted on a sample of SAMPLE vectors at most, by their directions; every vector is put into the cell of its nearest centre."""
    v = F.col(f"`{vector_column}`")
    own = df.where(v.isNotNull()).select(F.col(f"`{id_column}`").alias("id"), v.cast("array<double>").alias("v"))
    share = min(1.0, 1.2 * SAMPLE / max(own.count(), 1))
    picked = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).limit(SAMPLE).toPandas()
    x = np.array(picked["v"].tolist(), np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    points = [[float(y) for y in c] for c in centres]
    scores = F.array(*[F.struct(similarity(F.col("v"), F.array(*map(F.lit, c)), "ip").alias("s"), F.lit(-k).alias("k")) for k, c in enumerate(points)])
    return Cells(own.repartition("id").withColumn("cell", -F.array_max(scores)["k"]), points)


def cell_search(index: Cells, query: Sequence[float], metric: str = "cosine", k: int = 10, probes: int = 8) -> DataFrame:
    """The nearest vectors of the `probes` cells whose centres are nearest by direction; with all cells the result is exact. A stored table partitioned by cell is read in part."""
    q = np.asarray(query, np.float64)
    near = np.argsort(-(np.array(index.centres) @ (q / max(np.linalg.norm(q), 1e-12))), kind="stable")[:probes].tolist()
    return vector_search(index.rows.where(F.col("cell").isin(*near)), "id", "v", query, metric, k)


def cell_search_many(index: Cells, asked: DataFrame, metric: str = "cosine", k: int = 10, probes: int = 8) -> DataFrame:
    """(query, id, score) of what cell_search gives for each row of asked (query, v), in one job."""
    return search_many(index.rows, "id", "v", asked, metric, k, (np.array(index.centres), probes))


def best(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """hits with `rank` from 1 by (score, id), without a sort in one task: rows are numbered within score buckets, buckets offset by their counts."""
    bounds = sorted(set(hits.approxQuantile("score", [i / BUCKETS for i in range(1, BUCKETS)], 0.001)), reverse=True)
    bucket = sum(((F.col("score").cast("double") < F.lit(b)).cast("int") for b in bounds), F.lit(0))
    placed = hits.withColumn("bucket", bucket)
    counts = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}  # BUCKETS rows at most
    start, at = [], 0
    for b in range(len(bounds) + 1):
        start += [F.lit(b), F.lit(at)]
        at += counts.get(b, 0)
    own = F.expr("row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id)")
    return placed.withColumn("rank", own + F.element_at(F.create_map(*start), F.col("bucket"))).drop("bucket")


@dataclass
class Arm:
    hits: DataFrame
    weight: float = 1.0
    depth: int | None = None
    min_score: float | None = None

    def taken(self) -> DataFrame:
        out = self.hits if self.min_score is None else self.hits.where(F.col("score") >= F.lit(self.min_score))
        return out if self.depth is None else best(out, self.depth)


def fuse(arms: Sequence[Arm], mode: str = "rrf", k: int | None = None) -> DataFrame:
    """Reciprocal-rank (1 / (60 + rank)) or weighted min-max fusion; an arm whose scores are all equal counts 1.0 for each hit."""
    parts = []
    for arm in arms:
        hits = arm.taken()
        if mode == "rrf":
            part = ranked(hits).select("id", (F.lit(float(arm.weight)) / (RRF_K + F.col("rank"))).alias("part"))
        elif mode == "weighted":
            low, high = hits.agg(F.min("score"), F.max("score")).first()
            span = None if low is None else float(high) - float(low)
            share = F.lit(1.0) if not span else (F.col("score").cast("double") - F.lit(float(low))) / F.lit(span)
            part = hits.select("id", (F.lit(float(arm.weight)) * share).alias("part"))
        else:
            raise ValueError("mode must be rrf or weighted")
        parts.append(part)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    out = both.groupBy("id").agg(F.sum("part").cast("float").alias("score"))
    return out if k is None else best(out, k)


def depth_for(limit: int | None, offset: int) -> int | None:
    """Candidates an arm gives when a query is ordered by score and limited; None: all."""
    return None if limit is None else min(1000, max(50, 4 * (limit + offset)))
