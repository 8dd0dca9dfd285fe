"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent, with calibrated rejection."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.bpe import LETTER, _chunks, code_point_classes
from docloom.llm.common import tidy

BITS = 16
DIM = 16
ORDERS = (2, 3, 4)
#: Bounds of the training sample: documents a language, documents in all (each language has the same share of them), and characters and subwords of an example.
DOCS_A_LANGUAGE = 400
DOCS_IN_ALL = 20_000
MAX_TRAIN_CHARS = 100_000
MAX_TRAIN_SUBWORDS = 2000
EPOCHS = 6
#: Accepted predictions must be right this often, as a share of how often the better scored half is, on the calibration examples (so labels that are wrong
#: everywhere alike do not count); a score below the lowest such threshold, or below FLOOR, is rejected.
PRECISION = 0.99
FLOOR = 0.4
UNDETERMINED = "und"


@functools.cache
def _lower_letters() -> np.ndarray:
    """For each code point its lower case, 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(code_point_classes() <= LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def subwords(data: bytes, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts of these sizes in bytes, one behind the other -> for each order the buckets at each place (2**BITS: none starts there), and the place of each text.

    Letters are lower-cased, other characters between them count as one boundary; a subword holds boundaries at its ends only.
    """
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.cumsum(width)
    firsts = np.searchsorted(ends, np.concatenate(([0], np.cumsum(sizes)[:-1])), "right")
    s = np.insert(_lower_letters()[points], firsts, 0)
    firsts = firsts + np.arange(len(firsts))
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    keep[firsts] = True
    at = np.cumsum(keep)[firsts] - 1
    s = np.append(s[keep], np.zeros(max(ORDERS), np.uint32))
    n = len(s) - max(ORDERS)
    letter = s != 0
    none = np.uint32(1 << BITS)
    out = []
    h = s[:n] * np.uint32(0x9E3779B1) + np.uint32(17)
    inner = np.ones(n, bool)
    for k in range(2, max(ORDERS) + 1):
        nxt = s[k - 1 : n + k - 1]
        h = (h ^ nxt) * np.uint32(0x85EBCA6B)
        h = h ^ (h >> np.uint32(13))
        if k > 2:
            inner = inner & letter[k - 2 : n + k - 2]
        if k in ORDERS:
            ok = inner & (letter[:n] | letter[k - 1 : n + k - 1]) if k == 2 else inner
            mixed = (h * np.uint32(0xC2B2AE35) + np.uint32(k)) >> np.uint32(32 - BITS)
            out.append(np.where(ok, mixed, none))
    return out, at


@dataclass
class Model:
    """languages, a vector of each bucket, what turns mean vectors into logits (None: they are, which is faster for few languages), the bias, 1 / temperature
    and the rejection threshold. Its size is 2**BITS x DIM numbers at most, and DIM a language."""

    languages: list[str]
    vectors: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    sharpness: float
    threshold: float

    def scores(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each language, number of subwords) of each text."""
        buckets, at = subwords(data, sizes)
        total = np.zeros((len(at), self.vectors.shape[1]))
        count = np.zeros(len(at), np.int64)
        for b in buckets:
            total += np.add.reduceat(self.vectors[b], at, axis=0, dtype=np.float64)
            count += np.add.reduceat((b >> BITS) == 0, at, dtype=np.int64)
        mean = total / np.maximum(count, 1)[:, None]
        return _softmax(((mean if self.weights is None else mean @ self.weights) + self.bias) * self.sharpness), count


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _examples(text: str, rng: np.random.Generator) -> list[str]:
    """A document's examples: itself, and a few stretches of it of 20 to 400 characters, so that short texts are learnt too."""
    out = [text]
    for size in (20, 40, 80, 160, 400):
        at = int(rng.integers(0, max(1, len(text) - size)))
        out.append(text[at : at + size])
    return out


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """rows: (language, text). A fifth of them only calibrates. None if no row has a letter."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    fit: list[tuple[np.ndarray, int]] = []
    check: list[tuple[np.ndarray, int]] = []
    number = {lang: i for i, lang in enumerate(languages)}
    for k, (lang, text) in enumerate(rows):
        for j, x in enumerate(_examples(text, rng)):
            data = x.encode()
            if not data:
                continue
            b = np.concatenate(subwords(data, np.array([len(data)]))[0])
            b = b[b < 1 << BITS]
            if len(b):
                if k % 5 == 4:
                    check.append((b, number[lang]))
                else:
                    fit.append((b if len(b) <= MAX_TRAIN_SUBWORDS else rng.choice(b, MAX_TRAIN_SUBWORDS, replace=False), number[lang]))
    if not fit:
        return None
    dim, n = DIM, len(languages)
    embedding = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    weights = rng.normal(0, 0.1, (dim, n)).astype(np.float32)
    bias = np.zeros(n, np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            b, y = fit[i]
            rate = 0.5 * (1 - done / steps) + 0.01
            done += 1
            v = embedding[b].mean(axis=0)
            p = _softmax(v @ weights + bias)
            p[y] -= 1
            back = weights @ p
            weights -= rate * np.outer(v, p)
            bias -= rate * 0.1 * p
            np.subtract.at(embedding, b, (rate * back).astype(np.float32) * np.float32(4 / max(4, len(b)) * 4))
    vectors = np.zeros(((1 << BITS) + 1, min(n, dim)), np.float32)
    vectors[:-1] = embedding @ weights if n <= dim else embedding
    head = None if n <= dim else weights.astype(np.float64)
    model = Model(languages, vectors, head, bias.astype(np.float64), 1.0, 0.0)
    model.sharpness, model.threshold = _calibrate(model, check or fit)
    return model


def _calibrate(model: Model, check: list[tuple[np.ndarray, int]]) -> tuple[float, float]:
    """The sharpness (1 / temperature) of least log loss, and the lowest threshold above which predictions are right as often as PRECISION asks."""
    mean = np.array([model.vectors[b].mean(axis=0, dtype=np.float64) for b, _ in check])
    x = (mean if model.weights is None else mean @ model.weights) + model.bias
    y = np.array([k for _, k in check])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(_softmax(x * g)[np.arange(len(y)), y], 1e-12)).mean() for g in grid]
    sharpness = float(grid[int(np.argmin(losses))])
    p = _softmax(x * sharpness)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION * precision[(len(order) - 1) // 2])
    return sharpness, float(max(FLOOR, score[order][good[-1]]))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the key's text modulo 4 is 2. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_labelled(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = DOCS_A_LANGUAGE, in_all: int = DOCS_IN_ALL) -> list[tuple[str, str]]:
    """(language, text) of at most `docs` rows of each language, and of in_all / languages of them, none held out; of each text its first MAX_TRAIN_CHARS characters.

    Every language is learnt, the rarest too, unless there are more than in_all. Rows are picked by a hash of key and text; equal rows count once.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = df.where(c(lang).isNotNull() & c(text).isNotNull() & ~held_out(c(key))).select(c(lang).alias("lang"), F.substring(c(text), 1, MAX_TRAIN_CHARS).alias("text"), F.xxhash64(c(key), c(text)).alias("h"))
    counts = rows.groupBy("lang").count()
    languages, most = counts.agg(F.count(F.lit(1)), F.max("count")).first()
    if not languages:
        return []
    docs = max(1, min(docs, in_all // languages))
    # Some more than the share of a language that is wanted is drawn before rows are ordered, so no task orders a whole language.
    shares = counts.select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(2.0 * docs + 20) / F.col("count")).alias("share"))
    drawn = rows.join(F.broadcast(shares) if languages <= in_all else shares, F.col("lang") == F.col("of")).where(F.pmod(F.col("h"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    once = drawn.groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = once.withColumn("place", place).where(F.col("place") <= docs).orderBy("h", "lang").limit(in_all)
    return sorted((r["lang"], r["text"]) for r in picked.collect())


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = DOCS_A_LANGUAGE) -> DataFrame:
    """The rows of df (all columns) with lang_pred, score and rejected; columns of these names are replaced.

    The model learns from a bounded sample of labelled rows (see sample_labelled) and predicts every whole text; nothing but the text enters a
    prediction. lang_pred: a learned language, or `und` with score 0 if the text is null or holds no letter (or no row is labelled). score: the
    calibrated probability. rejected: no letters, or a score below the calibrated threshold; without a model, only texts without letters.
    Repeated rows and ties are predicted alike, very long texts as a whole. An empty table: no rows. Rows map one to one; nothing but the sample is moved.
    """
    spark = df.sparkSession
    keep = [x for x in df.columns if x.lower() not in ("lang_pred", "score", "rejected")]
    base = df.select(*[f"`{x}`" for x in keep])
    model = train(sample_labelled(df, key, text, lang, docs))
    shared = spark.sparkContext.broadcast(model)  # 2**BITS x DIM floats at most
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("rejected", T.BooleanType(), False)])
    at = keep.index(next(x for x in keep if x.lower() == text.lower()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        letters = code_point_classes() <= LETTER
        for batch in batches:
            lang_pred = np.full(batch.num_rows, UNDETERMINED, object)
            score = np.zeros(batch.num_rows)
            rejected = np.ones(batch.num_rows, bool)
            for rows, data, sizes in _chunks(batch.column(at)):
                if own is None:
                    ends = np.cumsum(sizes)
                    for r, a, b in zip(rows.tolist(), (ends - sizes).tolist(), ends.tolist()):
                        rejected[r] = not letters[np.frombuffer(data[a:b].decode().encode("utf-32-le"), np.uint32)].any()
                    continue
                p, n = own.scores(data, sizes)
                full = n > 0
                best = p.argmax(axis=1)
                top = p[np.arange(len(best)), best]
                lang_pred[rows[full]] = np.array(own.languages, object)[best[full]]
                score[rows[full]] = top[full]
                rejected[rows[full]] = top[full] < own.threshold
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang_pred, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return base.mapInArrow(tidy(run), schema)
