"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every feature of a word (its lower-case form, its shape, whether it repeats a
word just before) owns a sparse ternary index vector that follows from its
digest alone. On a bounded sample of labelled documents the vectors of features
gather the index vectors of the features around them: random indexing. A
document is the mean of its words' vectors, with the extremes of that mean over
its segments. A network of two layers, in numpy, turns this into a logit, and
the logit's temperature is fitted on sample documents that training never saw,
so that scores are probabilities.

The sample is bounded by SAMPLE rows, each of at most SAMPLE_CHARS characters;
scoring reads whole texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, tidy, trim
from gymlake.llm.kernel import LOWER, SPACE, U, Words, chunks, mix, mix_int, powers

SAMPLE, SAMPLE_CHARS = 4000, 30_000
DIMENSIONS = 32
WORDS, SHAPES = 1 << 15, 1 << 12
SEGMENT = 64
HIDDEN = 24
THRESHOLD = 0.7

_KIND = np.full(256, 4, np.uint8)  # letters of other scripts
_KIND[:128] = np.arange(128) % 5 + 5  # each kind of mark
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
_KIND[128:] = 3
for _mark in b"#*$%&|<>!?@^~=+_":
    _KIND[_mark] = 16 + _mark % 64


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the form and of the shape of each word."""
    forms = words.digests(LOWER)
    kinds = _KIND[words.data]
    first = np.zeros(len(kinds), bool)
    first[words.starts] = True
    new = ~SPACE[words.data] & (first | (kinds != np.concatenate([kinds[:1] + 1, kinds[:-1]])))
    body = kinds[new].astype(np.uint64) + U(1)
    begin = np.searchsorted(np.flatnonzero(new), words.starts)
    count = np.diff(np.append(begin, len(body)))
    place = np.arange(len(body)) - np.repeat(begin, count)
    shape = mix(np.add.reduceat(body * powers(int(count.max()))[place], begin)) if len(begin) else np.empty(0, np.uint64)
    again = np.zeros(len(forms), np.uint64)
    again[1:] += forms[1:] == forms[:-1]
    again[2:] += U(2) * (forms[2:] == forms[:-2])
    size = np.minimum((words.ends - words.starts) // 4, 7).astype(np.uint64)
    rows = mix(shape ^ mix(again * U(8) + size + U(1)))
    return (forms % U(WORDS)).astype(np.int64), (rows % U(SHAPES)).astype(np.int64) + WORDS


def index_vectors(rows: int = WORDS + SHAPES, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """Four entries of +1 or -1 each, drawn from the row's digest."""
    out = np.zeros((rows, dimensions), np.float32)
    at = np.arange(rows)
    for k in range(4):
        drawn = mix(at.astype(np.uint64) + U(mix_int(seed * 100 + k)))
        out[at, (drawn % U(dimensions)).astype(np.int64)] += np.where(drawn >> U(40) & U(1), 1.0, -1.0).astype(np.float32)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float


def _pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document: mean, least and most over segments, log of the word count. No words: zeros."""
    words = Words(data, offsets)
    n = np.diff(words.first)
    out = np.zeros((len(n), 3 * vectors.shape[1] + 1), np.float32)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    forms, shapes = word_features(words)
    own = vectors[forms] + vectors[shapes]
    segments = -(-n // SEGMENT)
    owner = np.repeat(np.arange(len(n)), segments)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    begin = words.first[:-1][owner] + place * SEGMENT
    size = np.minimum(SEGMENT, words.first[1:][owner] - begin)
    sums = np.add.reduceat(own, begin, axis=0)
    first = (np.cumsum(segments) - segments)[some]
    d = vectors.shape[1]
    means = sums / size[:, None]
    out[some, :d] = np.add.reduceat(sums, first, axis=0) / n[some, None]
    out[some, d : 2 * d] = np.minimum.reduceat(means, first, axis=0)
    out[some, 2 * d : 3 * d] = np.maximum.reduceat(means, first, axis=0)
    out[some, -1] = np.log1p(n[some])
    return out


def pooled(vectors: np.ndarray, texts: pa.Array) -> np.ndarray:
    parts = [_pool(vectors, data, offsets) for _, _, data, offsets in chunks(texts, 256 << 10)]
    return np.concatenate(parts) if parts else np.zeros((0, 3 * vectors.shape[1] + 1), np.float32)


def _context_vectors(texts: pa.Array) -> np.ndarray:
    index = index_vectors()
    gathered = np.zeros_like(index)
    for _, _, data, offsets in chunks(texts, 256 << 10):
        words = Words(data, offsets)
        if len(words) < 2:
            continue
        forms, shapes = word_features(words)
        document = np.searchsorted(words.first, np.arange(len(words)), side="right")
        around = np.zeros((len(words), index.shape[1]), np.float32)
        both = index[forms] + index[shapes]
        near = (document[1:] == document[:-1])[:, None]
        around[1:] += both[:-1] * near
        around[:-1] += both[1:] * near
        for rows in (forms, shapes):
            order = np.argsort(rows, kind="stable")
            begin = np.flatnonzero(np.diff(rows[order], prepend=-1))
            gathered[rows[order][begin]] += np.add.reduceat(around[order], begin, axis=0)
    length = np.linalg.norm(gathered, axis=1, keepdims=True)
    out = index / 2 + np.where(length > 0, gathered / np.maximum(length, 1e-9), 0)
    return out.astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logits(layers, x):
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def fit(texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = 400) -> Model:
    """Train on texts with labels 0/1; every fifth text only calibrates. Without texts the score is 1/2 everywhere."""
    array = pa.array(texts, pa.string())
    vectors = _context_vectors(array)
    x, y = pooled(vectors, array).astype(np.float64), np.asarray(labels, np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(3 * DIMENSIONS + 1), np.ones(3 * DIMENSIONS + 1))
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(())]
    layers[2] = rng.normal(0, HIDDEN**-0.5, HIDDEN) if len(x) else layers[2]
    held = np.arange(len(x)) % 5 == 4
    tx, ty = x[~held], y[~held]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    for step in range(1, epochs + 1 if len(tx) else 1):
        w1, b1, w2, b2 = layers
        hidden = np.tanh(tx @ w1 + b1)
        error = (_sigmoid(hidden @ w2 + b2) - ty) / len(tx)
        back = np.outer(error, w2) * (1 - hidden**2)
        gradients = [tx.T @ back + 3e-4 * w1, back.sum(0), hidden.T @ error + 3e-4 * w2, error.sum()]
        for i, g in enumerate(gradients):
            m, v = moments[i]
            m[...], v[...] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            layers[i] = layers[i] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if held.sum() >= 10 and len(set(y[held])) == 2:
        z = _logits(layers, x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        losses = [-(y[held] * np.log(_sigmoid(z / t) + 1e-12) + (1 - y[held]) * np.log(1 - _sigmoid(z / t) + 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(losses))])
    return Model(vectors, mean, scale, tuple(layers), temperature)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    x = (pooled(model.vectors, texts) - model.mean) / model.scale
    return _sigmoid(_logits(model.layers, x) / model.temperature)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """At most `rows` labelled documents, drawn by the digest of doc_id among labels that `allowed` admits.

    Labels of one document that contradict each other count as 0 (quality) or 1
    (toxic), the cautious side. Texts over `chars` characters are left out, so
    the driver holds at most rows * chars characters.
    """
    side = F.min if label == "quality" else F.max
    drawn = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy(F.col("doc_id").alias("_key")).agg(side(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(rows)
    )
    got = docs.select(F.col("doc_id").alias("_key"), F.coalesce("text", F.lit("")).alias("_text")).where(F.length("_text") <= chars)
    pdf = got.join(F.broadcast(drawn), "_key").orderBy(F.xxhash64("_key"), "_key").limit(rows).toPandas()  # drawn: at most `rows` pairs of numbers
    return pdf["_text"].tolist(), pdf["_label"].to_numpy(dtype=np.int64)


def folds(remainder: int, modulus: int, column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % modulus == remainder


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels outside the held-out fold (crc32 of doc_id mod 4 is 2)."""
    model = fit(*labelled_sample(docs, labels, "quality", ~folds(2, 4)))
    trim()
    return model


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Null and empty texts get the score of no words.

    A null doc_id is not held out. Repeated rows are scored each. An empty table gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score_texts(shared.value, batch.column(2)), pa.float64())], ["doc_id", "held_out", "score"])

    held = F.coalesce(folds(2, 4), F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score is under the threshold.

    Null, empty and blank texts have the score of no words; a null doc_id changes nothing. Repeated rows stay or go alike. Without
    labels every score is 1/2, so all go. An empty table gives no rows. Columns and their order stay, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(shared.value, batch.column(at)) >= threshold))

    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).mapInArrow(tidy(run), docs.toDF(*names).schema).toDF(*docs.columns)
