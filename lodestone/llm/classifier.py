"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated by temperature.

A word's index vector is sparse and random: a few signed entries at places
that hashes of the word and of its shape choose, so any word has one and no
vocabulary is kept. Frequent words also get a context vector, the sum of the
index vectors around them in the training texts. A document's vector is the
mean of its words' vectors, with a few measures of their variety. The network
(numpy) is trained on a bounded sample of labelled rows; a part of the sample
sets the temperature of its probabilities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrow import Words, hash_strings, mix64, slices, string_column
from lodestone.plans.staging import stage

DIM = 96
ENTRIES = 4
WINDOW = 2
EXTRA = 5


class _Shape(dict):
    """Characters to their kinds: A, a, 0, white space; other characters stand for themselves."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        out = "A" if kind == "Lu" or kind == "Lt" else "a" if kind[0] in "LM" else "0" if kind[0] == "N" else chr(c)
        self[c] = out
        return out


_SHAPE = _Shape()
_RUNS = re.compile(r"([^\n])\1+")


def shapes(words: pa.Array) -> pa.Array:
    """The words with each run of characters of one kind as one character."""
    if len(words) == 0:
        return words
    # A word holds no line break, so the words can be worked off in one string.
    return pa.array(_RUNS.sub(r"\1", "\n".join(words.to_pylist()).translate(_SHAPE)).split("\n"), pa.string())


def index_entries(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the words' index vectors, one row a word."""
    places, weights = [], []
    for values, weight, salt in ((pc.utf8_lower(words), 0.5, 1), (shapes(words), 1.0, 101)):
        h = hash_strings(values)
        for k in range(ENTRIES):
            x = mix64(h + np.uint64(salt + k))
            places.append((x % np.uint64(DIM)).astype(np.int64))
            weights.append(np.where(x >> np.uint64(63) == 1, weight, -weight))
    if len(words) == 0:
        return np.zeros((0, 2 * ENTRIES), np.int64), np.zeros((0, 2 * ENTRIES))
    return np.stack(places, 1), np.stack(weights, 1)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the words with a context vector
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -30, 30)))


def document_vectors(texts: pa.Array, known: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One row a text: mean index vector, mean context vector, measures of size and variety. Empty texts: zeros."""
    words = Words(texts)
    n = len(texts)
    counts = np.maximum(words.counts, 1).astype(np.float64)
    places, weights = index_entries(words.unique)
    base = words.doc * DIM
    pooled = np.zeros(n * DIM)
    for k in range(places.shape[1]):
        if len(words.ids):
            pooled += np.bincount(base + places[words.ids, k], weights[words.ids, k], minlength=n * DIM)
    out = np.zeros((n, 2 * DIM + EXTRA))
    out[:, :DIM] = pooled.reshape(n, DIM) / counts[:, None]
    if len(words.ids):
        h = hash_strings(pc.utf8_lower(words.unique))
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at = np.where(known[at] == h, at, -1)[words.ids]
            has = at >= 0
            for a in range(0, n, 256):  # bounded blocks of texts by known words
                lo, hi = words.start[a], words.start[min(n, a + 256)]
                m = has[lo:hi]
                rows = min(n, a + 256) - a
                seen = np.bincount((words.doc[lo:hi][m] - a) * len(known) + at[lo:hi][m], minlength=rows * len(known)).reshape(rows, -1)
                out[a : a + rows, DIM : 2 * DIM] = seen.astype(np.float32) @ context / counts[a : a + rows, None]
        pair = words.doc[1:] == words.doc[:-1]
        same = np.bincount(words.doc[1:][pair & (words.ids[1:] == words.ids[:-1])], minlength=n)
        kinds = np.bincount(np.unique(words.doc * np.int64(len(words.unique)) + words.ids) // len(words.unique), minlength=n)
        chars = pc.utf8_length(words.unique).to_numpy()[words.ids]
        out[:, -5] = np.log1p(words.counts)
        out[:, -4] = kinds / counts
        out[:, -3] = same / counts
        out[:, -2] = np.bincount(words.doc, chars, minlength=n) / counts
        out[:, -1] = (words.counts == 0).astype(float)
    else:
        out[:, -1] = 1.0
    return out


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int) -> tuple:
    """A two-layer network by Adam on the log loss, and the temperature that fits the last fifth of the rows."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    z, y = x[order].astype(np.float64), y[order]
    mean, scale = z.mean(0), z.std(0) + 1e-3
    z -= mean
    z /= scale
    cut = max(1, len(z) * 4 // 5)
    zt, yt = z[:cut], y[:cut]
    w = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    t = 0
    for _ in range(epochs):
        for i in np.array_split(rng.permutation(cut), max(1, cut // 128)):
            a = np.maximum(0, zt[i] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30)))
            d = (p - yt[i]) / len(i)
            back = np.outer(d, w[2]) * (a > 0)
            grads = [zt[i].T @ back + 1e-4 * w[0], back.sum(0), a.T @ d + 1e-4 * w[2], d.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    zv, yv = (z[cut:], y[cut:]) if len(z) > cut + 20 else (z, y)
    logits = np.maximum(0, zv @ w[0] + w[1]) @ w[2] + w[3]

    def loss(temperature: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / temperature, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(yv * np.log(p) + (1 - yv) * np.log(1 - p)).mean())

    return mean, scale, w[0], w[1], w[2], float(w[3][0]), float(min(np.exp(np.linspace(-0.7, 3, 75)), key=loss))


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
    known_words: int = 2048,
    hidden: int = 32,
    epochs: int = 30,
    seed: int = 5,
) -> Model:
    """Train on at most ``max_rows`` labelled rows outside the held-out fifth.

    Held out are the ids whose crc32 (of the id as text) is 0 modulo 5. The
    sample is the ``max_rows`` smallest by a hash of the id; an id with
    several labels has the largest, one with several texts one of them. Without labelled rows, or with one class
    only, the model gives every text that class's smoothed share.
    """
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    ids = ids.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = ids.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_rows)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id IS NOT NULL")
    # At most max_rows ids are broadcast; of several texts of an id the one of smallest hash is taken.
    sample = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_y").alias("_y"), F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    sample = stage(sample.repartition(12, "_id"), "classifier-sample")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(string_column(part, "_text"))
                lower = pc.utf8_lower(words.unique)
                n = np.bincount(words.ids, minlength=len(words.unique))
                yield pa.RecordBatch.from_arrays([pa.array(hash_strings(lower).view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counted = sample.mapInArrow(neighbours, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(known_words).collect()
    known = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(known), DIM))
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(string_column(part, "_text"))
                if not len(words.ids):
                    continue
                h = hash_strings(pc.utf8_lower(words.unique))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                at = np.where(known[at] == h, at, -1)[words.ids]
                places, weights = index_entries(words.unique)
                for o in (o for o in range(-WINDOW, WINDOW + 1) if o):
                    a = slice(max(0, -o), len(at) - max(0, o))
                    b = slice(max(0, o), len(at) + min(0, o))
                    use = (at[a] >= 0) & (words.doc[a] == words.doc[b])
                    rows_, other = at[a][use], words.ids[b][use]
                    for k in range(places.shape[1]):
                        total += np.bincount(rows_ * DIM + places[other, k], weights[other, k], minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    context = np.zeros((len(known), DIM))
    if len(known):
        for (sums,) in sample.coalesce(12).mapInArrow(contexts, "sums binary").collect():  # at most 12 rows of some 1.5 MB
            context += np.frombuffer(sums).reshape(context.shape)
    context = (context / (np.linalg.norm(context, axis=1, keepdims=True) + 1e-9)).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                x = document_vectors(string_column(part, "_text"), known, context).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.string()), part.column("_y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "_y", "x"])

    got = sample.coalesce(12).mapInArrow(vectors, "_id string, _y int, x binary").toArrow().sort_by("_id")  # max_rows vectors
    y = got.column("_y").to_numpy().astype(np.float64)
    size = 2 * DIM + EXTRA
    if len(got) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(known, context, np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), size)
    return Model(known, context, *_train(x, y, hidden, epochs, seed))


def score(df: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's score (0 to 1) and predicted class, beside its id and the columns in ``keep``.

    Null and empty texts are scored as texts without words; repeated rows are
    kept, each with its own result; an empty input gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    extra = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of words and weights

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "_text"):
                s = m.score(document_vectors(string_column(part, "_text"), m.words, m.context))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *(part.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, *keep, "score", "predicted"]
                )

    return rows.mapInArrow(emit, f"`{id_col}` {kind}{extra}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the fifth that is never trained on (a null id does not, and is not trained on either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
