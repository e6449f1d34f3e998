"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

A word vector is the sum of the sparse random index vectors of the words near it, over
all documents. Words are hashed to SLOTS slots, so the table has a fixed size and its
parts are summed before and after the shuffle. A document pools its words' vectors:
mean, deviation, and mean product of neighbours. A numpy network with one hidden layer
learns from a bounded sample of labelled documents; a fifth of that sample is kept back
to find the temperature that calibrates its probabilities.

Words are runs of letters, of digits or of other signs, as written (upper case matters).
Labels of at most ``sample_rows`` rows are used (those with the smallest hashed ids).
Null or blank text pools to zeros; very long texts are pooled whole, in slices of about
1 MiB of rows; documents that repeat are scored each; null labels or ids teach nothing, a
document labelled twice counts twice. Extra columns are ignored; no documents give no
rows. Without labels of both classes every score is the share of good labels (0 without
any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, materialise, mix64, slices, string_bytes, text_or_empty
from .toxicity import held_out, labelled_sample

SLOTS = 1 << 13
WIDTH = 32
#: Words on either side that make a word's surroundings.
NEAR = 2
#: Entries of an index vector that are not zero.
FILLED = 4
HIDDEN = 48
SAMPLE_ROWS = 12_000
EPOCHS = 60
PREDICT = 0.3

# byte -> class of sign: 0 blank, 1 letter (and every byte beyond ASCII), 2 digit, 3 other
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def index_vectors() -> np.ndarray:
    """A sparse vector of -1, 0 and 1 for each slot, by the slot's own random numbers."""
    out = np.zeros((SLOTS, WIDTH), np.float32)
    slot = np.arange(SLOTS, dtype=np.uint64)
    for k in range(FILLED):
        h = mix64(slot * np.uint64(FILLED) + np.uint64(k + 1))
        out[np.arange(SLOTS), (h >> np.uint64(8)).astype(np.int64) % WIDTH] += np.where(h & np.uint64(1), 1, -1)
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all words, and where each text's words begin (n + 1 bounds)."""
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(data))
    word = kind[begin] > 0
    begin, end = begin[word], end[word]
    slot = mix64(PrefixHash(data).of(begin, end) + (end - begin).astype(np.uint64)) & np.uint64(SLOTS - 1)
    return slot.astype(np.int64), np.searchsorted(begin, at)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, at = string_bytes(batch.column("text"))
        for i, j in slices(at, 1 << 20):
            yield batch.slice(i, j - i), *tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])


def _surroundings(batches):
    """A task's part of the word vectors: (slot, v0, v1, ...)."""
    index, total = index_vectors(), np.zeros((SLOTS, WIDTH))
    for _, slot, bounds in _chunks(batches):
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        around = np.zeros((len(slot), WIDTH), np.float32)
        for k in range(1, NEAR + 1):
            if len(slot) > k:
                same = (doc[k:] == doc[:-k])[:, None]
                around[k:] += index[slot[:-k]] * same
                around[:-k] += index[slot[k:]] * same
        for d in range(WIDTH):
            total[:, d] += np.bincount(slot, around[:, d], SLOTS)
    used = np.flatnonzero(np.abs(total).sum(1))
    for i in range(0, len(used), 4096):
        k = used[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[k, d]).astype(np.int64)) for d in range(WIDTH))], ["slot", *(f"v{d}" for d in range(WIDTH))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit vectors of all slots; zeros for slots without words."""
    names = [f"v{d}" for d in range(WIDTH)]
    parts = docs.mapInArrow(_surroundings, "slot int, " + ", ".join(f"{n} long" for n in names))
    pdf = parts.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toArrow().to_pandas()
    out = np.zeros((SLOTS, WIDTH))
    out[pdf["slot"]] = pdf[names].to_numpy(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]).astype(np.float32)


def pool(vectors: np.ndarray, slot: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds)
    out = np.zeros((len(n), 3 * WIDTH + 1))
    have = np.flatnonzero(n)
    if len(have):
        x, at, size = vectors[slot].astype(np.float64), bounds[:-1][have], n[have][:, None]
        mean = np.add.reduceat(x, at) / size
        out[have, :WIDTH] = mean
        out[have, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(x * x, at) / size - mean**2, 0))
        beside = np.zeros_like(x)
        beside[1:] = x[1:] * x[:-1]
        beside[at] = 0
        out[have, 2 * WIDTH : 3 * WIDTH] = np.add.reduceat(beside, at) / np.maximum(size - 1, 1)
        out[have, -1] = np.log1p(n[have]) / 10
    return out


class Network:
    """Two layers: tanh units, then one logistic output; features are standardised first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        keep = rng.random(len(x)) < 0.2
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        both = len(set(y[~keep])) == 2 and len(set(y[keep])) == 2
        self._fit(z[~keep] if both else z, y[~keep] if both else y, rng)
        if both:
            logit, truth = self._forward(z[keep])[1], y[keep]
            loss = lambda t: np.mean(np.logaddexp(0, logit / t) - truth * logit / t)
            self.temperature = float(min(np.geomspace(0.25, 16, 97), key=loss))

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3][0]

    def _fit(self, z: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 128):
                k = order[i : i + 128]
                h, logit = self._forward(z[k])
                slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[k]) / len(k)
                back = slope[:, None] * self.w[2] * (1 - h * h)
                grads = [z[k].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ slope + 1e-4 * self.w[2], slope.sum(keepdims=True)]
                step += 1
                for w, g, a, b in zip(self.w, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        logit = self._forward((x - self.mean) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _features(vectors):
    def run(batches):
        for batch, slot, bounds in _chunks(batches):
            f = pool(vectors.value, slot, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(f.tolist(), pa.list_(pa.float64()))], ["quality", "f"])

    return run


def _score(vectors, network):
    def run(batches):
        for batch, slot, bounds in _chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.probability(pool(vectors.value, slot, bounds)))], ["doc_id", "score"])

    return run


def score_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = materialise(labelled_sample(labels, "quality", sample_rows))
    seen = {r["quality"]: r["count"] for r in sample.groupBy("quality").count().collect()}
    if len(seen) < 2:
        scored = docs.select("doc_id", F.lit(float(bool(seen.get(1)))).alias("score"))
    else:
        vectors = spark.sparkContext.broadcast(word_vectors(docs.select("text")))
        rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("text", "quality")
        got = rows.mapInArrow(_features(vectors), "quality int, f array<double>").toArrow().to_pandas()
        y = got["quality"].to_numpy(float)
        if len(set(y)) < 2:
            scored = docs.select("doc_id", F.lit(float(len(y) > 0 and y[0])).alias("score"))
        else:
            x = np.vstack(got["f"].to_numpy())
            order = np.lexsort((*x.T[:8], y))  # the same network whatever order the rows came in
            scored = docs.mapInArrow(_score(vectors, Network(x[order], y[order])), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
