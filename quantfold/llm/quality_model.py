"""Quality classifier on random-indexing vectors.

Tokens are runs of letters and digits or runs of other characters, in their case. A
token has a sparse random index vector (two of ``DIMS`` places, plus or minus one, from
its hash). The context vector of a token bucket is the sum of the index vectors of its
neighbours within ``REACH`` places, over the whole corpus; sums are of whole numbers, so
they do not depend on the order of the rows. The table has a fixed size (``BUCKETS`` x
``DIMS``): tokens share buckets by hash, and none is left out.

A document is the mean and the spread of its tokens' context vectors, scaled to unit
length, and the logarithm of its length. A two-layer network is trained on the driver
from a bounded sample of labelled documents (``SAMPLE`` rows in the order of a hash of
their id); a temperature fitted on a part that training has not seen calibrates its
probabilities. Only the text is an input.

Defined cases: null, empty and blank texts have zero vectors and get the network's score
for those; without labels of both kinds the score is the smoothed share of label 1;
repeated labels count by their largest value; a null id is not held out; repeated rows
give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantfold.llm import wordscan

BUCKETS, DIMS, REACH = 1 << 14, 32, 2
PARTS = 16
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.003, 1e-4


def _tokens(texts: pa.Array) -> wordscan.Words:
    return wordscan.scan(texts, fold=False, kinds=wordscan.PIECES)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over all documents."""

    def add(batches):
        total = np.zeros(BUCKETS * DIMS, np.float64)
        for b in batches:
            texts = b.column(0)
            for lo, hi in wordscan.chunks(texts):
                words = _tokens(texts.slice(lo, hi - lo))
                h, row = words.hash, np.repeat(np.arange(words.rows), np.diff(words.first))
                base = _bucket(h) * DIMS
                index = [((h >> np.uint64(20 + 16 * j)).astype(np.int64) % DIMS, 1.0 - 2.0 * ((h >> np.uint64(35 + 16 * j)) & np.uint64(1)).astype(np.float64)) for j in range(2)]
                keys, signs = [], []
                for o in range(1, REACH + 1):
                    same = np.flatnonzero(row[o:] == row[:-o])
                    for place, sign in index:
                        keys += [base[same] + place[same + o], base[same + o] + place[same]]
                        signs += [sign[same + o], sign[same]]
                if keys:
                    total += np.bincount(np.concatenate(keys), np.concatenate(signs), BUCKETS * DIMS)
        if total.any():
            yield wordscan.pack(total.astype(np.int64), PARTS)

    sums = wordscan.merged(docs.select("text").mapInArrow(add, wordscan.PACKED), np.int64, PARTS)
    return sums.reshape(BUCKETS, DIMS) if len(sums) else np.zeros((BUCKETS, DIMS), np.int64)


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    size = np.sqrt((sums.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (sums / np.maximum(size, 1)).astype(np.float32)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and length of each text's token vectors."""
    out = [np.zeros((0, 2 * DIMS + 1))]
    for lo, hi in wordscan.chunks(texts):
        words = _tokens(texts.slice(lo, hi - lo))
        n = np.diff(words.first)
        got = np.zeros((words.rows, 2 * DIMS + 1))
        full = np.flatnonzero(n)
        if len(full):
            bucket = _bucket(words.hash)
            for at in range(0, len(full), 64):
                rows = full[at : at + 64]
                a, z = words.first[rows[0]], words.first[rows[-1] + 1]
                v = vectors[bucket[a:z]]
                begin = words.first[rows] - a
                mean = np.add.reduceat(v, begin, axis=0, dtype=np.float64) / n[rows, None]
                square = np.add.reduceat(v * v, begin, axis=0, dtype=np.float64) / n[rows, None]
                got[rows, :DIMS] = mean
                got[rows, DIMS:-1] = np.sqrt(np.maximum(square - mean**2, 0))
        got[:, -1] = np.log1p(n)
        out.append(got)
    return np.concatenate(out)


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Two layers by Adam on four fifths of the rows, temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    rest, own = order[: len(x) // 5], order[len(x) // 5 :]
    center, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    net = Network(center, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    inputs = (x - center) / scale
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            hidden = np.tanh(inputs[at] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -30, 30))) - y[at]) / len(at)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            slopes = [inputs[at].T @ back + DECAY * values[0], back.sum(axis=0), hidden.T @ error + DECAY * values[2], error.sum(keepdims=True)]
            step += 1
            for v, g, m, s in zip(values, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if len(rest):
        z = net.logits(x[rest])
        net.temperature = min(np.geomspace(0.25, 8, 81), key=lambda t: _loss(z / t, y[rest]))
    return net


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    vectors = unit_vectors(context_sums(docs))
    shared = spark.sparkContext.broadcast(vectors)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    width = 2 * DIMS + 1

    def describe(batches):
        for b in batches:
            x = features(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["quality", "x"])

    # at most ``sample`` labels, so their side may be broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(describe, "quality int, x array<float>").collect()
    rows.sort(key=lambda r: (r.quality, r.x))
    x, y = np.array([r.x for r in rows], np.float64).reshape(-1, width), np.array([r.quality for r in rows], np.float64)
    model = spark.sparkContext.broadcast(train(x, y) if 0 < y.sum() < len(y) else float((y.sum() + 1) / (len(y) + 2)))

    def score(batches):
        net = model.value
        for b in batches:
            s = np.full(b.num_rows, net) if isinstance(net, float) else net.scores(features(b.column(1), shared.value))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
