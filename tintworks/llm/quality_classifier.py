"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of the character
3- to 5-grams of its words (word ends marked by the separator), all hashed into a
fixed number of buckets.  A linear layer and a softmax give the class
probabilities; vectors and layer are trained together by stochastic gradient
descent in numpy.  At scoring time the layer folds into the vectors, so that the
score of a text is the mean of one number for each of its features.

The only thing fitted on a sample: `sample_rows` labelled rows at most, half of
each class, those of the smallest hash of their id.  Executors turn each sampled
whole text into at most `buckets` counts, so the driver gets a bounded amount.

Edge cases: null and empty texts have no features and get the score of the prior;
labels that are null, other than 0 and 1, or contradictory for an id are left out;
with no usable label the score is 0.5 everywhere; repeated rows get equal scores;
an empty table gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, given
from .textkernel import IS_SEP, chunks, mix64


@dataclass(frozen=True)
class ClassifierConfig:
    bits: int = 15
    dims: int = 8
    sizes: tuple[int, ...] = (3, 4, 5)
    sample_rows: int = 4096
    epochs: int = 6
    min_steps: int = 900
    batch: int = 32
    rate: float = 4.0
    seed: int = 7


def _feature_buckets(chunk, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and marked character n-gram of a chunk."""
    text = chunk.data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    sep = IS_SEP[np.minimum(points, 0x7F)] & (points < 0x80)
    # rows by code point: a text's first code point is its first byte that continues no character
    first_bytes = np.cumsum((chunk.data & 0xC0) != 0x80)
    starts = first_bytes[chunk.starts] - 1
    owner = np.zeros(len(points), dtype=np.int32)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    codes = np.where(sep, np.uint32(0x20), points) * np.uint32(0x9E3779B1)
    codes ^= codes >> np.uint32(15)
    seps = np.concatenate([[0], np.cumsum(sep, dtype=np.int32)])
    buckets, rows = [], []
    rolling = codes.copy()
    n = len(points)
    for size in range(2, max(sizes) + 1):
        if n < size:
            break
        rolling = (rolling[: n - size + 1] ^ codes[size - 1 :]) * np.uint32(0x85EBCA6B)
        rolling ^= rolling >> np.uint32(13)
        if size in sizes:
            keep = np.flatnonzero(seps[size - 1 : n] == seps[1 : n - size + 2])
            buckets.append((rolling[keep] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))
            rows.append(owner[keep])
    inside = np.diff(np.concatenate([[0], (~sep).astype(np.int8), [0]]))
    a, b = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    place = mix64(codes.astype(np.uint64))
    sums = np.zeros(n + 1, dtype=np.uint64)
    # a character's place in its word enters as an odd factor
    at = np.arange(n, dtype=np.int64) - np.repeat(np.concatenate([[0], a]), np.diff(np.concatenate([[0], a, [n]])))
    np.cumsum(place * (2 * at.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    words = mix64(sums[b] - sums[a])
    buckets.append((words >> np.uint64(64 - bits)).astype(np.uint32))
    rows.append(owner[a])
    return np.concatenate(buckets), np.concatenate(rows)


def bucket_counts(text: Column, config: ClassifierConfig) -> Column:
    """struct(buckets, counts) of each whole text."""

    @F.arrow_udf("struct<buckets:array<int>,counts:array<int>>")
    def kernel(column: pa.Array) -> pa.Array:
        ids, counts, sizes = [], [], []
        for chunk in chunks(column):
            b, r = _feature_buckets(chunk, config.bits, config.sizes)
            cells, n = np.unique(r.astype(np.int64) << config.bits | b, return_counts=True)
            ids.append(cells & (1 << config.bits) - 1)
            counts.append(n)
            sizes.append(np.bincount(cells >> config.bits, minlength=chunk.rows))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]))]).astype(np.int32))
        flat = lambda x: pa.array(np.concatenate([np.zeros(0), *x]).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat(ids)), pa.ListArray.from_arrays(offsets, flat(counts))], ["buckets", "counts"])

    return kernel.asNondeterministic()(text)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(buckets: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, config: ClassifierConfig) -> tuple[np.ndarray, float]:
    """Train; returns each bucket's contribution to the log odds of class 1, and the bias."""
    rng = np.random.default_rng(config.seed)
    vectors = rng.uniform(-1, 1, (1 << config.bits, config.dims)).astype(np.float32) / config.dims
    layer = np.zeros((config.dims, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    shares = [(c / c.sum()).astype(np.float32) for c in counts]
    each = -(-len(labels) // config.batch)
    epochs = max(config.epochs, -(-config.min_steps // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), config.batch):
            rows = order[at : at + config.batch]
            rate, done = config.rate * (1 - done / steps), done + 1
            ids = np.concatenate([buckets[i] for i in rows])
            share = np.concatenate([shares[i] for i in rows])
            bounds = np.cumsum([0, *[len(buckets[i]) for i in rows[:-1]]])
            hidden = np.add.reduceat(vectors[ids] * share[:, None], bounds)
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ layer.T
            owner = np.repeat(np.arange(len(rows)), np.diff([*bounds, len(ids)]))
            layer -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            change = back[owner] * share[:, None] * rate
            for d in range(config.dims):
                vectors[:, d] -= np.bincount(ids, weights=change[:, d], minlength=len(vectors)).astype(np.float32)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, config: ClassifierConfig | None = None, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """Fit on a bounded balanced sample of labelled rows; the bias is set back to the labels' own odds."""
    config = config or ClassifierConfig()
    known = labels.where(column(label).isin(0, 1) & column(doc_id).isNotNull()).groupBy(column(doc_id).alias("i")).agg(F.min(column(label)).alias("y"), F.max(column(label)).alias("z")).where("y = z").select("i", "y")
    odds = dict(known.groupBy("y").count().collect())
    half = config.sample_rows // 2
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(config.seed)), "i").limit(half) for y in (0, 1)]
    # at most sample_rows ids, so a broadcast of a bounded size; of rows that repeat an id, the least text counts
    found = docs.select(column(doc_id).alias("i"), column(text).alias("t")).join(F.broadcast(picks[0].unionByName(picks[1])), "i")
    sample = found.groupBy("i", "y").agg(F.min("t").alias("t"))
    got = sample.select("i", "y", bucket_counts(F.col("t"), config).alias("f")).select("i", "y", "f.*").toArrow().to_pandas()
    got = got[got["buckets"].map(len) > 0].sort_values("i", kind="stable")
    labels_of = got["y"].to_numpy(dtype=np.int64)
    if len(set(labels_of.tolist())) < 2:
        share = sum(odds.values()) and odds.get(1, 0) / sum(odds.values())
        return np.zeros(1 << config.bits, dtype=np.float32), float(np.clip(np.log((share or 0.5) / max(1 - (share or 0.5), 1e-6)), -6, 6)) if odds else 0.0
    weights, bias = fit(list(got["buckets"]), list(got["counts"]), labels_of, config)
    sampled = np.bincount(labels_of, minlength=2)
    return weights, bias + float(np.log(odds[1] / odds[0]) - np.log(sampled[1] / sampled[0]))


def score(text: Column, model: tuple[np.ndarray, float], config: ClassifierConfig | None = None) -> Column:
    """Probability of class 1 for each whole text."""
    config, (weights, bias) = config or ClassifierConfig(), model

    @F.arrow_udf("double")
    def kernel(column: pa.Array) -> pa.Array:
        out = []
        for chunk in chunks(column):
            b, r = _feature_buckets(chunk, config.bits, config.sizes)
            total = np.bincount(r, weights=weights[b], minlength=chunk.rows)
            odds = bias + total / np.maximum(np.bincount(r, minlength=chunk.rows), 1)
            out.append(1 / (1 + np.exp(-np.clip(odds, -500, 500))))
        return pa.array(np.concatenate([np.zeros(0), *out]))

    return kernel.asNondeterministic()(text)


def classify(docs: DataFrame, labels: DataFrame, config: ClassifierConfig | None = None, *, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """`docs` with `score` and `predicted` (1 from `threshold` on); columns of these names are replaced."""
    config = config or ClassifierConfig()
    model = train(docs, labels, config, doc_id=doc_id, text=text, label=label)
    scored = docs.select(given(docs, "score", "predicted").alias("given"), F.round(score(column(text), model, config), 9).alias("p"))
    return scored.select("given.*", F.col("p").alias("score"), (F.col("p") >= threshold).cast("int").alias("predicted"))
