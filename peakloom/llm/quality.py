"""Operator 5: a byte-level convolutional quality classifier in numpy.

Bytes are embedded, each with a flag for a stretch that repeats just before (no filter of 16 bytes can see
that); learned filters slide over chunks of 16 bytes every 8 bytes, so overlapping chunks cover the whole
document; each filter's responses are max-pooled over all chunks and a logistic unit combines the pools into one
probability. Scoring is one pass over Arrow batches without a shuffle.

It is fitted on a bounded sample of labelled rows: at most ``sample`` documents of at most ``sample_chars``
characters each (whole texts, taken by a hash of the id), one text an id (the first in order, if rows share
an id). Rows whose crc32(id as text) mod 5 is 0 are never learned from. Labels, language, source and id are no
inputs.

Cases: a null or empty text is one chunk of zeros and gets that score; without any labelled row of either
class the score is the share of label 1, or 0.5 where there are no labels; repeated labels of a document
count once (the largest).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import blocks
from .shared import materialize, texts

STRIDE = 8  # a chunk is two strides
EMBEDDING = 8
FILTERS = 24
LAGS = range(2, 41)  # bytes back that the repeat flag looks
RUN = 6  # equal bytes that make a repeat
GAP = 6  # rows of zeros after a document: more bytes than a flag looks back, so no document sees another
THRESHOLD = 0.3
SAMPLE = 4000
SAMPLE_CHARS = 20_000
FOLDS = 5


def repeats(flat: np.ndarray) -> np.ndarray:
    """Whether the RUN bytes that end here stand again some of LAGS bytes before."""
    found = np.zeros(len(flat), bool)
    for lag in LAGS:
        same = flat[lag:] == flat[:-lag]
        pairs = same[1:] & same[:-1]
        found[lag + RUN - 1 :] |= pairs[: -RUN + 2] & pairs[2 : -RUN + 4] & pairs[4:]
    return found & (flat != 0)


def halves(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (byte, plus 256 in a repeat) in rows of STRIDE, zeros up to GAP rows after each document; documents' first rows."""
    length = np.diff(offsets)
    n = np.maximum(1, -(-length // STRIDE)) + GAP
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(int(first[-1]) * STRIDE, np.uint8)
    shift = np.repeat(first[:-1] * STRIDE - offsets[:-1], length)
    out[np.arange(len(body)) + shift] = body
    return (out + repeats(out).astype(np.int16) * 256).reshape(-1, STRIDE), first


class ByteCNN:
    """Parameters and both passes; float32 throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (512, EMBEDDING)).astype(np.float32)
        self.filters = rng.normal(0, (2 / (2 * STRIDE * EMBEDDING)) ** 0.5, (2 * STRIDE * EMBEDDING, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Filter responses of the chunk that starts at each row; the last row starts none."""
        half = STRIDE * EMBEDDING
        x = self.embedding[rows].reshape(len(rows), half)
        both = x @ np.concatenate([self.filters[:half], self.filters[half:]], axis=1)
        return both[:-1, :FILTERS] + both[1:, FILTERS:]

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        chunks = self.responses(rows)
        chunks[first[1:-1] - 1] = -np.inf  # a document's last row of zeros starts no chunk
        return np.maximum(np.maximum.reduceat(chunks, first[:-1], axis=0) + self.bias, 0)

    def scores(self, pools: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-(pools @ self.weights + self.offset[0]).astype(np.float64))), 6)

    def fit(self, docs: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.004, seed: int = 11) -> ByteCNN:
        """Adam on the log loss; a pool's gradient goes to the chunk that won it."""
        rng = np.random.default_rng(seed)
        names = ["embedding", "filters", "bias", "weights", "offset"]
        mean, square, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        rows = [halves(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in docs]
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                first = np.concatenate(([0], np.cumsum([len(rows[i]) for i in own])))
                flat = np.concatenate([rows[i] for i in own])
                chunks = self.responses(flat)
                chunks[first[1:-1] - 1] = -np.inf
                won = np.stack([a + chunks[a : b - 1].argmax(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])
                pools = chunks[won, np.arange(FILTERS)] + self.bias
                alive = pools > 0
                pools = np.where(alive, pools, 0)
                error = (self.scores(pools) - labels[own]).astype(np.float32) / len(own)
                back = error[:, None] * self.weights * alive
                codes = np.concatenate([flat[won], flat[np.minimum(won + 1, len(flat) - 1)]], axis=2)
                x = self.embedding[codes]
                grads = {
                    "weights": pools.T @ error,
                    "offset": error.sum(keepdims=True),
                    "bias": back.sum(axis=0),
                    "filters": np.einsum("df,dfke->kef", back, x, optimize=True).reshape(self.filters.shape),
                }
                spread = back[:, :, None, None] * self.filters.reshape(2 * STRIDE, EMBEDDING, FILTERS).transpose(2, 0, 1)[None]
                grads["embedding"] = np.stack([np.bincount(codes.ravel(), spread[..., e].ravel(), 512) for e in range(EMBEDDING)], axis=1)
                step += 1
                for k in names:
                    mean[k] = 0.9 * mean[k] + 0.1 * grads[k]
                    square[k] = 0.999 * square[k] + 0.001 * grads[k] ** 2
                    move = rate * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))
        return self


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, folds: int = FOLDS) -> DataFrame:
    """(doc_id, text, label): at most ``sample`` labelled documents outside the held-out fold."""
    usable = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != 0))
    known = materialize(usable.groupBy("doc_id").agg(F.max("quality").alias("label")), "labels")
    n = known.count()
    if n > sample:  # nine tenths of the bound in the mean, so that the limit is a guard that is not reached
        known = known.where(F.xxhash64("doc_id").bitwiseAND(0xFFFFFFFF) < int(0.9 * sample / n * 2**32)).limit(sample)
    own = docs.where(F.length("text") <= sample_chars).join(F.broadcast(known), "doc_id")  # at most ``sample`` ids
    return own.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> ByteCNN:
    """The network fitted on ``training_rows``, which alone come to the driver."""
    rows = sorted((r.doc_id, r.text, r.label) for r in training_rows(docs, labels, **bounds).collect())
    model, y = ByteCNN(), np.array([r[2] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        model.weights[:] = 0
        model.offset[:] = np.log(share / (1 - share))
        return model
    return model.fit([r[1].encode("utf-8") for r in rows], y)


def score_texts(docs: DataFrame, model: ByteCNN, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, end, body, offsets in blocks(batch.column(1), 1 << 19):
                scores[first:end] = model.scores(model.pooled(*halves(body, offsets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    base = texts(docs)
    scored = score_texts(base, fit(base, labels))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns; scored in the same pass that filters."""
    model = fit(texts(docs), labels)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, end, body, offsets in blocks(batch.column(at), 1 << 19):
                keep[first:end] = model.scores(model.pooled(*halves(body, offsets))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)
