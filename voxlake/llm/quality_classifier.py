"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of letters and digits, or of symbols, with A-Z folded; single words and pairs
are hashed into ``2**BITS`` weights. A word also counts under its shape (kind and length),
so that pairs of shapes are n-grams too: rare words then share what their shapes say. A document's vector has
log(1 + count) entries scaled to length one. Training runs FTRL-proximal (per-weight
rates, L1 and L2) over a bounded sample of labelled rows outside the held-out
fold (``max_rows``, default 20,000, smallest hashes of doc_id); the intercept is then moved so that the decision
limit splits the training rows best. Scores are sparse dot products.

Defined results. Null or empty text: the intercept alone. Repeated rows give repeated rows. Null doc_id: scored,
held_out false. With no labelled rows every score is 0.5. An empty table gives an empty result. Extra columns
are ignored: only the text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .quality_rules import labelled_sample

BITS = 18
LIMIT = 0.7
_KIND = np.zeros(256, dtype=np.uint64)
_KIND[[b for b in range(256) if tv.SYMBOL_WORDS[b] == 1]] = 1
_KIND[48:58] = 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = np.arange(3, 3 + sum(not chr(b).isalnum() for b in range(33, 127)))


def features(chunk: tv.Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, weight index, value) of a chunk's documents, sorted by document, each vector of length one."""
    s, e, first = chunk.words(tv.SYMBOL_WORDS)
    nd = chunk.n_docs
    doc = np.repeat(np.arange(nd, dtype=np.uint64), np.diff(first))
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    h = chunk.span_hash(chunk.prefix(tv.FOLDED_VALUES), s, e)
    shape = tv.mix(_KIND[chunk.buf[s]] * np.uint64(64) + np.minimum(e - s, 12).astype(np.uint64) + np.uint64(1 << 40))
    same = doc[1:] == doc[:-1]
    same2 = doc[2:] == doc[:-2]
    keys = [h, shape, tv.ngrams(h, 2)[same], tv.ngrams(shape, 2)[same], tv.ngrams(shape, 3)[same2]]
    docs = [doc, doc, doc[:-1][same], doc[:-1][same], doc[:-2][same2]]
    mask = np.uint64((1 << bits) - 1)
    both = np.concatenate([(d << np.uint64(bits)) | (k & mask) for d, k in zip(docs, keys, strict=True)])
    both.sort()
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    value = np.log1p(np.diff(np.append(at, len(both))))
    d, k = (both[at] >> np.uint64(bits)).astype(np.int64), (both[at] & mask).astype(np.int64)
    norm = np.sqrt(np.bincount(d, value * value, minlength=nd))
    return d, k, value / norm[d]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, chunk: tv.Chunk) -> np.ndarray:
        d, k, v = features(chunk)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(d, self.weights[k] * v, minlength=chunk.n_docs), -60, 60)))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, limit: float = LIMIT, bits: int = BITS, epochs: int = 4, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2) -> Model:
    """FTRL-proximal over sparse rows (index, value); the bias is one more weight without penalty."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.random.default_rng(11)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, v = rows[r]
            w = weights(i)
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            g0 = 1 / (1 + np.exp(-np.clip(w @ v + wb, -35, 35))) - y[r]
            g = g0 * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            zb += g0 - (np.sqrt(nb + g0 * g0) - np.sqrt(nb)) / alpha * wb
            nb += g0 * g0
    every = np.arange(1 << bits)
    w = weights(every)
    bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    margin = np.array([w[i] @ v for i, v in rows])
    return Model(w, bias + best_shift(margin + bias, y, np.log(limit / (1 - limit))))


def best_shift(margin: np.ndarray, y: np.ndarray, at: float) -> float:
    """The shift of margins by which the limit ``at`` splits the rows with the best balanced accuracy; ties: least change."""
    if not len(margin) or y.min() == y.max():
        return 0.0
    cuts = np.unique(margin)
    mids = np.concatenate([[cuts[0] - 0.5], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 0.5]])
    pos, neg = np.sort(margin[y == 1]), np.sort(margin[y == 0])
    good = (1 - np.searchsorted(pos, mids) / len(pos)) + np.searchsorted(neg, mids) / len(neg)
    top = np.flatnonzero(good >= good.max() - 1e-12)
    shifts = at - mids[top]
    return float(shifts[np.abs(shifts).argmin()])


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, limit: float = LIMIT) -> Model:
    """Trains on the driver; a labelled row comes there as its sparse vector, not as text."""

    def vectors(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                d, k, v = features(c)
                cut = np.searchsorted(d, np.arange(c.n_docs + 1))
                ids = [k[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                vals = [v[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.first, c.n_docs).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(vals, pa.binary())], names=["y", "i", "v"])

    got = labelled_sample(docs, labels, "quality", max_rows).select("text", "y").mapInArrow(vectors, "y int, i binary, v binary").orderBy("y", F.xxhash64("i", "v"))
    rows, y = [], []
    for r in got.toLocalIterator():
        rows.append((np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4").astype(float)))
        y.append(r["y"])
    if not rows:
        return Model(np.zeros(1 << BITS), 0.0)
    return train_ftrl(rows, np.array(y, float), limit=limit)


def quality_classifier(docs: DataFrame, model: Model, *, limit: float = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the corpus

    def run(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                score = spread.value.score(c)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n_docs), batch.column(2).slice(c.first, c.n_docs), pa.array(score), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
