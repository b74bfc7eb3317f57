"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give scores and offsets.

Labels are given for documents, the field needs labelled tokens. So tokens are labelled first:
over the training documents every token feature (folded word, its leading 3-7 and last 3-4 bytes) gets the numbers
of toxic and clean documents and tokens that have it; a token of a toxic document is marked when one of its
features is far commoner there than chance allows, and all tokens of clean documents are unmarked.
Toxic documents without a mark are left out of the field's training. The field has two states,
hashed feature weights for the emissions and a transition matrix, and is trained by
gradient ascent on the conditional log-likelihood (gradients from forward-backward, AdaGrad steps).

Forward-backward runs over blocks of BLOCK tokens at once: every block's transfer matrix is
multiplied out for all blocks in parallel, a short loop over a document's blocks joins
these, and the marginals inside follow from the block's ends. This is exact at any length.

A document's score is a logistic function of its largest marginal, its expected number and rate of
toxic tokens and its length, fitted on the training rows so that the decision limit splits them best. Offending offsets are the
runs of tokens with a marginal of 0.5 or more, in code points.

Training uses a bounded sample (``max_rows`` labelled rows, default 4,000, smallest hashes)
outside the held-out fold. Whole texts are scored.

Defined results. Null or empty text: no tokens, the score of a document without toxic tokens. Null doc_id:
scored, held_out false. Repeated rows give repeated rows. With labels of one class or none
every score is that of no toxic token. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .quality_classifier import best_shift
from .quality_rules import labelled_sample

LIMIT = 0.3
BITS = 20
BLOCK = 64
LEADS, TAILS = (3, 4, 5, 6, 7), (3, 4)
N_FEATURES = 1 + len(LEADS) + len(TAILS)
_MASK = np.uint64((1 << BITS) - 1)


def token_features(chunk: tv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and features (tokens x N_FEATURES indices; -1 where a token is too short) and first token of each document."""
    s, e, first = chunk.words(tv.ALNUM_WORDS)
    h = chunk.prefix(tv.FOLDED_VALUES)
    out = np.full((len(s), N_FEATURES), -1, dtype=np.int32)
    if len(s):
        out[:, 0] = chunk.span_hash(h, s, e) & _MASK
        n = e - s
        for j, k in enumerate(LEADS, 1):
            at = np.flatnonzero(n > k)
            out[at, j] = tv.mix(chunk.span_hash(h, s[at], s[at] + k) + np.uint64(101)) & _MASK
        for j, k in enumerate(TAILS, 1 + len(LEADS)):
            at = np.flatnonzero(n > k)
            out[at, j] = tv.mix(chunk.span_hash(h, e[at] - k, e[at]) + np.uint64(202)) & _MASK
    return s, e, out, first


def emissions(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic state of each token; weights has a last entry 0 for missing features."""
    out = weights[feats[:, 0]].astype(float)
    for j in range(1, feats.shape[1]):
        out += weights[feats[:, j]]
    return out


def forward_backward(odds: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the toxic state, expected transition counts (2 x 2) and log partition sum of chains.

    odds: log-odds of state 1 against 0 of each token. first: the first token of each chain (and the end).
    trans: log transition scores. start: log scores of the first state.
    """
    n_tok = np.diff(first)
    if not len(odds):
        return np.zeros(0), np.zeros((2, 2)), 0.0
    blocks = -(-n_tok // BLOCK)
    b0 = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(b0[-1])
    chain = np.repeat(np.arange(len(n_tok)), blocks)
    nth = np.arange(nb) - b0[chain]
    begin = first[:-1][chain] + nth * BLOCK
    size = np.minimum(BLOCK, first[1:][chain] - begin)
    at = begin[:, None] + np.arange(BLOCK)
    live = np.arange(BLOCK) < size[:, None]
    x = np.where(live, odds[np.minimum(at, len(odds) - 1)], 0.0).T
    live = live.T
    # emission factors (1, e^x), scaled to a largest of 1
    top = np.maximum(x, 0)
    e0, e1 = np.exp(-top), np.exp(x - top)
    a = np.exp(trans)
    # transfer matrices: m[r, c] = sum over paths that enter from state r and end in state c
    m = np.zeros((nb, 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    scale = np.zeros(nb)
    opens = nth == 0
    for t in range(BLOCK):
        step = m @ a
        if t == 0 and opens.any():
            step[opens] = np.exp(start)[None, None, :]
        step[:, :, 0] *= e0[t][:, None]
        step[:, :, 1] *= e1[t][:, None]
        m = np.where(live[t][:, None, None], step, m)
        if t % 8 == 7:
            big = m.max(axis=(1, 2))
            m /= big[:, None, None]
            scale += np.log(big)
    # join the blocks of each chain: state vectors before every block, from the front and from the back
    front, back = np.ones((nb, 2)) / 2, np.ones((nb, 2))
    log_z = scale.sum() + top[live].sum()
    lasts = b0[1:] - 1
    for k in range(1, int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        v = np.einsum("ij,ijk->ik", front[b0[on] + k - 1], m[b0[on] + k - 1])
        z = v.sum(axis=1, keepdims=True)
        front[b0[on] + k] = v / z
        log_z += np.log(z).sum()
        w = np.einsum("ijk,ik->ij", m[lasts[on] - k + 1], back[lasts[on] - k + 1])
        back[lasts[on] - k] = w / w.max(axis=1, keepdims=True)
    used = np.flatnonzero(blocks > 0)
    log_z += np.log(np.einsum("ij,ijk->i", front[lasts[used]], m[lasts[used]])).sum()
    # inside the blocks: forward states, then backward ones with marginals
    f = np.empty((BLOCK, nb, 2))
    v = front
    for t in range(BLOCK):
        w = v @ a
        if t == 0 and opens.any():
            w[opens] = np.exp(start)
        w[:, 0] *= e0[t]
        w[:, 1] *= e1[t]
        w /= w.sum(axis=1, keepdims=True)
        v = np.where(live[t][:, None], w, v)
        f[t] = v
    marginal = np.empty((BLOCK, nb))
    pairs = np.zeros((2, 2))
    w = back
    for t in range(BLOCK - 1, -1, -1):
        p = f[t] * w
        marginal[t] = p[:, 1] / p.sum(axis=1)
        right = w * np.column_stack([e0[t], e1[t]])
        before = f[t - 1] if t else front
        ok = live[t] & ((t > 0) | ~opens)
        joint = before[ok][:, :, None] * a[None] * right[ok][:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        left = right @ a.T
        left /= left.max(axis=1, keepdims=True)
        w = np.where(live[t][:, None], left, w)
    out = np.empty(len(odds))
    out[at.T[live]] = marginal[live]
    return out, pairs, float(log_z)


def mark_tokens(feats: np.ndarray, first: np.ndarray, toxic: np.ndarray, *, ratio: float = 8.0, lift: float = 3.0, least: int = 4) -> np.ndarray:
    """Which tokens count as toxic: those of toxic documents with a feature typical of these.

    Typical: its rate among the tokens of toxic documents is ``ratio`` times that in clean ones, the share of toxic
    documents among those that hold it is ``lift`` times the usual (or nearly all), and ``least`` or more toxic documents,
    and more than chance would bring among so many features, hold it.
    """
    nd = len(toxic)
    if not len(feats):
        return np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(nd), np.diff(first))
    base = min(max(toxic.mean(), 1e-6), 1 - 1e-6)
    bad_token = toxic[doc]
    share = max(bad_token.mean(), 1e-9)
    marked = np.zeros(len(doc), dtype=bool)
    for j in range(feats.shape[1]):
        f = feats[:, j]
        ok = f >= 0
        pair = np.unique(doc[ok].astype(np.int64) << BITS | f[ok])
        d, k = pair >> BITS, pair & ((1 << BITS) - 1)
        bad = np.bincount(k, toxic[d], 1 << BITS)
        all_ = np.bincount(k, minlength=1 << BITS)
        bad_n = np.bincount(f[ok], bad_token[ok], 1 << BITS)
        all_n = np.bincount(f[ok], minlength=1 << BITS)
        rate = (bad_n / share) / ((all_n - bad_n + 1) / max(1 - share, 1e-9))
        # how far the number of toxic documents lies above chance, in nats (Chernoff bound)
        q = np.clip(bad / np.maximum(all_, 1), 1e-9, 1 - 1e-9)
        nats = np.where(q > base, all_ * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base))), 0)
        typical = (rate >= ratio) & (q >= min(lift * base, 0.9)) & (bad >= least) & (nats >= np.log(max(len(pair), 1) / 0.01))
        marked |= ok & typical[f] & (bad_token == 1)
    return marked


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    head: np.ndarray  # of the score: intercept, largest marginal's log-odds, log of the expected count

    def marginals(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(emissions(self.weights, feats), first, self.trans, self.start)[0]

    def summary(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per document: 1, log-odds of the largest marginal, log(1 + expected toxic tokens), log of their rate, log length."""
        n, size = len(first) - 1, np.diff(first)
        top, total = np.full(n, 1e-6), np.zeros(n)
        has = np.flatnonzero(size > 0)
        if len(has):
            top[has] = np.maximum(np.maximum.reduceat(marginal, first[:-1][has]), 1e-6)
            total[has] = np.add.reduceat(np.where(marginal > 0.05, marginal, 0), first[:-1][has])
        top = np.minimum(top, 1 - 1e-6)
        return np.column_stack([np.ones(n), np.log(top / (1 - top)), np.log1p(total), np.log((total + 0.02) / (size + 20)), np.log1p(size)])

    def score(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(marginal, first) @ self.head, -60, 60)))


def train_field(feats: np.ndarray, first: np.ndarray, toxic: np.ndarray, *, limit: float = LIMIT, epochs: int = 8, rate: float = 0.4, l2: float = 1e-4) -> Field:
    """Marks tokens, trains the field on marked and clean documents in batches, then fits the document score."""
    marked = mark_tokens(feats, first, toxic)
    counts = tv.per_doc(marked, first)
    use = np.flatnonzero(((toxic == 0) | (counts > 0)) & (np.diff(first) > 0))
    n = (1 << BITS) + 1
    w, g2 = np.zeros(n, np.float64), np.full(n, 1e-3)
    trans, start = np.zeros((2, 2)), np.array([0.0, -2.0])
    t2, s2 = np.full((2, 2), 1e-3), np.full(2, 1e-3)
    w[0] += 0.0
    bias = -3.0
    order = np.random.default_rng(3)
    head = np.array([0.0, 1.0, 0.5, 0.0, 0.0])
    field = Field(w, trans, start, head)
    if toxic.min(initial=1) == toxic.max(initial=1) or not marked.any():
        field.head = np.array([np.log(0.05), 0.0, 0.0, 0.0, 0.0])
        return field
    trans += np.array([[0.0, bias], [0.0, bias / 2]])
    for _ in range(epochs):
        for part in np.array_split(order.permutation(use), max(1, len(use) // 100)):
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in part])
            bounds = np.concatenate([[0], np.cumsum(np.diff(first)[part])])
            f, y = feats[rows], marked[rows].astype(float)
            p, pairs, _ = forward_backward(emissions(w, f), bounds, trans, start)
            err = y - p
            touched, grad = _scatter(f, err)
            grad -= l2 * w[touched] * len(part)
            g2[touched] += grad * grad
            w[touched] += rate * grad / np.sqrt(g2[touched])
            inner = np.ones(len(rows), bool)
            inner[bounds[:-1][np.diff(bounds) > 0]] = False
            at = np.flatnonzero(inner)
            seen = np.bincount((2 * y[at - 1] + y[at]).astype(int), minlength=4).reshape(2, 2)
            gt = (seen - pairs) / len(part)
            t2 += gt * gt
            trans += 0.1 * gt / np.sqrt(t2)
            heads = bounds[:-1][np.diff(bounds) > 0]
            gs = np.array([(p[heads] - y[heads]).sum(), (y[heads] - p[heads]).sum()]) / len(part)
            s2 += gs * gs
            start += 0.1 * gs / np.sqrt(s2)
    w[-1] = 0.0
    cuts = [*range(0, len(first) - 1, 200), len(first) - 1]
    x = np.concatenate([field.summary(field.marginals(feats[first[a] : first[b]], first[a : b + 1] - first[a]), first[a : b + 1] - first[a]) for a, b in zip(cuts, cuts[1:], strict=False)])
    b = np.array([-1.0, 0.5, 0.5, 0.0, 0.0])
    for _ in range(100):  # logistic regression by damped Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * np.maximum(q * (1 - q), 1e-6)[:, None]) + 0.5 * np.eye(5)
        b += np.clip(np.linalg.solve(h, x.T @ (toxic - q) - 0.5 * b * [0, 1, 1, 1, 1]), -1, 1)
    b[0] += best_shift(x @ b, toxic, np.log(limit / (1 - limit)))
    field.head = b
    return field


def _scatter(f: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the errors by feature."""
    flat = f.ravel()
    ok = flat >= 0
    g = np.bincount(flat[ok], np.repeat(err, f.shape[1])[ok], minlength=1 << BITS)
    touched = np.flatnonzero(g)
    return touched, g[touched]


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 4_000, limit: float = LIMIT) -> Field:
    """Trains on the driver; a labelled row comes there as its tokens' feature numbers (32 bytes a token)."""

    def vectors(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                _, _, f, first = token_features(c)
                data = [f[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.first, c.n_docs).cast(pa.int32()), pa.array(data, pa.binary())], names=["y", "f"])

    got = labelled_sample(docs, labels, "toxic", max_rows).select("text", "y").mapInArrow(vectors, "y int, f binary").orderBy("y", F.xxhash64("f"))
    y, parts = [], []
    for r in got.toLocalIterator():
        y.append(r["y"])
        parts.append(np.frombuffer(r["f"], np.int32).reshape(-1, N_FEATURES))
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    feats = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.int32)
    del parts
    return train_field(feats, first, np.array(y, float), limit=limit)


def toxicity(docs: DataFrame, field: Field, *, limit: float = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, n_toxic (expected toxic tokens) and spans (start:end in code points)."""
    spread = docs.sparkSession.sparkContext.broadcast(field)  # 8 MB whatever the corpus

    def run(batches):
        model = spread.value
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                s, e, f, first = token_features(c)
                m = model.marginals(f, first)
                score = model.score(m, first)
                spans = [[] for _ in range(c.n_docs)]
                hit = np.flatnonzero(m >= 0.5)
                doc = np.searchsorted(first, hit, side="right") - 1
                lead = np.cumsum((c.buf & 0xC0) != 0x80) if len(hit) else None
                for d, t, last in zip(doc.tolist(), hit.tolist(), np.append(-2, hit[:-1]).tolist(), strict=False):
                    zero = lead[c.offs[d] - 1] if c.offs[d] else 0
                    a, b = int(lead[s[t]] - 1 - zero), int(lead[e[t] - 1] - zero)
                    if spans[d] and last == t - 1:
                        spans[d][-1][1] = b
                    else:
                        spans[d].append([a, b])
                text = [",".join(f"{a}:{b}" for a, b in x) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n_docs), batch.column(2).slice(c.first, c.n_docs), pa.array(score), pa.array((score >= limit).astype(np.int32)), pa.array(np.expm1(model.summary(m, first)[:, 2])), pa.array(text, pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "n_toxic", "spans"],
                )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int, n_toxic double, spans string")
