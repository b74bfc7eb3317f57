"""Quality rules: document statistics, fixed base limits, and gradient-boosted trees with monotonic constraints.

The statistics of whole texts come from the vectorised word engine. Trees are grown
on the driver over a bounded sample of labelled rows (``max_rows``, default 20,000,
the smallest hashes of doc_id) by histogram splits; a split that would break a
monotonic constraint is never taken, and child values stay inside the bounds that
constrained ancestors set. The forest is flattened into node arrays and every row
is scored by stepping all rows down one level at a time.

Defined results. Null or empty text: no words, base_failed true, kept false. Rows with
a null doc_id are scored like others. Repeated rows give repeated rows. An empty table gives
an empty result. With no labelled rows, or labels of one class only, the method passes
every row that the base passes. Extra columns are ignored: only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see, and the sign that each may have on quality (+1 better, -1 worse, 0 free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "unique_rate": 0, "lines_per_word": 0, "upper_rate": 0, "digit_rate": 0, "punct_rate": 0, "stop_rate": 0, "long_word_rate": 0}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def _sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return tv.per_doc(mask, offs)


def document_stats(chunk: tv.Chunk) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the matrix of features of each document of a chunk."""
    buf, offs, nd = chunk.buf, chunk.offs, chunk.n_docs
    s, e, first = chunk.words()
    n_words = np.diff(first)
    cls = tv.SPACE_WORDS[buf]
    begins_char = (buf & 0xC0) != 0x80
    word_chars = _sums((cls != 0) & begins_char, offs)
    n_symbols = _sums(_SYMBOL[buf], offs)
    h = chunk.prefix()
    # lines that hold a word: spans between newlines, never over a document's end
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[:-1] = buf == 10
    ends = np.unique(np.concatenate([np.flatnonzero(edge), offs[1:]]))
    starts = np.concatenate([[0], ends[:-1] + edge[ends[:-1]]]) if len(ends) else ends
    keep = np.searchsorted(s, ends) > np.searchsorted(s, starts) if len(ends) else np.zeros(0, bool)
    ls, le = starts[keep], ends[keep]
    ldoc = np.searchsorted(offs, ls, side="right") - 1
    n_lines = np.bincount(ldoc, minlength=nd)
    key = tv.mix(chunk.span_hash(h, ls, le) + tv.mix(ldoc.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(key, return_index=True)
    n_dup = n_lines - np.bincount(ldoc[at], minlength=nd)
    # words inside 8-word windows that occur twice or more in their document
    wh = chunk.span_hash(h, s, e)
    ok, doc = tv.ngram_docs(first, WINDOW, len(s))
    grams = tv.ngrams(wh, WINDOW)
    n_rep = np.zeros(nd, dtype=np.int64)
    if len(grams):
        at = np.flatnonzero(ok)
        g = tv.mix(grams[at] + tv.mix(doc[at].astype(np.uint64) + np.uint64(1)))
        o = np.sort(g)
        twice = np.unique(o[1:][o[1:] == o[:-1]])
        if len(twice):
            p = np.searchsorted(twice, g)
            hit = at[twice[np.minimum(p, len(twice) - 1)] == g]
            cover = np.zeros(len(s) + 1, dtype=np.int32)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
            n_rep = _sums(np.cumsum(cover[:-1]) > 0, first)
    base = dict(zip(STATS, (n_words, word_chars, n_symbols, n_dup, n_rep), strict=True))
    w, b = np.maximum(n_words, 1), np.maximum(np.diff(offs), 1)
    uniq = np.zeros(nd, dtype=np.int64)
    if len(s):
        dh = np.sort((wh >> np.uint64(24)) | (doc.astype(np.uint64) << np.uint64(40)))
        new = np.concatenate([[True], dh[1:] != dh[:-1]])
        uniq = np.bincount((dh[new] >> np.uint64(40)).astype(np.int64), minlength=nd)[:nd]
    length = e - s
    x = np.column_stack([
        np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), n_rep / w, uniq / w,
        n_lines / w, _sums((buf >= 65) & (buf <= 90), offs) / b, _sums((buf >= 48) & (buf <= 57), offs) / b,
        _sums(_PUNCT[buf], offs) / b, _sums(length <= 3, first) / w, _sums(length >= 12, first) / w,
    ])
    return base, x


@dataclass
class Forest:
    """Trees as flat arrays: at node k go to left[k] or left[k] + 1; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int
    meta: dict = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train_forest(x: np.ndarray, y: np.ndarray, signs: list[int], *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0, min_child: float = 2.0) -> Forest:
    """Newton boosting of log loss over quantile bins; signs are the monotonic constraints of the features."""
    n, m = x.shape
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    bias = float(np.log(p0 / (1 - p0)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        code = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)])
    margin = np.full(n, bias)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, lo, hi = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * float(np.clip(-gs / (hs + l2), lo, hi))
            margin[rows] += value[node]
            if level == depth:
                continue
            best = (1e-6, None)
            for j in range(m):
                k = len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(code[rows, j], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], h[rows], k))[:-1]
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                loss = lambda v, a, b: a * v + 0.5 * (b + l2) * v * v
                gain = loss(np.clip(-gs / (hs + l2), lo, hi), gs, hs) - loss(vl, gl, hl) - loss(vr, gr, hr)
                gain[(hl < min_child) | (hr < min_child) | (signs[j] * (vr - vl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    c = int(gain.argmax())
                    best = (gain[c], (j, c, vl[c], vr[c]))
            if best[1] is None:
                continue
            j, c, vl, vr = best[1]
            margin[rows] -= value[node]
            feature[node], threshold[node], left[node] = j, float(cuts[j][c]), len(feature)
            goes = code[rows, j] > c
            mid = (vl + vr) / 2
            limits = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[signs[j]]
            for part, (a, b) in zip((rows[~goes], rows[goes]), limits, strict=True):
                feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                todo.append((len(feature) - 1, part, level + 1, a, b))
    return Forest(np.array(feature, int), np.array(threshold), np.array(left, int), np.array(value), np.array(roots, int), bias, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents outside the held-out fold: (doc_id, text, y), chosen by hash of doc_id.

    One label per doc_id is used (the smallest) and one of its rows (by least text hash). The id list is bounded by max_rows, so it is broadcast.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % 4 != 2))
        .groupBy("_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64(F.col("_id"), F.lit(17)), "_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_one"))
    return one.select("doc_id", F.col("_one.text").alias("text"), "y")


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, **params) -> Forest:
    """Trees from a bounded sample of labelled rows; their statistics (12 numbers a row) come to the driver."""

    def features(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                _, x = document_stats(c)
                y = batch.column(1).slice(c.first, c.n_docs)
                yield pa.RecordBatch.from_arrays([y.cast(pa.int32()), *map(pa.array, x.T)], names=["y", *FEATURES])

    rows = labelled_sample(docs, labels, "quality", max_rows).select("text", "y").mapInArrow(features, ", ".join(["y int", *(f"{k} double" for k in FEATURES)])).toPandas()
    rows = rows.sort_values(list(rows.columns)).to_numpy(dtype=float)
    y = rows[:, 0] if len(rows) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return train_forest(np.zeros((0, len(FEATURES))), np.ones(0), list(FEATURES.values()))
    return train_forest(rows[:, 1:], y, list(FEATURES.values()), **params)


def quality_rules(docs: DataFrame, forest: Forest, *, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, the statistics, base_failed, score (likelihood of good quality) and kept."""
    trained = len(forest.roots) > 0

    def judge(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                base, x = document_stats(c)
                n, rep = base["n_words"], base["n_repeat_words"]
                failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
                score = forest.score(x) if trained else np.ones(len(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n_docs), *(pa.array(base[k].astype(np.int64)) for k in STATS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                    names=["doc_id", *STATS, "base_failed", "score", "kept"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, forest: Forest, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns."""
    at, trained = docs.columns.index("text"), len(forest.roots) > 0

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for c in tv.chunks(batch.column(at)):
                base, x = document_stats(c)
                n = base["n_words"]
                good = (n >= MIN_WORDS) & (100 * base["n_repeat_words"] <= MAX_REPEAT_PERCENT * n)
                keep[c.first : c.first + c.n_docs] = good & (forest.score(x) >= threshold) if trained else good
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
