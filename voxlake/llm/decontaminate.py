"""Benchmark decontamination by spaced-seed hashing.

Texts become folded words (runs of letters and digits, A-Z lower-cased). Each fixed mask picks some positions of a
window and ignores the others, so a changed word inside the window leaves the hash of a mask that skips it
unchanged. The hashes of all windows of all documents are looked up among those of the benchmark;
a hit fixes a diagonal (document, item, offset), along which the words are compared one by one: the
best segment (match +1, substitution -2) is found exactly. A document is contaminated by an item if
segments of at least ``MIN_SEGMENT`` matches cover ``MIN_MATCH`` words of the item (of a shorter one its share ``MIN_IDENTITY``)
at an identity of ``MIN_IDENTITY`` or more. Segments on several diagonals add up, so insertions only cut a match in two.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each of which fits any task; every block is
matched with all documents. Nothing of the documents goes to the driver, and no document is shuffled.

Defined results. Items with fewer than ``MIN_ITEM`` words have no window and match nothing. Null texts count as empty.
Equal benchmark rows count once; repeated document rows give repeated results. An empty
benchmark or table gives no hits. Extra columns are ignored by the search and kept by the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv

#: Fixed masks: 1 is compared, 0 ignored.
MASKS = ("11111", "1101101", "11000111", "1010101011")
#: For items of fewer than MIN_MATCH words: one of them fits every segment that counts.
SHORT_MASKS = ("111", "11011")
MIN_ITEM, MIN_MATCH, MIN_SEGMENT, MIN_IDENTITY = 5, 12, 5, 0.75
BLOCK_BYTES = 16 << 20  # of benchmark text; its tables take some 10 times as much in a task
FILTER_BITS = 21


def _words(chunk: tv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = chunk.words(tv.ALNUM_WORDS)
    return chunk.span_hash(chunk.prefix(tv.FOLDED_VALUES), s, e), s, e, first


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of the mask's length: a sum of the compared words with multipliers of their places."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += h[k : k + m] * tv._MULT[k]
    return tv.mix(out ^ np.uint64(len(mask)))


class Matcher:
    """The windows of a block of benchmark items, and the search for them in documents."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        hashes, firsts = [np.zeros(0, np.uint64)], [0]
        for c in tv.chunks(pa.array(texts, pa.large_string())):
            h, _, _, first = _words(c)
            hashes.append(h)
            firsts += (first[1:] + firsts[-1] if c.first == 0 else first[1:] + base).tolist()
            base = firsts[-1]
        self.h, self.first = np.concatenate(hashes), np.array(firsts, dtype=np.int64)
        item = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.tables = []
        short = (np.diff(self.first) < MIN_MATCH)[item] if len(item) else np.zeros(0, dtype=bool)
        for mask in (*MASKS, *SHORT_MASKS):
            key = masked(self.h, mask)
            inside = item[: len(key)] == item[len(mask) - 1 : len(mask) - 1 + len(key)]
            at = np.flatnonzero(inside & short[: len(key)] if mask in SHORT_MASKS else inside)
            if not len(at):
                continue
            order = np.argsort(key[at], kind="stable")
            at = at[order]
            key, at = key[at], at.astype(np.int32)
            sieve = np.zeros(1 << FILTER_BITS, dtype=bool)
            sieve[key >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((mask, key, at, sieve))
        self.item = item

    def find(self, chunk: tv.Chunk) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(document, item, matched words of the item, first word, last word, identity) of contaminated documents."""
        h, _, _, first = _words(chunk)
        doc = np.repeat(np.arange(chunk.n_docs), np.diff(first))
        diagonals = []
        for mask, keys, at, sieve in self.tables:
            k = masked(h, mask)
            p = np.flatnonzero(sieve[k >> np.uint64(64 - FILTER_BITS)])
            p = p[doc[p] == doc[p + len(mask) - 1]] if len(p) else p
            if not len(p):
                continue
            lo, hi = np.searchsorted(keys, k[p], "left"), np.searchsorted(keys, k[p], "right")
            n = hi - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            if not len(p):
                continue
            p2 = np.repeat(p, n)
            q = at[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            diagonals.append(np.column_stack([doc[p2], self.item[q], p2 - q]))
        if not diagonals:
            return
        rows = np.unique(np.concatenate(diagonals), axis=0)
        start = 0
        cuts = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        for end in [*cuts.tolist(), len(rows)]:
            d, i = int(rows[start, 0]), int(rows[start, 1])
            got = self._judge(h, first, d, i, rows[start:end, 2])
            if got:
                yield d, i, *got
            start = end

    def _judge(self, h: np.ndarray, first: np.ndarray, d: int, i: int, offsets: np.ndarray) -> tuple[int, int, int, float] | None:
        a, b, x, y = first[d], first[d + 1], self.first[i], self.first[i + 1]
        covered = np.zeros(y - x, dtype=bool)
        matched = length = 0
        lo, hi = b - a, 0
        for off in offsets.tolist():
            q0, q1 = max(x, a - off), min(y, b - off)
            same = h[q0 + off : q1 + off] == self.h[q0:q1]
            for s, e in segments(same):
                n = int(same[s:e].sum())
                if n >= MIN_SEGMENT and n >= MIN_IDENTITY * (e - s):
                    covered[q0 - x + s : q0 - x + e] |= same[s:e]
                    matched, length = matched + n, length + e - s
                    lo, hi = min(lo, q0 + off + s - a), max(hi, q0 + off + e - a)
        n = int(covered.sum())
        need = MIN_MATCH if y - x >= MIN_MATCH else max(MIN_SEGMENT, math.ceil(MIN_IDENTITY * (y - x)))
        if n < need or y - x < MIN_ITEM:
            return None
        return n, int(lo), int(hi) - 1, matched / length


def segments(same: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint maximal scoring runs (match +1, else -2) that begin and end with a match."""
    out, start, best, best_end, score = [], -1, 0, 0, 0
    for t, ok in enumerate(same.tolist()):
        if ok:
            if start < 0:
                start, score, best = t, 0, 0
            score += 1
            if score >= best:
                best, best_end = score, t + 1
        elif start >= 0:
            score -= 2
            if score < 0 or score < best - 12:
                out.append((start, best_end))
                start = -1
    if start >= 0:
        out.append((start, best_end))
    return out


def _blocks(bench: DataFrame) -> Iterator[Matcher]:
    """The benchmark in blocks of bounded size, each by hash of its text."""
    items = bench.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = max(1, -(-2 * int(total) // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if part:
            yield Matcher([r["item_id"] for r in part], [r["text"] for r in part])


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row for each contaminated row of docs and item: doc_id, item_id, n_matched, first_word, last_word, identity."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(bench.dtypes)['item_id']}, n_matched long, first_word long, last_word long, identity double"

    def search(matcher: Matcher) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches):
            m = shared.value
            for batch in batches:
                for c in tv.chunks(batch.column(1)):
                    if found := list(m.find(c)):
                        d, i, n, a, b, same = map(list, zip(*found, strict=True))
                        ids = batch.column(0).slice(c.first, c.n_docs).take(pa.array(d))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([m.ids[k] for k in i]), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.float64())], names=["doc_id", "item_id", "n_matched", "first_word", "last_word", "identity"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = [search(m) for m in _blocks(bench)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates; no shuffle."""
    for matcher in _blocks(bench):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)
        at = docs.columns.index("text")

        def run(batches, shared=shared, at=at):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for c in tv.chunks(batch.column(at)):
                    for hit in shared.value.find(c):
                        keep[c.first + hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
