"""Vectorised word engine: NumPy over the UTF-8 bytes of an Arrow string column.

Texts are handled whole, in runs of documents of about ``CHUNK`` bytes (a longer
document forms a run of its own), so memory is bounded by the longest text.
Word hashes are prefix-polynomial hashes over 64-bit arithmetic: any byte span's
hash costs three array reads, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C1B)  # odd, so it has an inverse modulo 2**64
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_R, _RINV):
        p = np.full(n + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def byte_classes(separators: bytes | None = None, *, split_symbols: bool = False, alnum: bool = False) -> np.ndarray:
    """A table byte -> class; 0 separates, a change of class ends a word."""
    table = np.ones(256, dtype=np.uint8)
    if alnum or split_symbols:
        for b in range(128):
            if not chr(b).isalnum():
                table[b] = 2 if split_symbols else 0
    for b in separators if separators is not None else b" \t\n\x0b\x0c\r":
        table[b] = 0
    if alnum or split_symbols:
        for b in range(33):
            table[b] = 0
    return table


SPACE_WORDS = byte_classes()
ALNUM_WORDS = byte_classes(alnum=True)
SYMBOL_WORDS = byte_classes(split_symbols=True)
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]  # A-Z as a-z


class Chunk:
    """Some whole documents: ``buf`` their bytes, ``offs`` where each begins (and the end), ``first`` the first's row."""

    def __init__(self, first: int, buf: np.ndarray, offs: np.ndarray):
        self.first, self.buf, self.offs, self.n_docs = first, buf, offs, len(offs) - 1

    def prefix(self, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """H with H[e] - H[s] the polynomial of bytes s..e, times R**s."""
        n = len(self.buf)
        size = CHUNK
        while size < n:
            size *= 2
        self._pow, self._inv = _powers(size)
        h = np.empty(n + 1, dtype=np.uint64)
        h[0] = 0
        np.cumsum(values[self.buf] * self._pow[:n], out=h[1:])
        return h

    def span_hash(self, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((h[e] - h[s]) * self._inv[s])

    def words(self, classes: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and per document the number of the first word (and the end)."""
        c = classes[self.buf]
        n = len(c)
        if not n:
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(self.n_docs + 1, dtype=np.int64)
        change = np.empty(n + 1, dtype=bool)
        change[0] = change[n] = True
        np.not_equal(c[1:], c[:-1], out=change[1:n])
        change[self.offs] = True
        at = np.flatnonzero(change)
        word = c[at[:-1]] != 0
        s, e = at[:-1][word], at[1:][word]
        return s, e, np.searchsorted(s, self.offs)


def texts_of(column: pa.Array) -> pa.Array:
    """A null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column without nulls."""
    column = texts_of(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, o, d = column.buffers()
    if o is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offs = np.frombuffer(o, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs, np.frombuffer(d, dtype=np.uint8) if d is not None else np.zeros(0, dtype=np.uint8)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The whole column in order, in runs of whole documents."""
    offs, data = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        j = min(j, n)
        yield Chunk(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


_MULT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row (also over document ends; mask these): multilinear in the word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m] * _MULT[0]
    for k in range(1, n):
        out += h[k : k + m] * _MULT[k]
    return mix(out)


def ngram_docs(first: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Which n-gram starts lie within one document, and that document."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    m = max(0, total - n + 1)
    ok = doc[:m] == doc[n - 1 : n - 1 + m]
    return ok, doc


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[bounds[1:]] - c[bounds[:-1]]
