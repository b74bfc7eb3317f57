"""Token-ID / binary output: concatenated ids with Elias-Fano coded document boundaries.

Format. Documents in ascending doc_id order (nulls first; equal ids keep a fixed order by
text hash) are range-partitioned, encoded by the tokenizers library and cut into shards of about
``SHARD_IDS`` ids. A shard is one row of a Parquet data set (Spark's committer makes a
rerun after a lost executor harmless): ``part``, ``shard``, ``n_docs``, ``n_ids``, ``first_doc``, ``last_doc``,
``ids`` (little-endian uint16, or uint32 where the vocabulary needs it), ``bounds`` (the Elias-Fano
code of the end of each document) and ``doc_ids`` (the Elias-Fano code of the ids less the
shard's first). Elias-Fano keeps about 2 + log2(n_ids / n_docs) bits a document; a select over
the unary high bits and the packed low bits returns any offset, so no 64-bit table is stored.

Encoding. Byte-level BPE splits a text before it merges, at white space and between letters, digits and other
characters. Pieces between places where it always splits are found with array operations, looked up by their 64-bit hashes in
a bounded table, and encoded by the library only if they are new; a text with a special token's string is one
piece. Results equal the library's on the whole text (two pieces with one hash in a table of ``CACHE``: 3e-14 a new piece).

Access. ``Shard`` gives any document's ids by two selects over the boundaries, and the places of a doc_id by binary search over
selects; ``read_documents`` does so for a list of ids. A select reads the unary bits from one mark to the next.

Defined results. Null text counts as empty: its only id is the end id. Repeated rows are
repeated documents. Null doc_ids come first. An empty table gives an empty data set. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import textvec as tv

SHARD_IDS = 1 << 20
CACHE = 750_000  # pieces kept by a Python worker; with their ids about 50 MB
LONGEST = 64  # bytes of a piece that is kept
SHARD_SCHEMA = "part int, shard int, n_docs int, n_ids long, first_doc long, last_doc long, n_null int, width int, ids binary, bounds binary, doc_ids binary"


class EliasFano:
    """Monotone non-negative numbers below or equal to ``last`` in near-minimal space.

    Layout: uint64 count, uint64 last, uint32 position of every ``EVERY``-th set high bit, packed low bits, unary high bits.
    """

    EVERY = 256

    def __init__(self, data: bytes):
        self.n, self.last = (int(v) for v in np.frombuffer(data[:16], "<u8"))
        self.low = self.low_bits(self.n, self.last)
        at = 16 + 4 * -(-self.n // self.EVERY)
        self._marks = np.frombuffer(data[16:at], "<u4")
        cut = at + (self.n * self.low + 7) // 8
        self._lows = np.frombuffer(data[at:cut], np.uint8)
        self._high = np.frombuffer(data[cut:], np.uint8)

    @staticmethod
    def low_bits(n: int, last: int) -> int:
        return max(0, (last // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values, dtype=np.uint64)
        n, last = len(v), int(v[-1]) if len(v) else 0
        low = cls.low_bits(n, last)
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) if n else 0) + 1, dtype=np.uint8)
        unary[ones] = 1
        packed = np.packbits(bits, bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()
        return np.array([n, last], "<u8").tobytes() + ones[:: cls.EVERY].astype("<u4").tobytes() + packed

    def select(self, i: int) -> int:
        """The i-th number: from the marked bit before it, at most EVERY set bits on, joined with its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        mark = i // self.EVERY
        start = int(self._marks[mark])
        stop = int(self._marks[mark + 1]) if mark + 1 < len(self._marks) else 8 * len(self._high)
        ones = np.flatnonzero(np.unpackbits(self._high[start >> 3 : (stop >> 3) + 1], bitorder="little"))
        ones = ones[np.searchsorted(ones, start & 7) :]
        high = (start & ~7) + int(ones[i - mark * self.EVERY]) - i
        at = np.arange(i * self.low, (i + 1) * self.low)
        lows = (self._lows[at >> 3] >> (at & 7)) & 1 if self.low else at
        return (high << self.low) | int((lows.astype(np.int64) << np.arange(self.low)).sum())

    def find(self, value: int) -> range:
        """The places of a value, by binary search over select."""
        place = lambda v: bisect_left(range(self.n), v, key=self.select)
        return range(place(value), place(value + 1))

    def all(self) -> np.ndarray:
        """All numbers at once."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        if not self.low:
            return high.astype(np.int64)
        bits = np.unpackbits(self._lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        lows = (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((high << np.uint64(self.low)) | lows).astype(np.int64)


class HashTable:
    """64-bit keys to numbers, by open addressing; look-ups and inserts of whole arrays."""

    def __init__(self, bits: int = 21):
        self.keys, self.values, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is unknown."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in the table."""
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            own = free & (self.keys[at] == keys[left])
            self.values[at[own]] = values[left[own]]
            left, at = left[~own], (at[~own] + np.uint64(1)) & self.mask


#: White space as the splitter's pattern sees it: the ASCII bytes, and the UTF-8 codes of the other characters.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE = {2: np.array(sorted(int.from_bytes(c, "little") for c in _WIDE_SPACES if len(c) == 2)), 3: np.array(sorted(int.from_bytes(c, "little") for c in _WIDE_SPACES if len(c) == 3))}
_LEADS = np.zeros(256, dtype=bool)
_LEADS[sorted({c[0] for c in _WIDE_SPACES})] = True


def white_space(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _SPACE[buf]
    at = np.flatnonzero(_LEADS[buf])
    if len(at):
        code = np.zeros(len(buf) + 2, dtype=np.int64)
        code[: len(buf)] = buf
        two = code[at] | code[at + 1] << 8
        for width, value in ((2, two), (3, two | code[at + 2] << 16)):
            hit = at[np.isin(value, _WIDE[width])]
            for k in range(width):
                out[hit + k] = True
    return out


#: Classes of the splitter's pattern: 1 letters, 2 digits, 3 other characters; 0 white space and what is not classified here.
_CLASS = np.zeros(256, dtype=np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3
_CLASS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = 4  # all two-byte characters of these are letters, but for two


def character_classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _CLASS[buf]
    at = np.flatnonzero(out == 4)
    if len(at):
        next_ = buf[at + 1]
        letter = (buf[at] != 0xC3) | ((next_ != 0x97) & (next_ != 0xB7))
        out[at] = out[at + 1] = letter
    return out


class PieceEncoder:
    """Ids of whole texts by the library, each distinct piece once."""

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        name = type(self.tok.pre_tokenizer).__name__ if self.tok.pre_tokenizer else ""
        self.by_piece = name == "ByteLevel" and self.tok.normalizer is None and not getattr(self.tok.pre_tokenizer, "add_prefix_space", True)
        self.end_id = end_id
        feed = self.tok.encode("\n", add_special_tokens=False).ids if self.by_piece else []
        self.feed = feed[0] if len(feed) == 1 else None
        self._reset()

    def _reset(self) -> None:
        """An empty cache; its first entry is the end id."""
        self.table, self.n, self.used = HashTable(), 1, 1
        self.begin, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.kind)
        self.pool[0], self.size[0] = self.end_id, 1

    def cuts(self, chunk: tv.Chunk) -> np.ndarray:
        """Where pieces begin: at documents, at white space after other characters, at the last character of a longer run
        that other characters follow, after it if it is no blank (a blank belongs to what follows), and between
        characters of two classes, but for an apostrophe and a letter, which may be a contraction."""
        buf, docs = chunk.buf, chunk.offs[:-1][np.diff(chunk.offs) > 0]
        cut = np.zeros(len(buf), dtype=bool)
        if self.by_piece and len(buf):
            space = white_space(buf)
            np.greater(space[1:], space[:-1], out=cut[1:])
            after = np.flatnonzero(space[:-1] > space[1:]) + 1
            starts = np.zeros(len(buf), dtype=bool)
            starts[docs] = True
            after = after[~starts[after]]
            last = after - 1
            while (wide := (buf[last] & 0xC0) == 0x80).any():
                last = last - wide
            cut[last] = True
            cut[after[buf[after - 1] != 32]] = True
            kind = character_classes(buf)
            a, b = kind[:-1], kind[1:]
            cut[1:] |= (a != b) & (a != 0) & (b != 0) & ((b != 1) | (buf[:-1] != 39))
            raw = buf.tobytes()
            for sign in self.special:
                at = raw.find(sign)
                while at >= 0:
                    d = int(np.searchsorted(chunk.offs, at, side="right")) - 1
                    cut[chunk.offs[d] : chunk.offs[d + 1]] = False
                    at = raw.find(sign, int(chunk.offs[d + 1]))
        cut[docs] = True
        return np.flatnonzero(cut)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), sizes

    def _lines(self, pieces: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of n pieces given as lines: a line feed between others is always a piece of its own, with one id."""
        ids = np.array(self.tok.encode_batch_fast([pieces.decode()], add_special_tokens=False)[0].ids, self.kind)
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != n:
            raise RuntimeError("the tokenizer does not keep line feeds apart")
        return np.delete(ids, feeds), np.diff(feeds, prepend=-1) - 1

    def _learn(self, raw: bytes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Encodes the pieces raw[s:e]; their numbers in the cache."""
        spans = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        if self.feed is None:
            ids, sizes = self._library([x.decode() for x in spans])
        else:
            # pieces that end with white space or hold a special token's string go to the library one by one, after the others
            last = np.frombuffer(raw, np.uint8)[e - 1]
            odd = _SPACE[last]
            for k in np.flatnonzero(last >= 0x80).tolist():
                odd[k] = spans[k].decode()[-1].isspace()
            if any(t in raw for t in self.special):
                odd |= np.array([any(t in x for t in self.special) for x in spans])
            plain = [x for x, o in zip(spans, odd.tolist(), strict=True) if not o]
            parts = [self._lines(b"\n".join(plain[k : k + 2048]) + b"\n", len(plain[k : k + 2048])) for k in range(0, len(plain), 2048)]
            parts.append(self._library([x.decode() for x, o in zip(spans, odd.tolist(), strict=True) if o]))
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), self.kind)])
        if self.n + len(sizes) > len(self.size):
            grown = np.zeros(max(len(self.size), len(sizes)), np.int32)
            self.begin, self.size = np.concatenate([self.begin, grown]), np.concatenate([self.size, grown])
        self.pool[self.used : self.used + total] = ids
        numbers = np.arange(self.n, self.n + len(sizes))
        self.begin[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(sizes), self.used + total
        if self.feed is not None:
            numbers[order] = numbers.copy()
        return numbers

    def encode(self, chunk: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a chunk, end ids included, and how many each has."""
        if self.n > CACHE or self.used > 8 * CACHE:
            self._reset()
        s = self.cuts(chunk)
        e = np.append(s[1:], len(chunk.buf)) if len(s) else s
        key = chunk.span_hash(chunk.prefix(), s, e) | np.uint64(1)
        number = self.table.get(key)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            raw, at = chunk.buf.tobytes(), new[first]
            found = self._learn(raw, s[at], e[at])
            number[new] = found[back]
            short = e[at] - s[at] <= LONGEST
            self.table.put(distinct[short], found[short])
        # the end id after each document's pieces
        ends = np.searchsorted(s, chunk.offs[1:])
        number = np.insert(number, ends, 0)
        bounds = np.concatenate([[0], ends + np.arange(1, chunk.n_docs + 1)])
        size = self.size[number].astype(np.int64)
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[number] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, tv.per_doc(size, bounds)


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> PieceEncoder:
    """One for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path, end_id)


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, partitions: int | None = None) -> None:
    """Encodes every text of docs and writes the data set to path."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, end_id)
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        keys: list[pa.Array] = []
        held = 0

        def flush():
            nonlocal shard, held
            lengths, key = np.concatenate(sizes), pa.concat_arrays(keys)
            known = key.drop_null().to_numpy()
            first, last = (int(known[0]), int(known[-1])) if len(known) else (None, None)
            row = [part, shard, len(lengths), int(lengths.sum()), first, last, key.null_count, enc.kind.itemsize, np.concatenate(ids).tobytes(), EliasFano.encode(np.cumsum(lengths)), EliasFano.encode((known - (first or 0)).astype(np.uint64))]
            shard, held = shard + 1, 0
            ids.clear(), sizes.clear(), keys.clear()
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                found, lengths = enc.encode(c)
                ids.append(found), sizes.append(lengths), keys.append(batch.column(0).slice(c.first, c.n_docs))
                held += len(found)
                if held >= SHARD_IDS:
                    yield flush()
        if ids:
            yield flush()

    # rows of one doc_id are dealt by text, copies of a row by where they were read
    order = (F.col("doc_id").asc_nulls_first(), "h", "p")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p"))
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


class Shard:
    """A decoded row of the data set: any document's ids by two selects."""

    def __init__(self, first: int, nulls: int, width: int, ids: bytes, bounds: bytes, doc_ids: bytes):
        self.first, self.nulls = first, nulls
        self.ids = np.frombuffer(ids, f"<u{width}")
        self.ends, self.keys = EliasFano(bounds), EliasFano(doc_ids)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def places(self, doc_id: int) -> range:
        """Where the documents of a doc_id are."""
        found = self.keys.find(doc_id - self.first) if doc_id >= self.first else range(0)
        return range(found.start + self.nulls, found.stop + self.nulls)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the rows with these doc_ids; only shards that may hold one of them are read."""
    if not doc_ids:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    near = reduce(Column.__or__, (F.lit(k).between(F.col("first_doc"), F.col("last_doc")) for k in doc_ids))
    asked = sorted(set(doc_ids))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(*r.values())
                found = [(k, shard.document(i).tolist()) for k in asked for i in shard.places(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    rows = spark.read.parquet(path).where(near).select("first_doc", "n_null", "width", "ids", "bounds", "doc_ids")
    return rows.mapInArrow(run, "doc_id long, ids array<long>")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the data set: doc_id, start, n_tokens and ids_crc32, decoded from the shards.

    Starts are sums over three levels: documents in a shard, shards of a part, parts. The
    last has one row for each partition of the writer, so its window is small.
    """
    shards = spark.read.parquet(path)
    heads = shards.select("part", "shard", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = heads.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("in_part")).join(parts, "part").select("part", "shard", (F.col("in_part") + F.col("part_start")).alias("base"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                part, shard, n, first, nulls, width = (batch.column(k)[r].as_py() for k in range(6))
                ids = np.frombuffer(batch.column(6)[r].as_buffer(), f"<u{width}").astype("<u4")
                ends = EliasFano(batch.column(7)[r].as_py()).all()
                begins = np.concatenate([[0], ends[:-1]])
                known = EliasFano(batch.column(8)[r].as_py()).all() + (first or 0)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
                key = pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known, type=pa.int64())])
                where = [pa.array(np.full(n, v, dtype=np.int32)) for v in (part, shard)]
                yield pa.RecordBatch.from_arrays([*where, key, pa.array(begins), pa.array(ends - begins), pa.array(crc, type=pa.int64())], names=["part", "shard", "doc_id", "begin", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "shard", "n_docs", "first_doc", "n_null", "width", "ids", "bounds", "doc_ids").mapInArrow(run, "part int, shard int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("begin") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
