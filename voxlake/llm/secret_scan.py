"""Secret scans: base patterns, and format likelihood under inferred probabilistic automata.

Grammar inference. The values that the base patterns find are labelled credentials of their
kind. For every kind a prefix tree of their character classes (with counts of ends)
is built, and states whose outgoing and ending frequencies are compatible (Hoeffding bound,
checked down the subtrees, where more than ``EVIDENCE`` values went through on both sides; the comparisons
at one depth share the level alpha, so that more values do not mean more states by chance) are merged in breadth-first order, as ALERGIA does. The result
is a deterministic probabilistic automaton. Every candidate of a text (a run of 16 or more
credential characters) is then scored: log-likelihood a character of its class string under the best
automaton, with the characters of a class equally likely, against a background model of ordinary runs, and
its characters' spread in the alphabet that it uses. No candidate is refused before. Candidates above the threshold that no base span touches are added with the kind
``format``. Base spans stay as they are.

Training takes every different value of all documents, which are read once: executors count the class strings, and the class bigrams and
characters of ordinary runs, so that the driver gets a fixed table for the background and, for the automata, the different class
strings of credentials with their counts. It holds these as one byte a character and two numbers a string; its work grows with
their length. The only minimum is ``LEAST`` values for a kind to have an automaton.
Candidates of every text are scored. The work grows with the length of a text and its matches.

Defined results. Null or empty text: zero counts, the digest of the empty string, no spans.
Without credentials the method adds nothing. Repeated rows give repeated rows; a null doc_id is
carried through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, deque
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .store import Store

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_SIGN = re.compile(rb"(?i:passw(?:or)?d|secret|token|api_?key)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # a greedy run of 32 or more is the whole run
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}")
EVIDENCE = 8
LEAST = 5  # values of a kind, below which it has no automaton
CLASSES, END = "0aAzZ+/_.=-", "$"
LAST, WIDTH = len(CLASSES), len(CLASSES) + 1
_RUN = np.zeros(256, dtype=bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True


def base_matches(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) of the base patterns in UTF-8 bytes, by start, then kind."""
    found = []
    if _ASSIGN_SIGN.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def symbols(value: bytes) -> str:
    """Classes of characters: digit 0, hex letter a or A, other letter z or Z, else the character."""
    return "".join("0" if 48 <= b <= 57 else "a" if 97 <= b <= 102 else "A" if 65 <= b <= 70 else "z" if 103 <= b <= 122 else "Z" if 71 <= b <= 90 else chr(b) for b in value)


#: The number of a character's class (a class's name is one of its characters), LAST for others.
_CODE = np.array([CLASSES.find(symbols(bytes([b]))) % WIDTH for b in range(256)], dtype=np.uint8)


class Automaton:
    """A deterministic probabilistic automaton over class strings, inferred by state merging.

    The prefix tree is not built as objects: what is left of a string lies, as a place in ``buf``, where its way through the merged states
    ends. Trees are counted from these places down to ``EVIDENCE`` strings, for comparison.
    """

    def __init__(self, strings: list[str] | pa.Array, copies: np.ndarray | None = None, alpha: float = 0.05):
        """strings: a list of class strings, or an Arrow array of them that end in END; copies: how often each occurs."""
        if isinstance(strings, list):
            strings = pa.array([s + END for s in strings], pa.string())
        offs, data = tv.buffers(strings)
        self._buf = _CODE[data[: offs[-1]]].tobytes()
        copies = np.ones(len(strings), dtype=np.int64) if copies is None else copies
        self._alpha = alpha
        self._merge_all(offs[:-1], copies)
        self.red = list(range(len(self._next)))
        self.next = [{c: n for c, n in zip(CLASSES, row, strict=False) if n >= 0} for row in self._next.tolist()]
        totals = self._count.sum(axis=1).tolist()
        self.cost = [{c: math.log((n + 0.02) / (total + 0.02 * (len(CLASSES) + 1))) for c, n in zip(CLASSES, row, strict=False)} for row, total in zip(self._count.tolist(), totals, strict=True)]
        del self._buf, self._blue, self._trees

    def _sums(self, group: np.ndarray, groups: int, pos: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """How many strings of each group go on with each class, or end."""
        code = np.frombuffer(self._buf, dtype=np.uint8)[pos]
        return np.bincount(group * WIDTH + code, copies, groups * WIDTH).astype(np.int64).reshape(groups, WIDTH)

    def _read(self, pos: np.ndarray, copies: np.ndarray, state: int) -> None:
        """Reads strings on from a merged state: counts their ways, and leaves them at the successors that are not merged yet."""
        at = np.full(len(pos), state, dtype=np.int64)
        buf = np.frombuffer(self._buf, dtype=np.uint8)
        left: dict[int, list] = {}
        while len(pos) > 8:
            code = buf[pos]
            self._count += self._sums(at, len(self._count), pos, copies)
            to, way = self._next[at, code], at * WIDTH + code
            off = np.flatnonzero((to < 0) & (code < LAST))
            off = off[np.argsort(way[off], kind="stable")]
            ways, first = np.unique(way[off], return_index=True)
            for k, part in zip(ways.tolist(), np.split(off, first[1:]), strict=False):
                left.setdefault(k, []).append((pos[part] + 1, copies[part]))
            on = np.flatnonzero(to >= 0)
            pos, copies, at = pos[on] + 1, copies[on], to[on]
        table, counted = self._next.ravel().tolist(), Counter()
        for i, n, s in zip(pos.tolist(), copies.tolist(), at.tolist(), strict=True):
            while True:
                k = s * WIDTH + self._buf[i]
                counted[k] += n
                s, i = table[k], i + 1
                if s < 0:
                    break
            if k % WIDTH < LAST:
                left.setdefault(k, []).append((np.array([i]), np.array([n])))
        for k, n in counted.items():
            self._count[divmod(k, WIDTH)] += n
        for k, parts in sorted(left.items()):
            parts += [self._blue[k]] if k in self._blue else []
            self._blue[k] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            self._trees.pop(k, None)

    def _tree(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and successors of the prefix tree at an unmerged successor, as far as more than EVIDENCE strings go."""
        if key not in self._trees:
            buf = np.frombuffer(self._buf, dtype=np.uint8)
            pos, copies = self._blue[key]
            group, counts, nexts, groups, nodes = np.zeros(len(pos), dtype=np.int64), [], [], 1, 1
            while groups:
                counts.append(self._sums(group, groups, pos, copies))
                deep = counts[-1] > EVIDENCE
                deep[:, LAST] = False
                number = np.cumsum(deep).reshape(deep.shape) - 1
                nexts.append(np.where(deep, number + nodes, -1))
                groups = int(deep.sum())
                nodes += groups
                on = np.flatnonzero(deep[group, buf[pos]])
                group = number[group[on], buf[pos[on]]]
                pos, copies = pos[on] + 1, copies[on]
            self._trees[key] = np.concatenate(counts), np.concatenate(nexts)
        return self._trees[key]

    def _graph(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Counts and successors of the merged states and, after them, of all trees; where each tree's root is."""
        counts, nexts, roots, n = [self._count], [self._next.copy()], {}, len(self._count)
        for key in self._blue:
            count, follow = self._tree(key)
            roots[key] = nexts[0][divmod(key, WIDTH)] = n
            counts.append(count)
            nexts.append(np.where(follow >= 0, follow + n, -1))
            n += len(count)
        return np.concatenate(counts), np.concatenate(nexts), roots

    def _compatible(self, count: np.ndarray, follow: np.ndarray, rows: dict[int, tuple], p: int, q: int) -> bool:
        """Whether the frequencies of both agree, and those below them as far as there is evidence; a depth's comparisons share alpha."""
        bound = math.sqrt(0.5 * math.log(2 / self._alpha))
        while True:  # as long as there is one pair
            for k in (p, q):
                if k not in rows:
                    rows[k] = count[k].tolist(), int(count[k].sum()), follow[k].tolist()
            (x, m, c), (y, n, d) = rows[p], rows[q]
            most = bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if any(abs(u / m - v / n) > most for u, v in zip(x, y, strict=True)):
                return False
            pairs = [(u, v) for u, v in zip(c, d, strict=True) if u >= 0 and v >= 0 and u != v]
            if len(pairs) != 1:
                break
            [(p, q)] = pairs
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        while len(a):
            x, y = count[a], count[b]
            m, n = x.sum(axis=1, keepdims=True), y.sum(axis=1, keepdims=True)
            if (np.abs(x / m - y / n) > math.sqrt(0.5 * math.log(2 * len(a) / self._alpha)) * (1 / np.sqrt(m) + 1 / np.sqrt(n))).any():
                return False
            a, b = follow[a], follow[b]
            both = (a >= 0) & (b >= 0) & (a != b)
            a, b = a[both], b[both]
        return True

    def _merge_all(self, pos: np.ndarray, copies: np.ndarray) -> None:
        self._next = np.full((1, WIDTH), -1, dtype=np.int64)
        self._count = np.zeros((1, WIDTH), dtype=np.int64)
        self._blue: dict[int, tuple] = {}
        self._trees: dict[int, tuple] = {}
        self._read(pos, copies, 0)
        waiting = deque(self._blue)  # breadth first
        while waiting:
            key = waiting.popleft()
            count, follow, roots = self._graph()
            rows: dict[int, tuple] = {}
            to = next((p for p in range(len(self._next)) if self._compatible(count, follow, rows, p, roots[key])), len(self._next))
            if to == len(self._next):
                self._next = np.vstack([self._next, np.full((1, WIDTH), -1, dtype=np.int64)])
                self._count = np.vstack([self._count, np.zeros((1, WIDTH), dtype=np.int64)])
            self._next[divmod(key, WIDTH)] = to
            del self._trees[key]
            known = set(self._blue)
            self._read(*self._blue.pop(key), to)
            waiting.extend(k for k in self._blue if k not in known)

    def per_char(self, s: str) -> float:
        """Mean log-likelihood of a character; an unknown step restarts at the root at a cost."""
        at, sum_ = 0, 0.0
        for ch in s:
            sum_ += self.cost[at].get(ch, -6.0)
            at = self.next[at].get(ch, -1)
            if at < 0:
                at = 0
                sum_ -= 2.0
        return sum_ / max(len(s), 1)


#: How many characters each class has.
_SIZES = {"0": 10, "a": 6, "A": 6, "z": 20, "Z": 20} | dict.fromkeys("+/_.=-", 1)


def _spread(value: bytes) -> float:
    """Entropy of the characters in bits, against the most that the length and the classes in use allow."""
    n = len(value)
    h = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    most = min(n, sum(_SIZES[c] for c in set(symbols(value))))
    return h / math.log2(most) if most > 1 else 0.0


def tally(values: pa.Array) -> np.ndarray:
    """How often each class follows each other one (or a value's start) in the values and then how often each byte occurs."""
    offs, data = tv.buffers(values)
    data = data[offs[0] : offs[-1]]
    code = _CODE[data].astype(np.int64)
    before = np.concatenate([[LAST], code])[:-1] if len(code) else code
    before[(offs[:-1] - offs[0])[np.diff(offs) > 0]] = LAST
    return np.concatenate([np.bincount(before * WIDTH + code, minlength=WIDTH * WIDTH), np.bincount(data, minlength=256)])


class FormatModel:
    """One automaton for each labelled kind and a background model of class bigrams of ordinary runs."""

    def __init__(self, values: dict[str, list[bytes]], ordinary: list[bytes], threshold: float = 0.35):
        automata = {k: Automaton(list(map(symbols, v))) for k, v in sorted(values.items()) if len(v) >= LEAST}
        self._set(automata, tally(pa.array([v.decode() for v in ordinary], pa.string())), threshold)

    @classmethod
    def counted(cls, automata: dict[str, Automaton], ordinary: np.ndarray, threshold: float = 0.35) -> FormatModel:
        """From the tally of all ordinary runs."""
        model = cls.__new__(cls)
        model._set(automata, ordinary, threshold)
        return model

    def _set(self, automata: dict[str, Automaton], ordinary: np.ndarray, threshold: float) -> None:
        self.automata = automata
        pairs, chars = ordinary[: WIDTH * WIDTH].reshape(WIDTH, WIDTH).tolist(), ordinary[WIDTH * WIDTH :].tolist()
        self.ground = {(a, b): math.log((n + 0.5) / (sum(row) + 0.5 * len(CLASSES))) for a, row in zip(CLASSES + "^", pairs, strict=True) for b, n in zip(CLASSES, row, strict=False)}
        # of a character in its class: ordinary runs against equal shares
        classes = Counter()
        for b, n in enumerate(chars):
            classes[symbols(bytes([b]))] += n
        self.excess = {b: math.log((chars[b] + 1) / (classes[c] + _SIZES[c]) * _SIZES[c]) for b in np.flatnonzero(_RUN).tolist() for c in [symbols(bytes([b]))]}
        self.threshold = threshold

    def score(self, value: bytes) -> float:
        """How much likelier a character is in a credential than in an ordinary run, in nats."""
        if not self.automata:
            return -math.inf
        s = symbols(value)
        ground = sum(self.ground[p] for p in zip("^" + s, s, strict=False)) / len(s)
        excess = sum(self.excess[b] for b in value) / len(s)
        return max(a.per_char(s) for a in self.automata.values()) - ground - excess + _spread(value) - 1

    def accepts(self, value: bytes) -> bool:
        """Credential-like: likelihood above the background's."""
        return self.score(value) > self.threshold


def candidates(chunk: tv.Chunk, least: int = 16) -> list[tuple[int, int, int]]:
    """(document, start, end) of all runs of credential characters of at least that length, within documents."""
    if not len(chunk.buf):
        return []
    table = _RUN.astype(np.uint8)
    s, e, first = chunk.words(table)
    at = np.flatnonzero(e - s >= least)
    doc = np.searchsorted(first, at, side="right") - 1
    return list(zip(doc.tolist(), s[at].tolist(), e[at].tolist(), strict=True))


def apart(base: list[tuple], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that no base match touches."""
    if not base:
        return runs
    starts = [m[0] for m in base]
    ends = list(accumulate((m[2] for m in base), max))
    return [(s, e) for s, e in runs if not (k := bisect_left(starts, e)) or ends[k - 1] <= s]


def fit(docs: DataFrame) -> FormatModel:
    """Learns the formats from all different base values of each kind, and the background from all different ordinary runs."""

    def gather(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                kinds, values = [], []
                runs: dict[int, list[tuple[int, int]]] = {}
                for d, s, e in candidates(c, 12):
                    runs.setdefault(d, []).append((s, e))
                for d in range(c.n_docs):
                    a, b = int(c.offs[d]), int(c.offs[d + 1])
                    text = c.buf[a:b].tobytes()
                    base = base_matches(text)
                    kinds += [KINDS[m[1]] for m in base]
                    values += [m[3] for m in base]
                    for s, e in apart(base, [(s - a, e - a) for s, e in runs.get(d, ())]):
                        kinds.append("")
                        values.append(text[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([v.decode() for v in values], pa.string())], names=["kind", "value"])

    def tallies(batches):
        total = sum((tally(batch.column(0)) for batch in batches), np.zeros(WIDTH * WIDTH + 256, dtype=np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["k", "n"])

    found = Store(docs.sparkSession, "secrets").keep(docs.select("text").mapInArrow(gather, "kind string, value string").distinct())
    ordinary = np.zeros(WIDTH * WIDTH + 256, dtype=np.int64)
    for r in found.where("kind = ''").select("value").mapInArrow(tallies, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        ordinary[r["k"]] = r["n"]
    letters = bytes(np.flatnonzero(_RUN).tolist())
    ways = found.where("kind != ''").groupBy("kind", F.concat(F.translate("value", letters.decode(), symbols(letters)), F.lit(END)).alias("way")).agg(F.count("*").alias("n")).toArrow()
    automata = {}
    for k in sorted(KINDS):
        own = ways.filter(pc.equal(ways["kind"], k))
        copies = own["n"].to_numpy()
        if copies.sum() >= LEAST:
            automata[k] = Automaton(own["way"].cast(pa.large_string()).combine_chunks(), copies)
    return FormatModel.counted(automata, ordinary)


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, model: FormatModel) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_format."""

    def run(batches):
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                runs: dict[int, list[tuple[int, int]]] = {}
                for d, s, e in candidates(c):
                    runs.setdefault(d, []).append((s, e))
                rows = []
                for d in range(c.n_docs):
                    a, b = int(c.offs[d]), int(c.offs[d + 1])
                    text = c.buf[a:b].tobytes()
                    base = base_matches(text)
                    more = [(s, e) for s, e in apart(base, [(s - a, e - a) for s, e in runs.get(d, ())]) if model.accepts(text[s:e])]
                    if text.isascii() or not (base or more):
                        place = range(len(text) + 1)
                    else:  # code points before each byte
                        place = np.concatenate([[0], np.cumsum((c.buf[a:b] & 0xC0) != 0x80)]).tolist()
                    spans = [(place[m[0]], m[1], KINDS[m[1]], place[m[2]]) for m in base]
                    more = [(place[s], 3, "format", place[e]) for s, e in more]
                    plain = _joined([(s, k, e) for s, _, k, e in spans])
                    n = Counter(m[1] for m in base)
                    rows.append((n[0], n[1], n[2], hashlib.sha256(plain.encode()).hexdigest(), _joined([(s, k, e) for s, _, k, e in sorted(spans + more)]), len(more)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n_docs), *(pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
