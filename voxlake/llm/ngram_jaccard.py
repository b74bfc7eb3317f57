"""N-gram Jaccard join: near-duplicate documents with Bayesian candidate pruning.

Words are runs of letters and digits with A-Z folded; a document's set holds the hashes of its five-word
shingles (a shorter text is one shingle). Documents are linked if the Jaccard similarity of their sets is 0.8 or more.

1. Copies. Documents with equal texts form one node, keyed by 128 bits of the text's hash, before anything is compared.
2. Candidates. 128 MinHash values a node, in 32 bands of 4: a pair at the threshold shares no band with
   probability 5e-8. A bucket of up to ``SMALL`` nodes gives all its pairs as rows. A pair belongs to the first band on which it agrees.
3. Dense groups. A node of larger buckets belongs to the group of its largest one, and groups with the same centre are one.
   The centre C is the set of the shingles that most of some members hold; any C gives right results. As two sets share at least
   ``|x & C| + |y & C| - |C|`` shingles, a pair whose margins (``18 |x & C| - 8 |x| - 9 |C|``) do not add up to less than 0 is
   linked without being compared. These links are counted for every node from the numbers of nodes of each margin,
   and joined by a star to the node of the largest margin. Only pairs with a lower sum, of which one margin is negative, are compared.
   In the same way the pairs of a larger bucket are compared only if they are of two groups, so one node is not of the bucket's
   commonest group. Such nodes, and those of negative margin, are dealt by hash into parts of about ``BLOCK`` nodes and ``BLOCK_BYTES`` of
   shingles, their partners as well, and every two parts are one task, so no pair is left out, no task holds a group and no pairs become rows.
4. Pruning. The MinHash values of a pair are compared ``STEP`` at a time; with m of n equal and a uniform prior the posterior
   probability of similarity >= t is P(Binomial(n + 1, t) <= m). Below ``TOLERANCE`` the pair is dropped.
5. Verification. The rest are verified exactly on their shingle sets.
6. Classes. Connected components of the links by alternating large-star and small-star steps, each written
   to the shared folder; a class is named by its least doc_id.

So every document gets its class, and ``n_links`` is the number of different texts that its text is linked to. A group of n near
copies of which f lie far from the centre costs n + f * n comparisons, not n * n.

Defined results. Texts without words are linked to nothing: each is a class of its own. Null texts count as empty.
Repeated rows share a class. A null doc_id is carried through; a class of null ids only has a null name. An empty table gives an
empty result. Extra columns are ignored by the join and kept by the filter. Similarity ties need no order: every link counts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import textvec as tv
from .store import Store, sized, text_hashes

SHINGLE, THRESHOLD = 5, 0.8
_OF, _SUM = 9, 4  # linked: 9 |x & y| >= 4 (|x| + |y|), which is similarity >= 4/5
HASHES, BAND = 128, 4
BANDS = HASHES // BAND
STEP, TOLERANCE = 16, 1e-5
SMALL, BLOCK, BLOCK_BYTES = 32, 1024, 32 << 20
WITNESSES = 15  # members that a group's centre is made of
_rng = np.random.default_rng(5)
_A, _B = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


def shingles(chunk: tv.Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in document order, and the bounds of each document."""
    s, e, first = chunk.words(tv.ALNUM_WORDS)
    h = chunk.span_hash(chunk.prefix(tv.FOLDED_VALUES), s, e)
    size = np.diff(first)
    grams = tv.ngrams(h, n)
    doc = np.repeat(np.arange(chunk.n_docs), size)
    ok = doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)]
    values, owner = grams[ok], doc[: len(grams)][ok]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        # words of a short text combined in order, with its length
        acc = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = size[short] > k
            acc[has] = tv.mix(acc[has] * np.uint64(31) + h[first[:-1][short[has]] + k])
        values = np.concatenate([values, tv.mix(acc + size[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, np.searchsorted(owner, np.arange(chunk.n_docs + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (documents with shingles x HASHES), the low 16 bits of 32-bit minima."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), HASHES), dtype=np.uint16)
    if len(starts):
        hi, lo = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(hi * _A[k] + lo * _B[k], starts)
    return out


def least_matches(t: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n comparisons fewer than m equal values end a pair."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p = m = 0
        while True:
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _nodes(docs: DataFrame) -> DataFrame:
    """(h1, h2, rep, copies, sig): one row for each different text; sig is null without words."""

    def run(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(3)):
                values, bounds = shingles(c)
                sig = iter(signatures(values, bounds))
                rows = [next(sig).tobytes() if has else None for has in (np.diff(bounds) > 0).tolist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(c.first, c.n_docs) for k in range(3)), pa.array(rows, pa.binary())], names=["h1", "h2", "doc_id", "sig"])

    signed = docs.select(*text_hashes(F.col("text")), "doc_id", "text").mapInArrow(run, f"h1 long, h2 long, doc_id {dict(docs.dtypes)['doc_id']}, sig binary")
    return signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))


def _pairs_small(members: DataFrame) -> DataFrame:
    """All pairs of the buckets with up to SMALL nodes (members: key, band, node), with the first band that gives them."""
    sets = members.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"), F.min("band").alias("band"))
    i = F.explode(F.sequence(F.lit(0), F.size("m") - 2)).alias("i")
    pairs = sets.select("m", "band", i).select(F.get("m", F.col("i")).alias("a"), F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"), "band")
    return pairs.groupBy("a", "b").agg(F.min("band").alias("band"))


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows of x and y) the posterior leaves, by incremental comparison."""
    left, equal = np.arange(len(x)), np.zeros(len(x), dtype=np.int32)
    for n, m in least_matches():
        equal[left] += (x[left, n - STEP : n] == y[left, n - STEP : n]).sum(axis=1)
        left = left[equal[left] >= m]
    return left


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the posterior leaves, without those that agree on a band before theirs: a large bucket has them."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (3, 4))
            left = _agreeing(x, y)
            first = (x[left].reshape(-1, BANDS, BAND) == y[left].reshape(-1, BANDS, BAND)).all(axis=2).argmax(axis=1)
            yield batch.select(["a", "b"]).take(pa.array(left[first == batch.column(2).to_numpy()[left]]))

    sig = nodes.select("node", "sig")
    both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "x"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "y"}), "b").select("a", "b", "band", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the sorted shingle set of every wanted node, from the text of one of its documents."""
    reps = nodes.join(sized(wanted), "node", "left_semi").select("node", "rep", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    rows = docs.select(*text_hashes(F.col("text")), "doc_id", "text")
    few = F.broadcast(reps) if wanted.count() <= 500_000 else reps
    picked = rows.join(few, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

    def run(batches):
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                values, bounds = shingles(c)
                sets = [np.unique(values[a:b]).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n_docs), pa.array(sets, pa.binary())], names=["node", "s"])

    return picked.mapInArrow(run, "node long, s binary").dropDuplicates(["node"])


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _linked(n, x, y):
    """Whether sets of x and y shingles with n in common are similar enough."""
    return _OF * n >= _SUM * (x + y)


def _may_link(x, y):
    """Whether sets of these sizes can be."""
    return _linked(np.minimum(x, y), x, y)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) at or above the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                if _may_link(len(x), len(y)) and _linked(shared(x, y), len(x), len(y)):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    s = sets.select("node", "s")
    both = pairs.join(s.withColumnsRenamed({"node": "a", "s": "x"}), "a").join(s.withColumnsRenamed({"node": "b", "s": "y"}), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets i with sets j, exactly; many pairs of few sets as products of 0/1 matrices."""
    if len(i) <= 8 * len(sets):
        return np.array([shared(sets[a], sets[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    column = np.cumsum(times > 1) - 1  # values of one set only meet nothing
    often = times[code] > 1
    owner, code = owner[often], column[code[often]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)  # counts below 2**24 are exact
    for start in range(0, int((times > 1).sum()), width):
        lo, hi = np.searchsorted(code, [start, start + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[lo:hi], code[lo:hi] - start] = 1
        out += has @ has.T
    return out[i, j].astype(np.int64)


def block_links(sig: np.ndarray, sets: list[np.ndarray], part: np.ndarray, group: np.ndarray, margin: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """All links (i < j) between the parts of one task, or inside its only part.

    In a group (band -1): of pairs whose margins add up to less than 0. In a bucket: of pairs of two groups that agree on no earlier band.
    """
    bands = np.ascontiguousarray(sig).view(np.uint64)
    first = np.flatnonzero(part == part.min())
    second = np.flatnonzero(part == part.max())
    ones, others = [first[:0]], [first[:0]]
    step = max(1, (1 << 17) // max(len(second), 1))
    for start in range(0, len(first), step):
        i, j = (x.ravel() for x in np.meshgrid(first[start : start + step], second, indexing="ij"))
        open_ = margin[i] + margin[j] < 0 if band < 0 else group[i] != group[j]
        if part.min() == part.max():
            open_ &= i < j
        i, j = i[open_], j[open_]
        for b in range(band):
            new = bands[i, b] != bands[j, b]
            i, j = i[new], j[new]
        left = _agreeing(sig[i], sig[j])
        ones.append(np.minimum(i, j)[left])
        others.append(np.maximum(i, j)[left])
    i, j = np.concatenate(ones), np.concatenate(others)
    size = np.array(list(map(len, sets)))
    fits = _may_link(size[i], size[j])
    i, j = i[fits], j[fits]
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    ok = _linked(intersections([sets[k] for k in used], at[: len(i)], at[len(i) :]), size[i], size[j])
    return i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links."""
    near = np.zeros((n, n), dtype=bool)
    near[i, j] = near[j, i] = True
    new, out = near.any(axis=1), []
    for root in np.flatnonzero(new).tolist():
        stack = [root] if new[root] else []
        new[root] = False
        while stack:
            u = stack.pop()
            found = np.flatnonzero(near[u] & new).tolist()
            new[found] = False
            out += [(u, v) for v in found]
            stack += found
    return out


def centre(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles that more than half of the sets hold."""
    values, times = np.unique(np.concatenate(sets), return_counts=True)
    return values[2 * times > len(sets)]


def _groups(large: DataFrame, sets: DataFrame, store: Store) -> DataFrame:
    """(node, gid, margin, size, sure, top, high, low) of every node of a large bucket (large: key, node, n).

    sure: how many nodes of its group it is linked to by the margins; top: the node of the group's largest margin; high, low: its largest and least.
    """
    own = store.keep(large.groupBy("node").agg(F.max_by("key", F.struct("n", "key")).alias("g")))
    few = own.groupBy("g", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(WITNESSES)).alias("k")).agg(F.min("node").alias("node"))

    def center(t: pa.Table) -> pa.Table:
        c = centre([np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()]).tobytes()
        gid = int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little", signed=True)
        return pa.table({"g": t.column("g").slice(0, 1), "gid": pa.array([gid]), "c": pa.array([c], pa.binary())})

    centers = store.keep(few.join(sets, "node").select("g", "s").groupBy("g").applyInArrow(center, "g long, gid long, c binary"))
    units = centers.groupBy("gid").agg(F.first("c").alias("c"))
    # a hot group's rows meet its centre in as many places as the group has parts
    copies = F.ceil(F.count("*") / BLOCK).alias("copies")
    spread = own.groupBy("g").agg(copies).join(centers.select("g", "gid"), "g")
    own = own.join(spread, "g").withColumn("place", F.pmod(F.xxhash64("node", F.lit(9)), F.col("copies")))
    most = spread.groupBy("gid").agg(F.max("copies").alias("m"))
    units = units.join(most, "gid").select("gid", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("place"))

    def measure(batches):
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            found = [18 * shared(x := np.frombuffer(s, np.uint64), y := np.frombuffer(c, np.uint64)) - 8 * len(x) - 9 * len(y) for s, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64()), pc.binary_length(batch.column(2)).cast(pa.int64())], names=["node", "gid", "margin", "size"])

    placed = store.keep(own.join(sets, "node").join(units, ["gid", "place"]).select("node", "gid", "s", "c").mapInArrow(measure, "node long, gid long, margin long, size long"))
    tops = placed.groupBy("gid").agg(F.max(F.struct("margin", "node")).alias("top"), F.min("margin").alias("low")).select("gid", F.col("top.node").alias("top"), F.col("top.margin").alias("high"), "low")

    def sure(t: pa.Table) -> pa.Table:
        margin, n = t.column("margin").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(margin)
        above = np.concatenate([np.cumsum(n[order][::-1])[::-1], [0]])
        found = above[np.searchsorted(margin[order], -margin)] - (margin >= 0)
        return pa.table({"gid": t.column("gid"), "margin": t.column("margin"), "sure": pa.array(found.astype(np.int64))})

    # one row for each margin that occurs in a group
    known = placed.groupBy("gid", "margin").agg(F.count("*").alias("n")).groupBy("gid").applyInArrow(sure, "gid long, margin long, sure long").join(tops, "gid")
    return store.keep(placed.join(sized(store.keep(known)), ["gid", "margin"]))


def _tasks(large: DataFrame, groups: DataFrame, store: Store) -> DataFrame:
    """(unit, band, part, others, node, gid, margin): the nodes to be compared and the parts that each meets; band -1 is a group, else a large bucket."""
    far = F.col("margin") < 0
    open_ = groups.where(far | (F.col("margin") + F.col("low") < 0)).select(F.col("gid").alias("unit"), F.lit(-1).alias("band"), "node", "gid", "margin", "size", far.alias("active"))
    members = store.keep(large.select("key", "band", "node").join(groups.select("node", "gid", "margin", "size"), "node"))
    shares = members.groupBy("key", "gid").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "gid")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = members.join(sized(store.keep(shares)), "key").select(F.col("key").alias("unit"), "band", "node", "gid", "margin", "size", (F.col("gid") != F.col("most.gid")).alias("active"))
    rows = store.keep(open_.unionByName(mixed))
    # by number and by bytes
    count = lambda which: F.ceil(F.greatest(F.count_if(which) / BLOCK, F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(0)) / BLOCK_BYTES))
    parts = store.keep(rows.groupBy("unit", "band").agg(count(F.col("active")).alias("a"), count(~F.col("active")).alias("p")))
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(n, F.lit(1)))
    rows = rows.join(sized(parts), ["unit", "band"]).withColumn("part", F.when(F.col("active"), place(F.col("a"))).otherwise(F.col("a") + place(F.col("p"))))
    others = F.when(F.col("active"), F.col("a") + F.col("p")).otherwise(F.col("a"))
    return rows.select("unit", "band", "part", F.sequence(F.lit(0).cast("long"), others - 1).alias("others"), "node", "gid", "margin")


def _compared(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Task by task: a spanning forest (a, b) of all links found, and their number n of every node a (b null)."""
    full = tasks.join(sets, "node").withColumn("other", F.explode("others"))
    full = full.select("unit", "band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "gid", "margin", "sig", "s")

    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        i, j = block_links(sig, [np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()], *(t.column(c).to_numpy() for c in ("part", "gid", "margin")), t.column("band")[0].as_py())
        edges = np.array(forest(len(node), i, j), dtype=np.int64).reshape(-1, 2)
        n = np.bincount(np.concatenate([i, j]), minlength=len(node))
        has = np.flatnonzero(n)
        a, b = np.concatenate([node[edges[:, 0]], node[has]]), np.concatenate([node[edges[:, 1]], node[has]])
        counts = np.arange(len(a)) >= len(edges)
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=counts), "n": pa.array(np.concatenate([np.zeros(len(edges), np.int64), n[has]]))})

    return full.groupBy("unit", "band", "lo", "hi").applyInArrow(run, "a long, b long, n long")


def _links(docs: DataFrame, nodes: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes, those of dense groups as forests and stars, and (node, n_links) with every link counted."""
    signed = nodes.where("sig is not null")
    members = signed.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig").select(F.xxhash64(F.expr(f"substring(sig, band * {2 * BAND} + 1, {2 * BAND})"), "band").alias("key"), "node", "band")
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    known = store.keep(members.join(sizes, "key"))
    large = known.where(F.col("n") > SMALL)
    left = store.keep(_pruned(_pairs_small(known.where(F.col("n") <= SMALL)), nodes))
    wanted = store.keep(left.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct())
    sets = store.keep(_sets(docs, nodes, wanted).join(nodes.select("node", "sig"), "node"))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    if large.isEmpty():
        links = store.keep(_verified(left, sets))
        return links, ends(links).groupBy("node").agg(F.sum("n").alias("n_links"))
    groups = _groups(large, sets.select("node", "s"), store)
    of = groups.select("node", "gid")
    # pairs of one group are counted or compared there
    left = left.join(of.withColumnsRenamed({"node": "a", "gid": "ga"}), "a", "left").join(of.withColumnsRenamed({"node": "b", "gid": "gb"}), "b", "left")
    few = store.keep(_verified(left.where("ga is null or gb is null or ga <> gb").select("a", "b"), sets))
    many = store.keep(_compared(_tasks(large, groups, store), sets))
    stars = groups.where((F.col("margin") + F.col("high") >= 0) & (F.col("node") != F.col("top"))).select(F.col("node").alias("a"), F.col("top").alias("b"))
    degree = ends(few).unionByName(many.where("b is null").select(F.col("a").alias("node"), "n")).unionByName(groups.select("node", F.col("sure").alias("n")))
    return few.unionByName(many.where("b is not null").select("a", "b")).unionByName(stars), degree.groupBy("node").agg(F.sum("n").alias("n_links"))


def components(links: DataFrame, store: Store) -> DataFrame:
    """(node, root) of every node of an edge list (a, b): its component's least node."""
    edges = store.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = store.keep(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _classes(docs: DataFrame) -> DataFrame:
    """(h1, h2, node, rep, copies, worded, root, class_id, n_links): every different text with its class."""
    store = Store(docs.sparkSession, "jaccard")
    # numbers given when the table is written; all steps read them from there
    nodes = store.keep(_nodes(docs).withColumn("node", F.monotonically_increasing_id()))
    links, degree = _links(docs, nodes, store)
    roots = components(links, store)
    full = nodes.select("h1", "h2", "node", "rep", "copies", F.col("sig").isNotNull().alias("worded")).join(roots, "node", "left").join(degree, "node", "left")
    full = store.keep(full.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))))
    names = full.where("root <> node or n_links > 0").groupBy("root").agg(F.min("rep").alias("class_id"))
    return store.last(full.join(names, "root", "left").withColumn("class_id", F.coalesce("class_id", "rep")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, class_id (least doc_id of its class), n_links of its text, copies (rows with its text)."""
    classes = _classes(docs).select("h1", "h2", "class_id", "n_links", "copies", "worded")
    rows = docs.select("doc_id", *text_hashes(F.col("text"))).join(classes, ["h1", "h2"])
    own = F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", own.alias("class_id"), "n_links", F.when(F.col("worded"), F.col("copies")).otherwise(F.lit(1)).cast("long").alias("copies"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, the one with the least doc_id; texts without words all stay.

    Of rows with this doc_id and text the one with the least hash of all its columns stays.
    """
    # of the nodes of a class the first by doc_id, null last, and hash; one row a class
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h1", "h2")).alias("head")
    heads = _classes(docs).where("worded").groupBy("root").agg(first).select(F.col("head.rep").alias("rep"), F.col("head.h1").alias("g1"), F.col("head.h2").alias("g2"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text_hashes(F.col("text")), F.col("doc_id").alias("id"), F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)).alias("worded"))
    picked = rows.where("worded").join(heads, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("rep")))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    one = picked.groupBy("h1", "h2").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return one.select("row.*").unionByName(rows.where("not worded").select("row.*"))
