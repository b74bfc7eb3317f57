"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

1. Sizes are word counts. Sources (by code point, null last) get weights; targets share the
   whole size by weight, none above ``MAX_EPOCHS`` times its source's size, the excess reshared.
   The resharing ends at min(cap, level * weight); the level follows from a running sum over
   the sources ordered by cap / weight, so no loop is needed.
2. Each source's documents are shuffled by hash and laid end to end; ``BLOCK`` words make a
   block. Positions come from two-level running sums (hash buckets, then rows in a bucket),
   so a source with any share of the rows is spread over all tasks. The texts are read once: a table of
   doc_id, source, size and hashes is kept in the shared folder. Tables that grow with the documents are joined by sort and merge.
3. Slot i of the schedule has the point frac(i * golden ratio), here i * M mod 2**31 in integers;
   cumulative targets map the point to a source. Slots are ranked per source, again
   in two levels (runs of slots, then slots in a run). The r-th slot of a source takes its
   r-th block, epoch after epoch, until its target is taken. The last block of an epoch is short, so a source may need
   more slots than its share; it gets the missing ones after the schedule's end.
4. The block uses are joined with the document pieces on (source, block); a block
   holds at most BLOCK documents with words, so the join has no hot key.

Defined results. Null text has size 0; a source without words has target 0; documents without
words take 0. Rows with equal or null doc_id are rows of their own (ties are broken by text hash).
An empty table gives an empty result. Extra columns are ignored by the mix and kept, whatever their names, by ``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Store, text_hashes

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BLOCK = 128
BUCKETS, BUCKET_ROWS = 512, 100_000
RUN = 1 << 12
CELLS = 1 << 10
POINT_M, POINT_MOD = 1327217885, 1 << 31  # round(2**31 / golden ratio), odd
SPARE = 64  # slots beyond the targets' blocks, for the schedule's discrepancy


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> rank, weight, target, whole (words to take), lo and hi (its part of the unit interval).

    One row for each source: the windows without partitions run over that small table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs).withColumn("total", F.sum("source_size").over(every))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    # the level if the sources before this one, and only they, are at their caps; the first that stays below its cap settles it
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("free"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("v")))).over(every)["v"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    s = s.withColumn("whole", F.floor(F.col("target")).cast("long"))
    upto = by_name.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("lo", F.coalesce(F.sum("whole").over(upto), F.lit(0))).withColumn("all", F.sum("whole").over(every))
    return s.select("source", "rank", "weight", "source_size", "target", "whole", "all", (F.col("lo") * POINT_MOD / F.nullif("all", F.lit(0))).alias("lo"), ((F.col("lo") + F.col("whole")) * POINT_MOD / F.nullif("all", F.lit(0))).alias("hi"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, turn): the source of every slot and which of its slots that is, from 0.

    The unit interval is cut into CELLS cells; a point is compared only with the sources that
    reach into its cell, so long lists of sources need no broadcast.
    """
    width = POINT_MOD / CELLS
    total = targets.groupBy().agg(F.max("all").alias("all")).where(F.col("all") > 0)
    slots = F.floor(F.col("all") * 51 / 50 / block) + SPARE
    runs = total.select(slots.alias("slots"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((slots - 1) / RUN))).alias("run")).repartition("run")
    points = runs.select("run", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("slots")) - 1)).alias("slot"))
    points = points.withColumn("point", F.col("slot") % POINT_MOD * POINT_M % POINT_MOD).withColumn("cell", F.floor(F.col("point") / width))
    reach = targets.where("whole > 0").select("rank", "source_size", "whole", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("cell"))
    dealt = points.join(reach, "cell").where((F.col("lo") <= F.col("point")) & (F.col("point") < F.col("hi"))).select("run", "slot", "rank", "source_size", "whole")
    counts = dealt.groupBy("rank", "run").agg(F.count("*").alias("n"))
    before = counts.select("rank", "run", (F.sum("n").over(Window.partitionBy("rank").orderBy("run")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("k", F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1)
    return inside.join(before.hint("merge"), ["rank", "run"]).select("slot", "rank", "source_size", "whole", (F.col("before") + F.col("k")).alias("turn"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: int = 7, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words the mix takes of it, repeats counted)."""
    store = Store(docs.sparkSession, "mixing")
    rows = docs.select("doc_id", "source", *(h for h in text_hashes(F.col("text")) if extra), word_count(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))).alias("key"))
    digits = F.conv(F.substring("key", 1, 4), 16, 10).cast("long")
    rows = store.keep(rows.withColumn("bucket", digits % BUCKETS).withColumn("part", F.floor(digits / BUCKETS)))
    # buckets of many rows are cut into runs of their first digits, which changes no order
    step, n = 128, rows.count()
    while step > 1 and n > BUCKET_ROWS * BUCKETS * (128 // step):
        step //= 8 if step > 8 else step
    rows = rows.withColumn("part", F.floor(F.col("part") / step))
    by = ("source", "bucket", "part")
    buckets = rows.groupBy(*by).agg(F.sum("size").alias("n"))
    targets = store.keep(source_targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights))
    uses = store.keep(block_uses(targets, block))
    offsets = buckets.select(*by, (F.sum("n").over(Window.partitionBy("source").orderBy("bucket", "part")) - F.col("n")).alias("before"))
    order = Window.partitionBy(*by).orderBy("key", "size")
    placed = rows.withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("k", F.row_number().over(order))
    # a few rows for each source; joined with it first, the rows of a hot source meet them by bucket
    offsets = offsets.withColumnsRenamed({"source": "s1", "bucket": "b1", "part": "p1"}).join(targets.select(F.col("source").alias("s2"), "rank", "source_size", "target"), F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    placed = placed.join(offsets.hint("merge"), F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1")) & (F.col("part") == F.col("p1"))).drop("s1", "b1", "p1")
    begin = F.col("before") + F.coalesce(F.col("inside"), F.lit(0))
    placed = placed.select("doc_id", "source", *extra, "size", "source_size", "target", "rank", begin.alias("begin"), (begin + F.col("size")).alias("end"), "bucket", "part", "k")
    return _taken(placed, uses, block, extra)


def repeat_documents(docs: DataFrame, **params) -> DataFrame:
    """docs with every row as often as its taken words make up its size, rounded half up; rows without words go.

    Rows are matched to their part of the mix by doc_id, source and text (128 bits), and rows equal in all share it evenly.
    """
    mixed = mix_sources(docs, extra=("h1", "h2"), **params)
    copies = F.floor(F.coalesce(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0)), F.lit(0.0)) + 0.5).cast("int")
    per = mixed.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(copies.alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text_hashes(F.col("text")))
    same = F.col("row.doc_id").eqNullSafe(F.col("d")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return rows.join(per.hint("merge"), same).select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("i")).select("row.*")


def block_uses(targets: DataFrame, block: int) -> DataFrame:
    """(rank, block, times, more): how often a source's block is taken whole, and how many words of it once more."""
    blocks = F.ceil(F.col("source_size") / block)
    dealt = schedule(targets, block)
    need = F.floor(F.col("whole") / F.col("source_size")) * blocks + F.ceil(F.col("whole") % F.col("source_size") / block)
    had = dealt.groupBy("rank").agg(F.count("*").alias("had"))
    short = targets.where("whole > 0").join(had, "rank", "left").select("rank", F.coalesce("had", F.lit(0).cast("long")).alias("had"), need.alias("need")).where("had < need")
    late = short.select("rank", F.explode(F.sequence("had", F.col("need") - 1)).alias("turn"))
    late = late.join(targets.select("rank", "source_size", "whole"), "rank")
    turns = dealt.select("rank", "turn", "source_size", "whole").unionByName(late)
    turns = turns.withColumn("epoch", F.floor(F.col("turn") / blocks)).withColumn("block", F.col("turn") % blocks)
    start = F.col("epoch") * F.col("source_size") + F.col("block") * block
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    got = F.greatest(F.lit(0), F.least(length, F.col("whole") - start))
    turns = turns.select("rank", "block", length.alias("length"), got.alias("got")).where("got > 0")
    full = F.col("got") == F.col("length")
    return turns.groupBy("rank", "block").agg(F.sum(full.cast("long")).alias("times"), F.coalesce(F.sum(F.when(~full, F.col("got"))), F.lit(0)).alias("more"))


def _taken(placed: DataFrame, uses: DataFrame, block: int, extra: tuple[str, ...]) -> DataFrame:
    """Adds up, for every document, what the uses take of its pieces; a piece is its part in one block."""
    keep = ["doc_id", "source", *extra, "size", "source_size", "target"]
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    pieces = pieces.withColumn("a", F.greatest(F.col("begin") - F.col("block") * block, F.lit(0))).withColumn("b", F.least(F.col("end") - F.col("block") * block, F.lit(block)))
    joined = pieces.join(uses.hint("merge"), ["rank", "block"], "left")
    once = F.greatest(F.lit(0), F.least(F.col("b"), F.col("more")) - F.col("a"))
    part = F.when(F.col("times").isNull(), F.lit(0)).otherwise(F.col("times") * (F.col("b") - F.col("a")) + once)
    return joined.groupBy("rank", "bucket", "part", "k", *keep).agg(F.sum(part).cast("long").alias("taken")).select(*keep, "taken")


def oracle_sql(block: int = BLOCK, seed: int = 7) -> str:
    """DuckDB SQL for mix_sources over the view ``documents``."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH r0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws('|', '{seed}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r0 GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s0),
s2 AS (SELECT *, [{weights}][CAST(rnk % {len(WEIGHTS)} AS INT) + 1] AS w, source_size * {MAX_EPOCHS} AS cap, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev FROM s2
    WINDOW o AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT arg_min(lev, (cap / w, rnk)) FROM s3 WHERE lev * w <= cap) AS level FROM s3),
s5 AS (SELECT source, rnk, source_size, least(CAST(cap AS DOUBLE), level * w) AS target FROM s4),
s6 AS (SELECT *, CAST(floor(target) AS BIGINT) AS whole FROM s5),
s7 AS (SELECT *, CAST(sum(whole) OVER () AS BIGINT) AS al, CAST(coalesce(sum(whole) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS l0 FROM s6),
s8 AS (SELECT *, l0 * CAST({POINT_MOD} AS BIGINT) / nullif(al, 0) AS lo, (l0 + whole) * CAST({POINT_MOD} AS BIGINT) / nullif(al, 0) AS hi FROM s7),
p AS (SELECT slot, slot % {POINT_MOD} * {POINT_M} % {POINT_MOD} AS point FROM
    (SELECT unnest(range(CASE WHEN al > 0 THEN CAST(floor(al * 51 / 50 / {block}) AS BIGINT) + {SPARE} ELSE 0 END)) AS slot FROM (SELECT max(al) AS al FROM s7))),
d AS (SELECT slot, rnk, source_size, whole, row_number() OVER (PARTITION BY rnk ORDER BY slot) - 1 AS turn FROM p JOIN s8 ON lo <= point AND point < hi AND whole > 0),
e AS (SELECT *, turn // ((source_size + {block - 1}) // {block}) AS epoch, turn % ((source_size + {block - 1}) // {block}) AS blk FROM d),
f AS (SELECT rnk, blk, least({block}, source_size - blk * {block}) AS length, least(least({block}, source_size - blk * {block}), whole - epoch * source_size - blk * {block}) AS got FROM e),
u AS (SELECT rnk, blk, CAST(sum(CASE WHEN got = length THEN 1 ELSE 0 END) AS BIGINT) AS times, CAST(coalesce(sum(CASE WHEN got < length THEN got END), 0) AS BIGINT) AS more FROM f WHERE got > 0 GROUP BY ALL),
b AS (SELECT r0.*, s8.rnk, s8.source_size, s8.target,
    CAST(sum(size) OVER (PARTITION BY r0.source ORDER BY CAST('0x' || substr(key, 1, 4) AS BIGINT) % {BUCKETS}, key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin,
    row_number() OVER () AS id FROM r0 JOIN s8 ON r0.source IS NOT DISTINCT FROM s8.source),
q AS (SELECT *, unnest(CASE WHEN size > 0 THEN range((fin - size) // {block}, (fin - 1) // {block} + 1) ELSE [CAST(-1 AS BIGINT)] END) AS blk FROM b),
q2 AS (SELECT *, greatest(fin - size - blk * {block}, 0) AS x, least(fin - blk * {block}, {block}) AS y FROM q)
SELECT doc_id, source, size, source_size, target, CAST(sum(CASE WHEN times IS NULL THEN 0 ELSE times * (y - x) + greatest(0, least(y, more) - x) END) AS BIGINT) AS taken
FROM q2 LEFT JOIN u ON q2.rnk = u.rnk AND q2.blk = u.blk GROUP BY id, doc_id, source, size, source_size, target
"""
