"""K-d tree shards: nodes are split at weighted medians along the dimension in which they are widest.

Each dimension of the metadata gives a row an order key of 63 bits: its value's place between the dimension's extremes
(31 bits), then a hash of what the row holds (32 bits), so that a third of all rows with one value still divides. Rows
that agree in both are told apart by their number in the written table; such rows are alike, so it doesn't matter which
of them goes where.

A node that is to become m shards is cut where the weight below comes nearest to floor(m/2)/m of its own; m = 2**k gives
medians. While nodes hold more than CELL rows, a level of the tree is one step of the whole table: an aggregate gives
each node's widest dimension, histograms of all its nodes at once are narrowed to the bucket that holds the cut until
single rows remain, and the rows of such nodes, no others, are written again with their new ones. A single shard with
more rows than CELL is cut further, into cells of nearly as many rows each. Nodes of up to CELL rows are one Arrow group each, in which the rest of
the tree is built by the same rule and rows are numbered. Trees, cuts and histograms are tables: nothing but the total
weight reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, dropped, written

#: Buckets of a node's histogram; rows of a node that one task takes to its end.
BUCKETS, CELL = 4096, 1 << 15
TOP = (1 << 31) - 1


def coordinate(df: DataFrame, name: str) -> Column:
    """A number that orders the column's values: numbers as they are, strings by their first six bytes; nulls lowest."""
    if dict(df.dtypes)[name] == "string":
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(-1.0))


def cuts(rows: DataFrame, big: DataFrame, cell: int) -> DataFrame:
    """(node, key, cut_row): where each node of `big` (node, d, lo, hi, n, m, sought) is cut; rows at or after (key, cut_row) go right.

    rows: (node, row, w, keys); w is summed to meet `sought`, or rows are counted where m is 1. Histograms narrow the keys
    among which the cut is (or the row numbers, where more than `cell` rows share one key) until no more than `cell` rows
    are left; of those the cut is told exactly."""
    # deep: the row numbers of one key, `key`, are searched; `below` is the sum before lo, n: rows from lo to hi
    open_ = big.select("node", "d", (F.col("m") > 1).alias("heavy"), F.lit(False).alias("deep"), F.lit(0).cast("long").alias("key"), "lo", "hi", F.lit(0.0).alias("below"), "n", "sought")
    held, ready = [], []
    met = lambda sums: Window.partitionBy("node").orderBy(F.when(F.col("below") + F.col("upto") >= F.col("sought"), F.lit(0)).otherwise(F.lit(1)), *sums)

    def near(state):
        key = F.element_at("keys", F.col("d") + 1)
        x = F.when(~F.col("deep"), key).when(key == F.col("key"), F.col("row"))
        v = F.when(F.col("heavy"), F.col("w")).otherwise(F.lit(1))
        return rows.select("node", "row", "w", "keys").join(state, "node").withColumn("v", v).withColumn("own", key).withColumn("x", x).where(F.col("x").between(F.col("lo"), F.col("hi")))

    while True:
        ready.append(open_.where(F.col("n") <= cell))
        open_ = open_.where(F.col("n") > cell)
        if open_.isEmpty():
            break
        # a step is 1 at least; differences of 63-bit keys fit a long
        b = F.expr(f"(x - lo) div ((hi - lo) div {BUCKETS} + 1)")
        seen = near(open_).withColumn("b", b).groupBy("node", "b").agg(F.sum("v").cast("double").alias("s"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("k"))
        upto = F.sum("s").over(Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        seen = seen.withColumn("upto", upto).join(open_, "node")
        # the first bucket that meets what is sought; should sums of doubles leave it unmet, the last
        hit = seen.withColumn("_r", F.row_number().over(met([F.when(F.col("below") + F.col("upto") >= F.col("sought"), F.col("b")).otherwise(-F.col("b"))]))).where("_r = 1")
        deeper = ~F.col("deep") & (F.col("x0") == F.col("x1"))
        below = (F.col("below") + F.col("upto") - F.col("s")).alias("below")
        open_ = written(hit.select("node", "d", "heavy", (F.col("deep") | deeper).alias("deep"), F.when(deeper, F.col("x0")).otherwise(F.col("key")).alias("key"), F.when(deeper, F.lit(0)).otherwise(F.col("x0")).cast("long").alias("lo"), F.when(deeper, F.lit(2**62)).otherwise(F.col("x1")).cast("long").alias("hi"), below, F.col("k").alias("n"), "sought"), "kd_open")
        held.append(open_)
    state = ready[0]
    for x in ready[1:]:
        state = state.unionByName(x)
    upto = F.sum(F.col("v").cast("double")).over(Window.partitionBy("node").orderBy("own", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = near(state).withColumn("upto", upto)
    at = [F.when(F.col("below") + F.col("upto") >= F.col("sought"), F.col("own")).otherwise(-F.col("own")), F.when(F.col("below") + F.col("upto") >= F.col("sought"), F.col("row")).otherwise(-F.col("row"))]
    few = few.withColumn("_r", F.row_number().over(met(at))).where("_r = 1")
    # that row goes to the side that comes nearer to what is sought
    left = F.col("sought") - (F.col("below") + F.col("upto") - F.col("v")) < F.col("below") + F.col("upto") - F.col("sought")
    out = written(few.select("node", F.col("own").alias("key"), (F.col("row") + F.when(left, 0).otherwise(1)).alias("cut_row")), "kd_cuts")
    for x in held:
        dropped(x)
    return out


def subtree(keys: np.ndarray, row: np.ndarray, w: np.ndarray, first: int, m: int) -> np.ndarray:
    """The shard of each row of a node that is to become the m shards from `first` on."""
    shard = np.full(w.size, first, np.int32)
    todo = [(np.arange(w.size), first, m)]
    while todo:
        own, s, m = todo.pop()
        if m == 1 or not own.size:
            shard[own] = s
            continue
        at = keys[own] >> 32
        d = int(np.argmax(at.max(axis=0) - at.min(axis=0)))
        own = own[np.lexsort((row[own], keys[own, d]))]
        upto = np.cumsum(w[own], dtype=np.float64)
        sought = upto[-1] * (m // 2) / m
        k = min(int(np.searchsorted(upto, sought)), own.size - 1)
        k += not sought - (upto[k] - w[own[k]]) < upto[k] - sought
        todo += [(own[:k], s, m // 2), (own[k:], s + m // 2, m - m // 2)]
    return shard


def kd_shards(meta: DataFrame, dims: list[str], weight: str, doc_id: str, shards: int | None = None, target: int | None = None, cell: int | None = None) -> DataFrame:
    """`meta` with shard, 0 to shards - 1 (or as many as leave about `target` of weight each), and slot, gapless from 0 in each shard.

    Weights must be positive. Rows may repeat, ids may be null or repeat: every row is one of its own. No rows: no result
    rows, and no error. meta is read twice, so it should be a written table."""
    cell = cell or CELL
    kept = [c for c in meta.columns if c not in ("shard", "slot")]
    spans = meta.agg(F.sum(weight).alias("w"), *[f(coordinate(meta, d)).alias(f"{n}{k}") for k, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if spans["w"] is None:
        return meta.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    m = shards or max(1, -(-spans["w"] // target))
    spread = F.shiftrightunsigned(F.xxhash64(doc_id, weight, *dims), 32)
    keys = []
    for k, d in enumerate(dims):
        lo, wide = spans[f"lo{k}"], spans[f"hi{k}"] - spans[f"lo{k}"]
        keys.append(F.shiftleft(F.floor((coordinate(meta, d) - F.lit(lo)) / F.lit(wide or 1.0) * F.lit(float(TOP))).cast("long"), 32).bitwiseOR(spread))
    rows = meta.select(F.lit(1).cast("long").alias("node"), F.monotonically_increasing_id().alias("row"), F.col(weight).cast("long").alias("w"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("order"), F.array(*keys).alias("keys"), F.struct(*kept).alias("rest"))
    rows = written(rows, "kd_rows")
    # nodes are numbered as in a heap; shards first to first + m - 1 come of each
    nodes = written(meta.sparkSession.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(0).alias("first"), F.lit(int(m)).alias("m")), "kd_nodes")
    closed, done = [], []  # nodes that need no cut, tables of their rows
    while True:
        at = [F.element_at("keys", k + 1) for k in range(len(dims))]
        sizes = rows.groupBy("node").agg(F.sum("w").alias("w"), F.count("*").alias("n"), *[f(x).alias(f"{n}{k}") for k, x in enumerate(at) for n, f in (("lo", F.min), ("hi", F.max))])
        wide = [F.shiftright(f"hi{k}", 32) - F.shiftright(f"lo{k}", 32) for k in range(len(dims))]
        most = F.greatest(*wide) if len(wide) > 1 else wide[0]
        d = F.coalesce(*[F.when(x == most, F.lit(k)) for k, x in enumerate(wide)])
        pick = lambda c: F.coalesce(*[F.when(F.col("d") == k, F.col(f"{c}{k}")) for k in range(len(dims))])
        sizes = sizes.join(nodes, "node").withColumn("d", d).select("node", "first", "m", "n", "d", pick("lo").alias("lo"), pick("hi").alias("hi"), F.when(F.col("m") > 1, F.col("w") * F.floor(F.col("m") / 2) / F.col("m")).otherwise(F.col("n") / 2).alias("sought"))
        sizes = written(sizes, "kd_sizes")
        dropped(nodes)
        end, big = sizes.where(F.col("n") <= cell), sizes.where(F.col("n") > cell)
        closed.append(end.select("node", "first", "m", "n"))
        if big.isEmpty():
            done.append(rows)
            break
        if not end.isEmpty():
            done.append(written(rows.join(end.select("node"), "node", "left_semi"), "kd_done"))
        cut = cuts(rows, big, cell)
        x = F.element_at("keys", F.col("d") + 1)
        right = (x > F.col("key")) | ((x == F.col("key")) & (F.col("row") >= F.col("cut_row")))
        both = big.select("node", "d").join(cut, "node")
        after = written(rows.join(both, "node").withColumn("node", F.col("node") * 2 + right.cast("long")).select(*rows.columns), "kd_rows")
        dropped(rows)
        dropped(cut)
        rows = after
        half = F.when(F.col("m") > 1, F.floor(F.col("m") / 2)).otherwise(F.lit(1)).cast("int")
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("first"), half.alias("m")), F.struct((F.col("node") * 2 + 1).alias("node"), F.when(F.col("m") > 1, F.col("first") + half).otherwise(F.col("first")).alias("first"), F.when(F.col("m") > 1, F.col("m") - half).otherwise(F.lit(1)).alias("m")))
        nodes = written(big.select(F.explode(children).alias("x")).select("x.*"), "kd_nodes")
    ended = closed[0]
    for x in closed[1:]:
        ended = ended.unionByName(x)
    # cells of one shard are numbered one after another; there are as many as its rows over `cell`
    base = F.sum("n").over(Window.partitionBy("first", "m").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ended = ended.withColumn("base", F.when(F.col("m") == 1, base).otherwise(F.lit(0)).cast("long"))
    schema = meta.select(*kept).schema

    def finish(group: pa.Table) -> pa.Table:
        keys = group.column("keys").combine_chunks()
        keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        row, w, order = (group.column(c).to_numpy() for c in ("row", "w", "order"))
        first, m, base = (group.column(c)[0].as_py() for c in ("first", "m", "base"))
        shard = subtree(keys, row, w, first, m)
        by = np.lexsort((row, keys[:, 0] & 0xFFFFFFFF, order, shard))
        at = np.arange(by.size) - np.searchsorted(shard[by], shard[by]) + base
        slot = np.empty(by.size, np.int64)
        slot[by] = at
        rest = group.column("rest").combine_chunks()
        rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
        return pa.table([*rest.flatten(), pa.array(shard), pa.array(slot)], [*kept, "shard", "slot"])

    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    asked = rows.join(ended.select("node", "first", "m", "base"), "node")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", shard int, slot long"
    return asked.groupBy("node").applyInArrow(finish, ddl)


def sharded(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("n_chars", "source", "lang"), target: int | None = None, cell: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of all documents in `shards` shards of nearly equal bytes, or as many as leave `target` bytes each.

    size: UTF-8 bytes of the text plus 16, so an empty or null text weighs too. law is bytes: each cut is the nearest
    the rows allow, so shards differ by no more than a few documents. Cuts fall on `dims` alone, so that a shard holds
    neighbours in metadata; where a node's rows agree in all of them, and for a cut within one value, a hash of the row
    decides (without any of `dims`, ids are what is cut). Null metadata sorts lowest; rows with null or repeated ids are
    rows of their own, and which of the rows that are alike gets which slot isn't fixed. The texts are read once; all passes go over a written table of ids, sizes and
    metadata."""
    text = F.col("text").cast("string").cast("binary")
    held = [d for d in dims if d in docs.columns]
    meta = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).cast("long").alias("text_crc32"), *held)
    meta = written(meta, "meta")
    out = kd_shards(meta, held or ["doc_id"], "size", "doc_id", shards=None if target else shards, target=target, cell=cell)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
