"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments, and a block of codes is indexed by the value of each. A query looks up, segment after
segment, all values at radius 0, then 1, and so on. When radius r is done for the first a segments, every code within
distance m * r + a - 1 (m segments) has been met, so a query is done when its k-th verified distance is no more than
that. A code met by several segments is counted where it is met first, which its distances in the segments tell.

Equal codes are one entry of the index with their k least ids, which is all that ties can need. Codes move once, to
cells that tasks hold as indexes of BLOCK codes each, and queries stream past them; a query's answers of all cells are
merged, k at most from each.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import flat, lists, picked, streamed

#: Codes in an index, queries searched at once, and pairs that are verified at once.
BLOCK, QUERIES, PAIRS = 1 << 17, 2048, 1 << 21


@lru_cache(None)
def flips(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with `radius` of them set."""
    return np.array([sum(1 << b for b in x) for x in combinations(range(width), radius)], np.uint64)


class MultiIndex:
    """Distinct codes (rows of 64-bit words) with a weight each: how many ids an entry stands for."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.codes, self.weights = codes, weights
        self.width = 16 if len(codes) >= 1 << 13 else 8
        each = 64 // self.width
        self.segments = [(w, s * self.width) for w in range(codes.shape[1]) for s in range(each)]
        self.mask = np.uint64((1 << self.width) - 1)
        self.tables = []
        for w, shift in self.segments:
            value = (codes[:, w] >> np.uint64(shift)) & self.mask
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << self.width) + 1, dtype=np.uint64))))

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of entries that stand for the k nearest ids of each query, and any as near as the k-th."""
        m, bits = len(self.segments), 64 * self.codes.shape[1]
        counts = np.zeros((len(queries), bits + 1), np.int64)
        met = np.zeros(len(queries), np.int64)
        live = np.arange(len(queries))
        found = []
        for radius in range(self.width + 1):
            probes = flips(self.width, radius)
            for a, (w, shift) in enumerate(self.segments):
                if not live.size:
                    break
                order, bounds = self.tables[a]
                step = max(1, PAIRS // max(1, int(probes.size * max(1, len(order) >> self.width))))
                for at in range(0, live.size, step):
                    q = live[at : at + step]
                    value = (((queries[q, w] >> np.uint64(shift)) & self.mask)[:, None] ^ probes).astype(np.int64)
                    lo, n = bounds[value].ravel(), (bounds[value + 1] - bounds[value]).ravel()
                    who = np.repeat(np.repeat(q, probes.size), n)
                    entry = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                    differ = queries[who] ^ self.codes[entry]
                    new = np.ones(who.size, bool)
                    for b, (w2, shift2) in enumerate(self.segments):  # met before: at radius by an earlier segment, below it by a later one
                        if b != a and (radius or b < a):
                            d = np.bitwise_count((differ[:, w2] >> np.uint64(shift2)) & self.mask)
                            new &= d > radius if b < a else d >= radius
                    who, entry, d = who[new], entry[new], np.bitwise_count(differ[new]).sum(axis=1, dtype=np.int64)
                    np.add.at(counts, (who, d), self.weights[entry])
                    met += np.bincount(who, minlength=len(queries))
                    found.append((who, entry, d))
                covered = m * radius + a  # distances up to here are all met
                sums = np.cumsum(counts[live, : min(covered, bits) + 1], axis=1)[:, -1]
                live = live[(sums < k) & (met[live] < len(self.codes))]
        who, entry, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        kth = np.argmax(np.cumsum(counts, axis=1) >= k, axis=1)
        kth[counts.sum(axis=1) < k] = bits
        keep = d <= kth[who]
        return who[keep], entry[keep], d[keep]


def sign_codes(vectors: DataFrame, bits: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): a bit for each component, set where it is above 0 (not where it is null or NaN), as bits / 64 little-endian words. Vectors that are null or of another length, and those with a null id, take no part; ids may repeat."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, bits)
            code = np.packbits(x > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "code"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == bits) & F.col("id").isNotNull())
    return rows.mapInArrow(run, "id long, code binary")


def least_ids(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, ids: its k least ids, in order). Ranks are limited before the shuffle, so a key with very many rows is no burden."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def hamming_neighbours(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank from 1, vec_id, distance): the k nearest of all rows of codes (id, code), a query's own among them; ties to smaller ids. Repeated ids are rows of their own. With fewer rows than k, all of them."""
    distinct = written(least_ids(codes, "code", k), "codes")
    asked = queries.groupBy("code").agg(F.min("id").alias("q"))  # equal queries are searched once
    kind = F.octet_length("code").alias("kind")
    n_bytes = distinct.agg(F.sum(F.octet_length("code") + 8 * F.size("ids"))).first()[0] or 0

    def hold(table: pa.Table):
        words = flat(table.column("body"), np.dtype("<u8")).reshape(table.num_rows, -1)
        starts, ids = lists(table.column("ids"))
        return [(at, MultiIndex(words[at : at + BLOCK], np.diff(starts[at : at + BLOCK + 1]))) for at in range(0, len(words), BLOCK)], starts, ids

    def answer(held, batch: pa.RecordBatch):
        indexes, starts, ids = held
        table = pa.Table.from_batches([batch])
        q, words = table.column("q").to_numpy(), flat(table.column("body"), np.dtype("<u8")).reshape(table.num_rows, -1)
        for first in range(0, len(q), QUERIES):
            part = words[first : first + QUERIES]
            near = [(who, entry + at, d) for at, index in indexes for who, entry, d in [index.nearest(part, k)]]
            who, entry, d = (np.concatenate(x) for x in zip(*near))
            at, found = picked(starts, ids, entry)
            who, d = who[at], d[at]
            order = np.lexsort((found, d, who))
            place = np.arange(order.size) - np.searchsorted(who[order], who[order])  # of each row among its query's
            best = order[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(q[first + who[best]], pa.int64()), pa.array(found[best], pa.int64()), pa.array(d[best], pa.int32())], ["q", "id", "distance"])

    found = streamed(distinct.select(kind, F.col("code").alias("body"), "ids"), asked.select(kind, "q", F.col("code").alias("body")), n_bytes, hold, answer, "q long, id long, distance int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    own = queries.select(F.col("id").alias("query_id"), "code").join(asked, "code").select("query_id", "q")
    return own.join(best, "q").select("query_id", "rank", F.col("id").alias("vec_id"), "distance")
