"""Maximum inner product search over anisotropically quantised vectors.

Vectors are cut into subspaces of SUB dimensions with 16 codewords each (four bits). Codes and codebooks minimise a
score-aware loss: the part of the residual along the vector, which changes its large inner products, weighs ETA times
the part across it. Codes are chosen by coordinate descent, codebooks by the normal equations of the same loss, fitted
to a sample of FIT vectors; every vector is then encoded and searched.

Each length of vectors has codebooks of its own, fitted by one task. Codebooks go to the tasks once, as a broadcast, up
to BOOKS bytes of them (128 a dimension); only beyond are they joined to the vectors by length. Vectors are encoded once,
into a written table.

Vectors move once, to cells that tasks hold, each with a row of the codebooks it needs; queries stream past the cells.
A search scans the tables of a query (16 partial products for each subspace, two subspaces to a byte) over the codes
of a block of vectors and ranks the RERANK best of the block by their exact inner products. A product exceeds the scanned
one by |query| times the distance of the vector from its codewords at most, so vectors that may be among the nearest by
this bound are ranked exactly, too: none is missed, however badly codes fit the vectors. Equal vectors are one entry with
the k + 1 least ids, which is all that ties can need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .op03_hamming import least_ids
from .vectors import flat, lists, picked, streamed

#: Dimensions of a subspace, sample that codebooks are fitted to, weight of the parallel residual, rounds.
SUB, FIT, ETA, ROUNDS = 2, 4096, 4.0, 6
#: Subspaces whose codewords are solved for at once.
TOGETHER = 32
#: Vectors of a block; queries that scan it at once; candidates of a block that are ranked exactly.
BLOCK, QUERIES, RERANK = 1 << 15, 64, 256
#: Vectors whose products are taken at once where codes can't tell.
CHECKED = 1 << 12
#: Bytes of codebooks that are broadcast.
BOOKS = 32 << 20


def encode(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (rows, subspaces) of vectors, by coordinate descent on |r|^2 + (ETA - 1) (r . x / |x|)^2."""
    n, subs = len(x), len(books)
    parts = x.reshape(n, subs, SUB)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    rest = parts[:, :, None, :] - books[None]
    across, along = (rest**2).sum(-1), (rest * unit[:, :, None, :]).sum(-1)
    codes = across.argmin(-1)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for s in range(subs):
            others = total - along[rows, s, codes[:, s]]
            best = (across[:, s] + (ETA - 1) * (others[:, None] + along[:, s]) ** 2).argmin(-1)
            total = others + along[rows, s, best]
            codes[:, s] = best
    return codes


def fit(x: np.ndarray) -> np.ndarray:
    """Codebooks (subspaces, 16, SUB) for the rows of x; the dimensions are filled up to whole subspaces."""
    n, dims = x.shape
    subs = dims // SUB
    rng = np.random.default_rng(0)
    parts = x.reshape(n, subs, SUB)
    books = np.stack([parts[rng.choice(n, 16, replace=n < 16), s] for s in range(subs)]).astype(np.float64)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for _ in range(ROUNDS):
        codes = encode(x, books)
        # sum over rows of B^T (I + (ETA - 1) u u^T) B c = B^T (I + (ETA - 1) u u^T) x, where B picks a row's codewords;
        # solved for TOGETHER subspaces at a time, the others as they are
        word = books[np.arange(subs), codes]
        along = (word.reshape(n, -1) * unit).reshape(n, subs, SUB).sum(-1)
        whole = (x * unit).sum(1)
        for s in range(0, subs, TOGETHER):
            e = min(s + TOGETHER, subs)
            own, wide = slice(s * SUB, e * SUB), (e - s) * 16 * SUB
            place = ((np.arange(e - s) * 16 + codes[:, s:e])[:, :, None] * SUB + np.arange(SUB)).reshape(n, -1)
            picked = np.zeros((n, wide), np.float32)
            np.put_along_axis(picked, place, unit[:, own].astype(np.float32), 1)
            left = (ETA - 1) * (picked.T @ picked).astype(np.float64)
            left[np.arange(wide), np.arange(wide)] += np.bincount(place.ravel(), minlength=wide) + 1e-6
            rest = whole - along[:, :s].sum(1) - along[:, e:].sum(1)
            right = np.bincount(place.ravel(), weights=(x[:, own] + (ETA - 1) * unit[:, own] * rest[:, None]).ravel(), minlength=wide)
            right += 1e-6 * books[s:e].ravel()
            books[s:e] = np.linalg.solve(left, right).reshape(e - s, 16, SUB)
            along[:, s:e] = (books[np.arange(s, e), codes[:, s:e]] * unit[:, own].reshape(n, -1, SUB)).sum(-1)
    return books


def scan(codes: np.ndarray, books: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, vectors), by tables of pairs of codes."""
    subs = len(books)
    tables = np.einsum("skd,qsd->qsk", books, q.reshape(len(q), subs, SUB)).astype(np.float32)
    if subs % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), -1, 256)
    both = codes[:, 0::2].astype(np.intp) * 16 + codes[:, 1::2]
    out = np.zeros((len(q), len(codes)), np.float32)
    for s in range(both.shape[1]):
        out += pairs[:, s].take(both[:, s], axis=1)
    return out


def filled(a: np.ndarray) -> np.ndarray:
    """Rows with zeros up to whole subspaces."""
    return np.pad(a, ((0, 0), (0, -a.shape[1] % SUB)))


def power(top: float) -> float:
    """A power of two near it: what is divided by it has no squares, or products in 32 bits, that overflow."""
    return float(2.0 ** max(min(np.frexp(top)[1], 1000), -1000)) if 0 < top < np.inf else 1.0


class Cell:
    """The vectors that a task holds, and how far each is from its codewords."""

    def __init__(self, books: np.ndarray, x: np.ndarray, codes: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.unit = power(np.abs(books).max())
        self.books, self.x, self.codes, self.starts, self.ids = books / self.unit, x, codes, starts, ids
        self.reach, self.length = np.empty(len(x)), np.empty(len(x))
        with np.errstate(all="ignore"):
            for a in range(0, len(x), CHECKED):
                own = slice(a, a + CHECKED)
                rows = x[own] / self.unit
                rest = rows - self.books[np.arange(len(books)), codes[own]].reshape(len(rows), -1)[:, : x.shape[1]]
                self.length[own] = np.linalg.norm(rows, axis=1)
                self.reach[own] = np.linalg.norm(rest, axis=1) + self.length[own] * x.shape[1] * 2.0**-50

    def ranked(self, best: tuple, q: np.ndarray, own: np.ndarray, k: int) -> tuple:
        """The k best rows (ids, scores, whether the vector is the query's) of those found so far and of the vectors `own`."""
        exact, same = (self.x[own] * q).sum(axis=1), (self.x[own] == q).all(axis=1)
        of, found = picked(self.starts, self.ids, own)
        every = [np.concatenate(both) for both in zip(best, (found, exact[of], same[of]))]
        order = np.lexsort((every[0], -every[1]))[:k]
        return tuple(c[order] for c in every)

    def nearest(self, q: np.ndarray, k: int) -> list[tuple]:
        """ranked() of all vectors, for each row of q. Comparisons are such that what is not a number is ranked exactly."""
        best: list[tuple] = [(np.empty(0, np.int64), np.empty(0), np.empty(0, bool))] * len(q)
        dims, units = q.shape[1], np.array([power(top) for top in np.abs(q).max(axis=1)])
        small = q / units[:, None]
        length = np.linalg.norm(small, axis=1)
        # 32-bit sums of tables are as exact as this
        slack = np.abs(np.einsum("skd,qsd->qsk", self.books, filled(small).reshape(len(q), -1, SUB))).max(axis=2).sum(axis=1) * (len(self.books) + 8) * 2.0**-22 + 1e-30
        for first in range(0, len(self.x), BLOCK):
            block = slice(first, first + BLOCK)
            rough = scan(self.codes[block], self.books, filled(small))
            n = rough.shape[1]
            lead = np.argpartition(-rough, RERANK - 1, axis=1)[:, :RERANK] if RERANK < n else np.broadcast_to(np.arange(n), rough.shape)
            best = [self.ranked(b, q[i], first + lead[i], k) for i, b in enumerate(best)]
            if RERANK >= n:
                continue
            least = np.array([b[1][-1] if b[1].size == k else -np.inf for b in best])
            known = (np.abs(least) > 1e-290) & (np.abs(least) < np.inf)  # else products may have underflown or overflown
            floor = np.where(known, least / self.unit / units, -np.inf)
            may = ~(rough + length[:, None] * self.reach[block] + slack[:, None] < floor[:, None])
            np.put_along_axis(may, lead, False, 1)
            some = first + np.flatnonzero(may.any(axis=0))
            for a in range(0, len(some), CHECKED):
                own = some[a : a + CHECKED]
                product = (small @ (self.x[own] / self.unit).T) + length[:, None] * self.length[own] * dims * 2.0**-50 + 1e-300
                ok = may[:, own - first] & ~(product < floor[:, None])
                for i in np.flatnonzero(ok.any(axis=1)):
                    best[i] = self.ranked(best[i], q[i], own[ok[i]], k)
        return best


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, body: the components as doubles) of vectors that take part: not null, not empty, not all zero, all components finite. Rows with a null id take no part either; ids may repeat."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    big = F.lit(float("inf"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big)) & F.exists("v", lambda x: x != 0))

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            ends = v.offsets.to_numpy()
            x = v.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([(x[a:b] + 0.0).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["id", "body"])

    return rows.mapInArrow(run, "id long, body binary")


def nearest_products(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k largest inner products of each query among all rows but its own.

    Both are tables of usable(), queries some of the rows of vectors. Scores are exact, in double precision; ties go to
    smaller ids. Vectors are compared with those of their own length. With k candidates or fewer, all are found. Other
    rows with the query's id or its vector are candidates; each query row gets results of its own."""
    size = F.octet_length("body")
    distinct = written(least_ids(vectors, "body", k + 1).withColumn("dims", size), "vectors")
    first = F.row_number().over(Window.partitionBy("dims").orderBy(F.xxhash64("body", F.lit(1)), "body"))
    sample = distinct.select("dims", "body").withColumn("_r", first).where(F.col("_r") <= FIT)  # ranks are limited before the shuffle

    def learn(group: pa.Table) -> pa.Table:
        bodies = [b for _, b in sorted(zip(group.column("_r").to_pylist(), group.column("body").to_pylist()))]
        x = filled(np.frombuffer(b"".join(bodies), np.float64).reshape(len(bodies), -1))
        return pa.table({"dims": group.column("dims").slice(0, 1), "book": pa.array([fit(x).tobytes()], pa.binary())})

    books = written(sample.groupBy("dims").applyInArrow(learn, "dims int, book binary"), "books")

    sent = (books.agg(F.sum(F.octet_length("book").cast("long"))).first()[0] or 0) <= BOOKS
    told = vectors.sparkSession.sparkContext.broadcast({r["dims"]: bytes(r["book"]) for r in books.toLocalIterator()} if sent else None)
    with_books = lambda df: df.withColumn("book", F.lit(None).cast("binary")) if sent else df.join(books, "dims")

    def code(batches):
        for batch in batches:
            dims, raw, book = (batch.column(c).to_pylist() for c in ("dims", "body", "book"))
            book = [told.value[d] for d in dims] if sent else book
            codes: list = [b""] * batch.num_rows
            for d in set(dims):
                own = [i for i, x in enumerate(dims) if x == d]
                found = encode(filled(np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), -1)), np.frombuffer(book[own[0]], np.float64).reshape(-1, 16, SUB)).astype(np.uint8)
                for i, c in zip(own, found):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("dims"), batch.column("body"), batch.column("ids"), pa.array(codes, pa.binary())], ["dims", "body", "ids", "code"])

    coded = written(with_books(distinct).select("dims", "body", "ids", "book").mapInArrow(code, "dims int, body binary, ids array<long>, code binary"), "codes")
    dropped(distinct)
    asked = written(queries.select("body").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")  # a number for each vector that is asked for
    n_bytes = coded.agg(F.sum(F.octet_length("body") + F.octet_length("code") + 8 * F.size("ids"))).first()[0] or 0
    none = lambda kind: F.lit(None).cast(kind)
    data = coded.select(F.col("dims").alias("kind"), "body", "ids", "code").unionByName(books.select(F.col("dims").alias("kind"), none("binary").alias("body"), none("array<long>").alias("ids"), F.col("book").alias("code")))

    def hold(table: pa.Table):
        """The codebook comes first, then the cell's vectors by body."""
        book = np.frombuffer(table.column("code")[0].as_py(), np.float64).reshape(-1, 16, SUB)
        table = table.slice(1)
        if not table.num_rows:
            return None
        n = table.num_rows
        return Cell(book, flat(table.column("body"), np.float64).reshape(n, -1), flat(table.column("code"), np.uint8).reshape(n, -1), *lists(table.column("ids")))

    def answer(held: Cell, batch: pa.RecordBatch):
        table = pa.Table.from_batches([batch])
        q, asked_for = table.column("q").to_numpy(), flat(table.column("body"), np.float64).reshape(table.num_rows, -1)
        for at in range(0, len(q), QUERIES):
            with np.errstate(all="ignore"):
                best = held.nearest(asked_for[at : at + QUERIES], k + 1)
            rows = [np.repeat(q[at : at + QUERIES], [b[0].size for b in best]), *map(np.concatenate, zip(*best))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["q", "id", "score", "same"])

    found = streamed(data, asked.select(size.alias("kind"), "q", "body"), n_bytes, hold, answer, "q long, id long, score double, same boolean")
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = found.withColumn("r", order).where(F.col("r") <= k + 1)
    # rows with equal ids and vectors are asked once; of the answers with their id and vector one is the row itself
    own = queries.groupBy(F.col("id").alias("query_id"), "body").agg(F.count("*").cast("int").alias("times")).join(asked, "body").select("query_id", "times", "q")
    near = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "id", F.desc("own"))
    mine = own.join(best, "q").withColumn("own", F.col("same") & (F.col("id") == F.col("query_id")))
    mine = mine.withColumns({"met": F.sum(F.col("own").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)), "r": F.row_number().over(near)})
    mine = mine.where(~(F.col("own") & (F.col("met") == 1))).withColumn("rank", (F.col("r") - F.least("met", F.lit(1))).cast("int")).where(F.col("rank") <= k)
    return mine.select("query_id", "rank", F.col("id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).drop("_time")
