"""Product codes of vectors by integer codebooks that are learned exactly.

Components are whole numbers, floor(SCALE * component). A vector is cut into PARTS equal consecutive parts, and each part
position has a codebook of at most ENTRIES entries. A round broadcasts the codebooks; tasks assign every part to its
nearest entry (distances of a batch by norm expansion, |x|^2 - 2 x.c + |c|^2, with exact int64 products; the first of the
least) and send each entry's count and sums once; a grouped shuffle adds them up, and floor(sum / count) is the next
codebook. All sums are of whole numbers, so codebooks, codes and errors are the same however rows are divided or retried.

The numbers are written once and read each round. What a round shuffles and brings to the driver is one codebook for
each task, however many rows there are.

Vectors of each length have codebooks of their own; where a length is no multiple of PARTS, zeros fill it up. Null ids
rank last and equal ids by their vectors when the first entries are chosen; equal rows give equal results. Vectors that
vectors.integers() leaves out give no row. No rows: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import least_parts, spread_join, written
from .vectors import by_length, exact, integers

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances are held at once; bytes of sums that a task holds before it sends them.
TOGETHER, HELD = 2048, 64 << 20

Books = dict[int, np.ndarray]


def parted(x: np.ndarray) -> np.ndarray:
    """(rows, PARTS, width)."""
    n, d = x.shape
    width = -(-d // PARTS)
    return np.pad(x, ((0, 0), (0, width * PARTS - d))).reshape(n, PARTS, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row: the first of the nearest."""
    most = int(max(abs(x).max(initial=0), abs(book).max(initial=0)))
    kind = exact(4 * max(1, x.shape[1]) * most * most)
    x, book = x.astype(kind), book.astype(kind)
    norms = (book * book).sum(1)
    entry, least = np.zeros(len(x), np.int64), np.zeros(len(x), kind)
    for a in range(0, len(x), TOGETHER):
        part = x[a : a + TOGETHER]
        far = norms - 2 * (part @ book.T)  # |x|^2 changes nothing in what is nearest
        best = far.argmin(1)
        entry[a : a + TOGETHER] = best
        least[a : a + TOGETHER] = far[np.arange(len(part)), best] + (part * part).sum(1)
    return entry, least


def first_books(rows: DataFrame) -> Books:
    """The parts of the ENTRIES smallest ids of each length: found among those of each of some groups of rows."""
    order = [F.asc_nulls_last("id"), F.col("x")]
    some = rows.select("id", "x", F.size("x").alias("dims"), F.pmod(F.xxhash64("x"), F.lit(64)).alias("group"))
    for keys in (["dims", "group"], ["dims"]):  # ranks are limited before each shuffle
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= ENTRIES)
    books: dict[int, list] = {}
    for r in some.select("dims", "rank", "x").orderBy("dims", "rank").toLocalIterator():
        books.setdefault(r["dims"], []).append(r["x"])
    return {d: parted(np.array(x, np.int64).reshape(len(x), d)).swapaxes(0, 1) for d, x in books.items()}


def summed(rows: DataFrame, books: Books) -> DataFrame:
    """(dims, part, entry, n, sums): how many parts of all rows are nearest to an entry, and their sums."""
    told = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def out():
            for d, (counts, sums) in held.items():
                p, e = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), d, np.int32)), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["dims", "part", "entry", "n", "sums"])

        for batch in batches:
            for d, _, x in by_length(batch.column("x")):
                if d not in held:
                    book = told.value[d]
                    if size + book.nbytes > HELD and held:
                        yield from out()
                        held, size = {}, 0
                    held[d] = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
                    size += book.nbytes
                counts, sums = held[d]
                for p, part in enumerate(parted(x).swapaxes(0, 1)):
                    entry, _ = nearest(part, told.value[d][p])
                    counts[p] += np.bincount(entry, minlength=counts.shape[1])
                    order = np.argsort(entry, kind="stable")
                    has, at = np.unique(entry[order], return_index=True)
                    sums[p, has] += np.add.reduceat(part[order], at, axis=0)
        yield from out()

    sent = rows.select("x").mapInArrow(run, "dims int, part int, entry int, n long, sums array<long>")
    cells = sent.select("dims", "part", "entry", "n", F.posexplode("sums").alias("k", "v"))
    return cells.groupBy("dims", "part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def learned(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    """Codebooks (PARTS, entries, width) by length of vectors, from a written table with the columns id and x."""
    books = first_books(rows)
    for _ in range(rounds if books else 0):
        got = summed(rows, books).toArrow()
        d, p, e, k, n, v = (got.column(c).to_numpy() for c in ("dims", "part", "entry", "k", "n", "v"))
        new = {x: b.copy() for x, b in books.items()}
        for x, b in new.items():
            own = d == x
            b[p[own], e[own], k[own]] = v[own] // n[own]  # floors, of what lies below 0 too
        books = new
    return books


def sha256(book: np.ndarray) -> str:
    """Of the components of all entries, in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): see the module. Null labels are a label of their own."""
    spark = vectors.sparkSession
    mark = F.coalesce(F.concat(F.lit("="), F.col(f"`{label}`").cast("string")), F.lit(""))
    rows = written(integers(vectors, SCALE, vector, id=F.col(f"`{vec_id}`").cast("long"), mark=mark), "integers")
    books = learned(rows)
    told = spark.sparkContext.broadcast((books, {d: sha256(b) for d, b in books.items()}))

    def code(batches):
        for batch in batches:
            found, shas = told.value
            codes, errors, sha = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, object), np.full(batch.num_rows, "", object)
            for d, at, x in by_length(batch.column("x")):
                both = [nearest(part, book) for part, book in zip(parted(x).swapaxes(0, 1), found[d])]
                codes[at] = [row.tobytes().hex() for row in np.stack([e for e, _ in both], 1).astype(np.uint8)]
                errors[at] = sum(far.astype(object) for _, far in both)
                sha[at] = shas[d]
            whole = pa.array([e if e < 2**63 else None for e in errors.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(codes, pa.string()), whole, pa.array(sha, pa.string())], ["vec_id", "mark", "code", "error", "codebooks_sha256"])

    out = written(rows.mapInArrow(code, "vec_id long, mark string, code string, error long, codebooks_sha256 string"), "codes")
    sums = written(out.groupBy("mark").agg(F.count("*").alias("_n"), F.sum("error").alias("label_error")).coalesce(least_parts(spark)), "labels")
    return spread_join(out, sums, "mark", out.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
