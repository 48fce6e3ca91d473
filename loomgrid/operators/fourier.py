"""The discrete Fourier transform along the rows of an array that no task could hold a column of.

With n = p * q rows, row i = a * q + b and result k = c + p * d:

    X[c + p d] = sum over b of  e(b c / n) * (sum over a of x[a q + b] e(a c / p)) * e(b d / q)        e(t) = exp(-2 pi i t)

So rows are dealt by b, each group of p rows is transformed and turned by its e(b c / n), and what comes out is dealt by c
into groups of q rows, which are transformed again: two shuffles of whole rows, and groups of about the root of n rows.
Where n has no two such factors (a large prime, say), the transform is a convolution with a chirp, done by transforms
whose length is a power of two. Groups are transformed by numpy; e is taken of whole numbers modulo the length, so angles
are exact however large n is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a group, at most, before the chirp is used instead; a row's cells come on top.
MOST = 1 << 12
ROWS = "i long, body binary"


def factors(n: int) -> tuple[int, int]:
    """(p, q), p * q = n, as near to each other as they can be."""
    p = next(p for p in range(math.isqrt(n), 0, -1) if n % p == 0)
    return p, n // p


def turns(k: np.ndarray, n: int, sign: int = -1) -> np.ndarray:
    """exp(sign * 2 pi i k / n) of whole numbers k."""
    return np.exp(sign * 2j * np.pi * (k % n) / n)


def _rows(i, z: np.ndarray) -> pa.Table:
    return pa.table({"i": pa.array(np.asarray(i, np.int64)), "body": pa.array([row.tobytes() for row in np.ascontiguousarray(z, np.complex128)], pa.binary())})


def _dense(at: np.ndarray, bodies: list[bytes], n: int) -> np.ndarray:
    """Rows at their places, others 0."""
    own = np.frombuffer(b"".join(bodies), np.complex128).reshape(len(bodies), -1)
    out = np.zeros((n, own.shape[1]), np.complex128)
    out[at] = own
    return out


def transformed(rows: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """ROWS of the transform of n rows (i from 0 to n - 1, body: complex cells); rows that are missing are 0."""
    p, q = factors(n)
    f, sign = (np.fft.ifft, 1) if inverse else (np.fft.fft, -1)

    def first(group: pa.Table) -> pa.Table:
        i = group.column("i").to_numpy()
        b, c = int(i[0]) % q, np.arange(p)
        z = f(_dense(i // q, group.column("body").to_pylist(), p), axis=0)
        return _rows(c * q + b, z * turns(b * c, n, sign)[:, None])

    def second(group: pa.Table) -> pa.Table:
        i = group.column("i").to_numpy()
        return _rows(int(i[0]) // q + p * np.arange(q), f(_dense(i % q, group.column("body").to_pylist(), q), axis=0))

    if p > 1:
        rows = rows.groupBy(F.pmod("i", F.lit(q)).alias("_g")).applyInArrow(first, ROWS)
    return rows.groupBy(F.expr(f"i div {q}").alias("_g")).applyInArrow(second, ROWS)


def scaled(rows: DataFrame, by) -> DataFrame:
    """Each row times by(i), a function of arrays of row numbers."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = np.frombuffer(b"".join(batch.column("body").to_pylist()), np.complex128).reshape(batch.num_rows, -1)
                yield from _rows(batch.column("i"), z * by(batch.column("i").to_numpy())[:, None]).to_batches()

    return rows.mapInArrow(run, ROWS)


def _chirped(spark: SparkSession, rows: DataFrame, n: int) -> DataFrame:
    size = 1 << (2 * n - 2).bit_length()
    chirp = lambda i, sign: turns((i % (2 * n)) ** 2, 2 * n, sign)

    def others(batches):
        for batch in batches:
            i = batch.column("id").to_numpy()
            j = np.where(i < n, i, np.where(i > size - n, size - i, -1))  # places -(n - 1) to n - 1, around
            yield from _rows(i, np.where(j >= 0, chirp(j, 1), 0)[:, None]).to_batches()

    a = transformed(scaled(rows, lambda i: chirp(i, -1)), size)
    b = transformed(spark.range(size).mapInArrow(others, ROWS), size)

    def times(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.complex128).reshape(batch.num_rows, -1) for c in ("body", "other"))
                yield from _rows(batch.column("i"), x * y).to_batches()

    both = a.join(b.withColumnRenamed("body", "other"), "i").select("i", "body", "other").mapInArrow(times, ROWS)
    return scaled(transformed(both, size, inverse=True).where(F.col("i") < n), lambda i: chirp(i, -1))


def fft_rows(vectors: DataFrame, row: str, vector: str, n: int, m: int, most: int = MOST) -> DataFrame:
    """(i, j, re, im): the transform along axis 0 of the n x m array whose row i is the vector of length m with row number i; rows without one are 0.

    No group has more than `most` rows where n allows it by its factors or by a chirp: roots of n, or of up to 4 n."""
    spark = vectors.sparkSession

    def start(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _rows(batch.column("i"), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)).to_batches()

    given = vectors.select(F.col(row).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    rows = given.where((F.size("v") == m) & F.col("i").between(0, n - 1)).mapInArrow(start, ROWS)
    out = transformed(rows, n) if n < 2 or factors(n)[1] <= most else _chirped(spark, rows, n)

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                z = np.frombuffer(b"".join(batch.column("body").to_pylist()), np.complex128)
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(np.repeat(np.arange(batch.num_rows), m))), pa.array(np.tile(np.arange(m), batch.num_rows)), pa.array(z.real), pa.array(z.imag)], ["i", "j", "re", "im"])

    return out.mapInArrow(cells, "i long, j long, re double, im double")
