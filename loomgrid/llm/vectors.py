"""What the operators on vectors share: vectors as whole numbers, where results must not depend on the order of sums, and queries streamed past cells of data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers of a vector lie below this, on both sides.
BOUND = 2**31
#: Bytes of data that a task holds while queries stream past them.
CELL_BYTES = 128 << 20


def integers(vectors: DataFrame, scale: int, vector: str = "embedding", **others: Column) -> DataFrame:
    """(others, x): floor(scale * component) of each vector, as 32-bit numbers, by native functions.

    Vectors that are null or hold a null, a NaN or an infinity are left out, and so are those with a component whose
    number doesn't fit into 32 bits: no vector of an embedding comes near to that. An empty vector stays, without numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(*[c.alias(k) for k, c in others.items()], v.alias("v")).where(F.col("v").isNotNull())
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= BOUND - 1)
    return rows.where(~F.exists("v", bad)).select(*others, F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows as int64) of each length of vectors in a batch's column."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[ends[at][:, None] + np.arange(d)].astype(np.int64).reshape(len(at), d)


def exact(*largest: int) -> type:
    """int64 where all these sizes fit, else Python's own numbers."""
    return np.int64 if max(largest, default=0) < 2**63 else object


def flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The bytes of a binary column, one value after the other, as numbers of `kind`."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(starts with the end, values) of a column of lists of longs."""
    sizes = pa.compute.list_value_length(column).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pa.compute.list_flatten(column).to_numpy()


def picked(starts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in rows, value) of all values of these rows of lists()."""
    n = starts[rows + 1] - starts[rows]
    return np.repeat(np.arange(rows.size), n), values[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def streamed(data: DataFrame, asked: DataFrame, n_bytes: int, hold: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What answer() says of each query beside each cell of data.

    data: kind (int), body (binary) and others; asked: kind, q (long, not null), body. Data move once: they are dealt to
    cells of about CELL_BYTES by the hash of their body, a task for each; a row without a body goes to all cells. Queries
    are the side that is copied, once for each cell. They come after the cell's data, batch by batch, so a task holds
    a cell and one batch of queries however many there are. Only where there are fewer cells than slots are cells copied,
    so that each slot has a share of the queries. Queries meet data of their own kind: hold(all data of a kind in the
    cell, by body) makes what answer(it, a batch of queries) gets."""
    cells = int(n_bytes // CELL_BYTES) + 1
    slices = -(-data.sparkSession.sparkContext.defaultParallelism // cells)
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("body"), F.lit(n)).cast("int")
    own = data.withColumn("_c", F.explode(F.when(F.col("body").isNull(), every(cells)).otherwise(F.array(dealt(cells))))).withColumn("_s", F.explode(every(slices)))
    ask = asked.withColumn("_c", F.explode(every(cells))).withColumn("_s", dealt(slices))
    both = own.withColumn("q", F.lit(None).cast("long")).unionByName(ask, allowMissingColumns=True).withColumn("_cell", F.col("_c") * slices + F.col("_s")).drop("_c", "_s")

    def run(batches):
        kind, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, is_q = batch.column("kind").to_numpy(), batch.column("q").is_valid().to_numpy(zero_copy_only=False)
            turns = (np.flatnonzero((kinds[1:] != kinds[:-1]) | (is_q[1:] != is_q[:-1])) + 1).tolist()
            for a, b in zip([0, *turns], [*turns, batch.num_rows]):
                if kinds[a] != kind:
                    kind, held, index = kinds[a], [], None
                if not is_q[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    index, held = hold(pa.Table.from_batches(held)), []
                if index is not None:
                    yield from answer(index, batch.slice(a, b - a))

    # nulls sort first: a kind's rows without a body, then its other data, then its queries
    return both.repartitionById(cells * slices, "_cell").sortWithinPartitions("kind", "q", "body").mapInArrow(run, schema)
