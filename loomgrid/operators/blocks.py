"""Dense arrays in block form: (bi, bj, rows, cols, body), body the doubles of a block in row order. Blocks are handled by numpy on executors; Spark moves whole blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept_table

BLOCKS = "bi long, bj long, rows int, cols int, body binary"


def _array(body: bytes, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(body, np.float64).reshape(rows, cols)


def _table(rows: list[tuple]) -> pa.Table:
    bi, bj, n, m, body = zip(*rows) if rows else ((),) * 5
    return pa.table({"bi": pa.array(bi, pa.int64()), "bj": pa.array(bj, pa.int64()), "rows": pa.array(n, pa.int32()), "cols": pa.array(m, pa.int32()), "body": pa.array(body, pa.binary())})


def _block(bi: int, bj: int, x: np.ndarray) -> tuple:
    return bi, bj, x.shape[0], x.shape[1], np.ascontiguousarray(x, np.float64).tobytes()


def blocked(x: DataFrame, n: int, m: int, size: int) -> DataFrame:
    """Blocks of at most size x size of an n x m array in long form; cells that have no row are 0."""

    def make(group: pa.Table) -> pa.Table:
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        out = np.zeros((min(size, n - bi * size), min(size, m - bj * size)))
        out[group.column("i").to_numpy() - bi * size, group.column("j").to_numpy() - bj * size] = group.column("v").to_numpy()
        return _table([_block(bi, bj, out)])

    cells = x.select(F.expr(f"i div {size}").alias("bi"), F.expr(f"j div {size}").alias("bj"), "i", "j", "v")
    return cells.groupBy("bi", "bj").applyInArrow(make, BLOCKS)


def long_form(blocks: DataFrame, size: int) -> DataFrame:
    """(i, j, v) of blocks."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                i, j = np.indices((r["rows"], r["cols"]))
                yield pa.RecordBatch.from_arrays([pa.array((i + r["bi"] * size).ravel()), pa.array((j + r["bj"] * size).ravel()), pa.array(np.frombuffer(r["body"], np.float64))], ["i", "j", "v"])

    return blocks.mapInArrow(run, "i long, j long, v double")


def from_vectors(vectors: DataFrame, row: str, vector: str, m: int, size: int) -> DataFrame:
    """Blocks of at most size x size of the array whose row i is the vector of length m with row number i; rows without a vector of that length are 0. Whole vectors move, not cells."""

    def make(group: pa.Table) -> pa.Table:
        bi, i = group.column("bi")[0].as_py(), group.column("i").to_numpy()
        x = np.zeros((int(i.max()) - bi * size + 1, m))
        x[i - bi * size] = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
        return _table([_block(bi, bj, x[:, bj * size : (bj + 1) * size]) for bj in range(-(-m // size))])

    i = F.col(row).cast("long")
    rows = vectors.select(F.expr(f"`{row}` div {size}").cast("long").alias("bi"), i.alias("i"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == m) & F.col("i").isNotNull()).groupBy("bi").applyInArrow(make, BLOCKS)


def cells(ni: int, nj: int, nk: int, slots: int, most: int) -> tuple[int, int, int]:
    """Into how many parts each axis of a product's cube of blocks (rows, columns, inner) is cut: at least one cell for each slot where there are so many, at most `most` blocks of either side in a cell, and few copies.

    Each left block goes to as many cells as there are column parts, each right block to as many as there are row parts."""
    cut, have = [1, 1, 1], (ni, nj, nk)
    side = lambda n, c: -(-n // c)
    moved = lambda c: ni * nk * c[1] + nk * nj * c[0] + (ni * nj * c[2] if c[2] > 1 else 0)
    while True:
        held = max(side(have[0], cut[0]) * side(nk, cut[2]), side(nk, cut[2]) * side(have[1], cut[1]))
        further = [[min(h, c * 2) if k == axis else c for k, (c, h) in enumerate(zip(cut, have))] for axis in range(3) if cut[axis] < have[axis]]
        if not further or (cut[0] * cut[1] * cut[2] >= slots and held <= most):
            return cut[0], cut[1], cut[2]
        cut = min(further, key=moved)


def dot(x: DataFrame, y: DataFrame, slots: int | None = None, most: int = 256, axes: tuple[int, int, int] | None = None) -> DataFrame:
    """The product of two arrays in blocks of one size.

    The blocks' products form a cube of rows, columns and inner numbers, which is cut into cells: a task multiplies a cell,
    at most `most` blocks of either side, and adds up its inner numbers. So all slots have work however few inner blocks
    there are, and blocks are copied a bounded number of times. Partial products are added up only where the inner axis is cut.

    axes: numbers of blocks (rows, columns, inner), where they are known; else they are looked up first."""
    if axes is None:
        (ni, nk), (ky, nj) = ([r[0], r[1]] for r in (a.agg(F.max("bi"), F.max("bj")).first() for a in (x, y)))
        if ni is None or ky is None:
            return x.where("false")
        if nk != ky:
            raise ValueError(f"the inner numbers of blocks differ: {nk + 1} and {ky + 1}")
        axes = ni + 1, nj + 1, nk + 1
    gi, gj, gk = cells(*axes, slots or x.sparkSession.sparkContext.defaultParallelism, most)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    a = x.select(F.pmod("bi", F.lit(gi)).alias("gi"), copies(gj).alias("gj"), F.pmod("bj", F.lit(gk)).alias("gk"), F.lit(True).alias("left"), "*")
    b = y.select(copies(gi).alias("gi"), F.pmod("bj", F.lit(gj)).alias("gj"), F.pmod("bi", F.lit(gk)).alias("gk"), F.lit(False).alias("left"), "*")

    def multiply(batches):
        held: dict = {}  # a task may get several cells
        for batch in batches:
            for r in batch.to_pylist():
                left, right = held.setdefault(r["cell"], ({}, {}))
                if r["left"]:
                    left.setdefault(r["bj"], []).append((r["bi"], _array(r["body"], r["rows"], r["cols"])))
                else:
                    right.setdefault(r["bi"], []).append((r["bj"], _array(r["body"], r["rows"], r["cols"])))
        for left, right in held.values():
            out: dict = {}
            for k in left.keys() & right.keys():
                for i, p in left[k]:
                    for j, q in right[k]:
                        if (i, j) in out:
                            out[i, j] += p @ q
                        else:
                            out[i, j] = p @ q
            yield from _table([_block(i, j, v) for (i, j), v in out.items()]).to_batches()

    cell = ((F.col("gi") * gj + F.col("gj")) * gk + F.col("gk")).cast("int")
    both = a.unionByName(b).select(cell.alias("cell"), "left", "bi", "bj", "rows", "cols", "body")
    out = both.repartitionById(gi * gj * gk, "cell").mapInArrow(multiply, BLOCKS)
    return summed(out) if gk > 1 else out


def summed(blocks: DataFrame) -> DataFrame:
    """Blocks of one place added up."""

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        out = sum(_array(r["body"], r["rows"], r["cols"]) for r in rows)
        return _table([_block(rows[0]["bi"], rows[0]["bj"], out)])

    return blocks.groupBy("bi", "bj").applyInArrow(add, BLOCKS)


def transposed(x: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield from _table([_block(r["bj"], r["bi"], _array(r["body"], r["rows"], r["cols"]).T) for r in batch.to_pylist()]).to_batches()

    return x.mapInArrow(run, BLOCKS)


def transpose_sum(x: DataFrame) -> DataFrame:
    """(v): (x + x.T).sum()"""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(b, np.float64).sum()) for b in batch.column("body").to_pylist()], pa.float64())], ["v"])

    return summed(x.unionByName(transposed(x))).mapInArrow(run, "v double").agg(F.sum("v").alias("v"))


def gram(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    """(i, j, v) of x.T.dot(x), x the rows of vectors of length dims: each task adds up its own, dims * dims numbers leave it."""

    def run(batches):
        g = np.zeros((dims, dims))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            g += x.T @ x
        i, j = np.indices(g.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(g.ravel())], ["i", "j", "v"])

    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dims)
    return rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def triangles(vectors: DataFrame, vector: str, dims: int, fan_in: int = 8) -> DataFrame:
    """(r): the triangle R, dims x dims, of a QR factorisation of a tall array of rows of vectors; one row.

    Each task factors its rows; the triangles are factored together fan_in at a time until one is left."""

    def triangle(x: np.ndarray) -> bytes:
        return np.linalg.qr(x, mode="r").tobytes()

    def first(batches):
        held = np.zeros((0, dims))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            held = np.frombuffer(triangle(np.concatenate([held, x])), np.float64).reshape(-1, dims)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    def join(batches):
        parts = [np.frombuffer(b, np.float64).reshape(-1, dims) for batch in batches for b in batch.column("r").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([triangle(np.concatenate(parts))] if parts else [], pa.binary())], ["r"])

    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dims)
    parts = rows.rdd.getNumPartitions()
    r = rows.mapInArrow(first, "r binary")
    while parts > 1:
        parts = -(-parts // fan_in)
        r = r.repartitionById(parts, F.pmod(F.xxhash64("r"), F.lit(parts)).cast("int")).mapInArrow(join, "r binary")
    return r


def singular_values(vectors: DataFrame, vector: str, dims: int, fan_in: int = 8) -> DataFrame:
    """(k, s): singular values, largest first, of a tall array of rows of vectors: those of its triangle."""

    def last(batches):
        for batch in batches:
            for b in batch.column("r").to_pylist():
                s = np.linalg.svd(np.frombuffer(b, np.float64).reshape(-1, dims), compute_uv=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.size)), pa.array(s)], ["k", "s"])

    return triangles(vectors, vector, dims, fan_in).mapInArrow(last, "k long, s double")


NODES = "level int, node long, parent long, body binary"


@dataclass
class Svd:
    """x = U S V^T: rows of U as (i, u), singular values falling, V^T as (k, j, v)."""

    u: DataFrame
    s: np.ndarray
    vt: DataFrame


def svd(vectors: DataFrame, row: str, vector: str, dims: int, fan_in: int = 8, rows_each: int | None = None) -> Svd:
    """All three factors of a tall array whose rows are vectors of length dims.

    Rows are factored slice by slice, x = Q R, and the triangles in a tree, fan_in at a time; every step keeps its Q. The
    last triangle's factors (dims x dims, on the driver) go back down: each node multiplies its part of Q by what it gets,
    and at the leaves come rows of U. Nothing is divided by a singular value or a triangle, so U's columns are orthogonal
    to rounding however badly conditioned x is. With fewer rows than dims, U has as many columns as there are rows."""
    spark = vectors.sparkSession
    each = rows_each or 16 * dims
    rows = vectors.select(F.col(row).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dims)

    def leaves(batches):
        seq, ids, held = TaskContext.get().partitionId() << 32, [], []

        def out():
            nonlocal seq, ids, held
            q, r = np.linalg.qr(np.concatenate(held))
            done = pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([q.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary())], ["node", "ids", "q", "r"])
            seq, ids, held = seq + 1, [], []
            return done

        for batch in batches:
            x, i = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), batch.column("i").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(x):
                take = each - sum(map(len, held))
                held.append(x[at : at + take])
                ids.append(i[at : at + take])
                at += take
                if sum(map(len, held)) >= each:
                    yield out()
        if held and sum(map(len, held)):
            yield out()

    leaf = kept_table(rows.mapInArrow(leaves, "node long, ids array<long>, q binary, r binary"), "leaves")

    def merge(level: int):
        def run(group: pa.Table) -> pa.Table:
            got = sorted(zip(group.column("node").to_pylist(), group.column("r").to_pylist()))
            parts = [np.frombuffer(b).reshape(-1, dims) for _, b in got]
            q, r = np.linalg.qr(np.concatenate(parts))
            ends = np.cumsum([len(p) for p in parts])
            parent = group.column("parent")[0].as_py()
            nodes, bodies = [n for n, _ in got] + [parent], [b.tobytes() for b in np.split(q, ends[:-1])] + [r.tobytes()]
            return pa.table({"level": pa.array([level] * len(got) + [-1], pa.int32()), "node": pa.array(nodes, pa.int64()), "parent": pa.array([parent] * (len(got) + 1), pa.int64()), "body": pa.array(bodies, pa.binary())})

        return run

    # from slices to their tasks, then fan_in tasks at a time
    level, tree = 0, []
    tops = leaf.select("node", "r", F.expr("node div 4294967296").alias("parent"))
    while True:
        done = kept_table(tops.groupBy("parent").applyInArrow(merge(level), NODES), "nodes")
        tree.append(done.where(F.col("level") >= 0))
        last = done.where("level = -1")
        tops = last.select("node", F.col("body").alias("r"), F.expr(f"node div {fan_in}").alias("parent"))
        level += 1
        if (n := last.count()) <= 1:
            break
    if not n:
        return Svd(spark.createDataFrame([], "i long, u array<double>"), np.zeros(0), spark.createDataFrame([], "k long, j long, v double"))
    (top,) = last.collect()  # dims x dims
    u, s, vt = np.linalg.svd(np.frombuffer(top["body"]).reshape(-1, dims), full_matrices=False)
    down = spark.createDataFrame([(top["node"], bytearray(np.ascontiguousarray(u).tobytes()))], "parent long, m binary")
    wide = len(s)

    def passed(batches):
        for batch in batches:
            out = [(np.frombuffer(b).reshape(-1, np.frombuffer(m).size // wide) @ np.frombuffer(m).reshape(-1, wide)).tobytes() for b, m in zip(batch.column("body").to_pylist(), batch.column("m").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["parent", "m"])

    for step in reversed(tree):
        down = step.select("node", "parent", "body").join(down, "parent").select("node", "body", "m").mapInArrow(passed, "parent long, m binary")

    def finish(batches):
        for batch in batches:
            for ids, q, m in zip(batch.column("ids").to_pylist(), batch.column("q").to_pylist(), batch.column("m").to_pylist()):
                rows_ = np.frombuffer(q).reshape(len(ids), -1) @ np.frombuffer(m).reshape(-1, wide)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(rows_), pa.list_(pa.float64()))], ["i", "u"])

    u_rows = leaf.select(F.col("node").alias("parent"), "ids", "q").join(down, "parent").select("ids", "q", "m").mapInArrow(finish, "i long, u array<double>")
    k, j = np.indices(vt.shape)
    return Svd(u_rows, s, spark.createDataFrame(pa.table({"k": k.ravel(), "j": j.ravel(), "v": vt.ravel()})))


def rebuilt(factors: Svd) -> DataFrame:
    """(i, j, v): the cells of U S V^T, from its rows and the small factors."""
    s = factors.s
    vt = factors.vt.orderBy("k", "j").toArrow().column("v").to_numpy().reshape(len(s), -1) if len(s) else np.zeros((0, 0))

    def run(batches):
        for batch in batches:
            u = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(s))
            x = (u * s) @ vt
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(np.repeat(np.arange(len(x)), x.shape[1]))), pa.array(np.tile(np.arange(x.shape[1]), len(x))), pa.array(x.ravel())], ["i", "j", "v"])

    return factors.u.mapInArrow(run, "i long, j long, v double")


def fft(columns: DataFrame, name: str, vector: str) -> DataFrame:
    """(j, i, re, im): the discrete Fourier transform along axis 0 of an array whose columns are the rows of vectors; a column lies in one row, so nothing moves."""

    def run(batches):
        for batch in batches:
            out: dict = {"j": [], "i": [], "re": [], "im": []}
            for j, x in zip(batch.column("j").to_pylist(), batch.column("v").to_pylist()):
                y = np.fft.fft(np.array(x, np.float64))
                for k, v in (("j", np.full(y.size, j)), ("i", np.arange(y.size)), ("re", y.real), ("im", y.imag)):
                    out[k].append(v)
            got = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([pa.array(got["j"], pa.int64()), pa.array(got["i"], pa.int64()), pa.array(got["re"], pa.float64()), pa.array(got["im"], pa.float64())], ["j", "i", "re", "im"])

    return columns.select(F.col(name).cast("long").alias("j"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0).mapInArrow(run, "j long, i long, re double, im double")


def stencil(x: DataFrame, kernel: np.ndarray, n: int, m: int, size: int) -> DataFrame:
    """The convolution of an n x m array, in blocks of size x size, with a kernel of odd height and width: out[i, j] is the sum of kernel[a, b] * x[i + h - a, j + w - b], h and w half the kernel's sides.

    Edges are mirrored with the edge cells repeated (d c b a | a b c d | d c b a). Each block sends to every block whose
    halo it reaches the rows and columns that it needs, so a halo may span several blocks; only borders move, and the
    result doesn't depend on the blocks' size."""
    kernel = np.asarray(kernel, np.float64)
    if kernel.ndim != 2 or not (kernel.shape[0] % 2 and kernel.shape[1] % 2):
        raise ValueError("a kernel has an odd number of rows and of columns")
    h, w = kernel.shape[0] // 2, kernel.shape[1] // 2
    if h > n or w > m:
        raise ValueError("the kernel reaches beyond the mirrored array")

    def wanted(t: int, deep: int, length: int) -> np.ndarray:
        """The places along an axis, mirrored into the array, that block t and its halo take."""
        at = np.arange(t * size - deep, min((t + 1) * size, length) + deep)
        return np.where(at < 0, -1 - at, np.where(at >= length, 2 * length - 1 - at, at))

    def targets(b: int, deep: int, length: int) -> list[tuple[int, int, int]]:
        """(target block, from, to) within block b of what each block needs of it."""
        low, high, out = b * size, min((b + 1) * size, length), []
        for t in range(max(0, (low - deep) // size), min((length - 1) // size, (high - 1 + deep) // size) + 1):
            own = wanted(t, deep, length)
            own = own[(own >= low) & (own < high)]
            if own.size:
                out.append((t, int(own.min()) - low, int(own.max()) + 1 - low))
        return out

    def send(batches):
        names = ["bi", "bj", "i", "j", "rows", "cols", "body"]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
        for batch in batches:
            for r in batch.to_pylist():
                a, rows = _array(r["body"], r["rows"], r["cols"]), []
                for ti, i0, i1 in targets(r["bi"], h, n):
                    for tj, j0, j1 in targets(r["bj"], w, m):
                        part = a[i0:i1, j0:j1]
                        rows.append((ti, tj, r["bi"] * size + i0, r["bj"] * size + j0, *part.shape, np.ascontiguousarray(part).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

    def apply(group: pa.Table) -> pa.Table:
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        at_i, at_j = wanted(bi, h, n), wanted(bj, w, m)
        wide = np.zeros((at_i.size, at_j.size))
        for r in group.to_pylist():
            part, i, j = _array(r["body"], r["rows"], r["cols"]), at_i - r["i"], at_j - r["j"]
            rows, cols = np.flatnonzero((i >= 0) & (i < r["rows"])), np.flatnonzero((j >= 0) & (j < r["cols"]))
            wide[np.ix_(rows, cols)] = part[np.ix_(i[rows], j[cols])]
        rows, cols = at_i.size - 2 * h, at_j.size - 2 * w
        out = np.zeros((rows, cols))
        flat = np.linalg.matrix_rank(kernel) == 1  # rows and columns can be gone through one after the other
        if flat:
            u, s, vt = np.linalg.svd(kernel)
            down, across = u[:, 0] * s[0], vt[0]
            tall = sum(across[b] * wide[:, 2 * w - b : 2 * w - b + cols] for b in range(2 * w + 1))
            out = sum(down[a] * tall[2 * h - a : 2 * h - a + rows] for a in range(2 * h + 1))
        else:
            for a, b in zip(*np.nonzero(kernel)):
                out += kernel[a, b] * wide[2 * h - a : 2 * h - a + rows, 2 * w - b : 2 * w - b + cols]
        return _table([_block(bi, bj, out)])

    moved = x.mapInArrow(send, "bi long, bj long, i long, j long, rows int, cols int, body binary")
    return moved.groupBy("bi", "bj").applyInArrow(apply, BLOCKS)


def mean_kernel(k: int) -> np.ndarray:
    """Equal weights over (2k + 1) x (2k + 1) neighbours."""
    return np.full((2 * k + 1, 2 * k + 1), (2 * k + 1.0) ** -2)
