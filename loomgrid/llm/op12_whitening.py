"""Embedding whitening by hierarchical merging of singular value decompositions.

Components are whole numbers, floor(SCALE * component), and what is fitted is the list of different vectors, each once.
A part of the list is described by its number of vectors, its exact sums, and all singular values and right vectors of
its centred rows. Two parts merge by stacking S V^T of both and one more row, sqrt(na nb / (na + nb)) times the
difference of their means, and decomposing again: nothing is cut off, so the last description is that of the whole list
up to rounding. Tasks merge their own rows slice by slice, and their descriptions meet in a tree, FAN_IN at a time.

Only the leading components (a few vectors of the rows' length) come to the driver and go to the tasks that whiten.

Vectors of each length are a list of their own. Ids may be null or repeat; each row gives its own rows. A component
without variance (one vector only, or all on a line) has a null `whitened`, and identity_error leaves it out. A deviation
that no long holds is null. Vectors that vectors.integers() leaves out, and empty ones, give no row. No rows: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import by_length, exact, integers

SCALE, TOP = 256, 4
#: Rows of a first description; descriptions that meet in one step of the tree.
SLICE, FAN_IN = 1024, 8
#: Singular values below this share of the largest are none.
NONE = 1e-12
STATE = "slot int, dims int, n long, sums binary, s binary, vt binary"


@dataclass
class State:
    n: int
    sums: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


def described(x: np.ndarray) -> State:
    """Of rows of whole numbers: centred exactly before they are rounded."""
    sums = x.sum(0)
    _, s, vt = np.linalg.svd(centred(x, len(x), sums)[0], full_matrices=False)
    return State(len(x), sums, s, vt)


def merged(a: State, b: State) -> State:
    shift = np.sqrt(a.n * b.n / (a.n + b.n)) * (a.mean - b.mean)
    _, s, vt = np.linalg.svd(np.concatenate([a.s[:, None] * a.vt, b.s[:, None] * b.vt, shift[None]]), full_matrices=False)
    return State(a.n + b.n, a.sums + b.sums, s, vt)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x - sums / n as doubles, n * x - sums as whole numbers)."""
    kind = exact(2 * n * int(abs(x).max(initial=0)) + int(abs(sums).max(initial=0)))
    whole = n * x.astype(kind) - sums.astype(kind)
    return whole.astype(np.float64) / n, whole


def _rows(states: dict[int, State], slot: int) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    rows = [(slot, d, t.n, t.sums.tobytes(), t.s.tobytes(), t.vt.tobytes()) for d, t in sorted(states.items())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["slot", "dims", "n", "sums", "s", "vt"])


def _put(held: dict[int, State], d: int, state: State) -> None:
    held[d] = merged(held[d], state) if d in held else state


def decomposed(distinct: DataFrame) -> DataFrame:
    """STATE of all rows of a written table of different vectors x: a row for each length."""

    def first(batches):
        held: dict[int, State] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column("x")):
                for a in range(0, len(x) if d else 0, SLICE):
                    _put(held, d, described(x[a : a + SLICE]))
        yield _rows(held, TaskContext.get().partitionId())

    def join(batches):
        found = sorted(((r["dims"], r["slot"], r) for batch in batches for r in batch.to_pylist()), key=lambda t: t[:2])
        held: dict[int, State] = {}
        for d, _, r in found:
            _put(held, d, State(r["n"], np.frombuffer(r["sums"], np.int64), np.frombuffer(r["s"]), np.frombuffer(r["vt"]).reshape(-1, d)))
        yield _rows(held, found[0][1] // FAN_IN if found else 0)

    slots = distinct.rdd.getNumPartitions()
    out = distinct.select("x").mapInArrow(first, STATE)
    while slots > 1:
        slots = -(-slots // FAN_IN)
        out = out.repartitionById(slots, F.expr(f"slot div {FAN_IN}").cast("int")).mapInArrow(join, STATE)
    return out


@dataclass
class Model:
    """The leading components of a length: unit vectors in rows, each one's largest entry positive; and variances."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    explained: list[float | None]

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, components), NaN where there is no variance; and n * x - sums."""
        parts, whole = centred(x, self.n, self.sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            return parts @ self.axes.T / np.where(self.variance > 0, np.sqrt(self.variance), np.nan), whole


def models(distinct: DataFrame, top: int = TOP) -> dict[int, Model]:
    """By length. What reaches the driver has `top` components of each, however many rows there are."""

    def leading(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d, s = r["dims"], np.frombuffer(r["s"])
                vt = np.frombuffer(r["vt"]).reshape(-1, d)
                k = min(top, d)
                axes, values = np.zeros((k, d)), np.zeros(k)
                axes[: len(vt[:k])], values[: len(s[:k])] = vt[:k], s[:k]
                values[values <= NONE * s.max(initial=0)] = 0
                axes *= np.sign(axes[np.arange(k), abs(axes).argmax(1)])[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([r["n"]], pa.int64()), pa.array([r["sums"]]), pa.array([axes.tobytes()]), pa.array([(values**2 / r["n"]).tobytes()]), pa.array([float((s**2).sum() / r["n"])])], ["dims", "n", "sums", "axes", "variance", "trace"])

    out = {}
    for r in decomposed(distinct).mapInArrow(leading, "dims int, n long, sums binary, axes binary, variance binary, trace double").toLocalIterator():
        variance = np.frombuffer(r["variance"])
        out[r["dims"]] = Model(r["n"], np.frombuffer(r["sums"], np.int64), np.frombuffer(r["axes"]).reshape(-1, r["dims"]), variance, [float(e) / r["trace"] if r["trace"] else None for e in variance])
    return out


def identity_errors(distinct: DataFrame, found: dict[int, Model]) -> dict[int, float | None]:
    """By length: the largest absolute entry of the whitened list's covariance minus the identity, measured on the list."""
    told = distinct.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column("x")):
                if d:
                    w = told.value[d].whitened(x)[0]
                    held[d] = held.get(d, 0) + w.T @ w
        for d, g in held.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(g.ravel())], ["dims", "i", "j", "v"])

    out: dict[int, float | None] = dict.fromkeys(found)
    for r in distinct.select("x").mapInArrow(run, "dims int, i int, j int, v double").where(~F.isnan("v")).groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        off = abs(r["v"] / found[r["dims"]].n - (r["i"] == r["j"]))
        out[r["dims"]] = off if out[r["dims"]] is None else max(off, out[r["dims"]])
    return out


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and each of its first components."""
    rows = written(integers(vectors, SCALE, vector, id=F.col(f"`{vec_id}`").cast("long")), "integers")
    distinct = written(rows.select("x").distinct(), "distinct")
    found = models(distinct, top)
    told = rows.sparkSession.sparkContext.broadcast((found, identity_errors(distinct, found)))

    def run(batches):
        for batch in batches:
            for d, at, x in by_length(batch.column("x")):
                if not d:
                    continue
                models_, errors = told.value
                m, k = models_[d], min(top, d)
                w, whole = m.whitened(x)
                whole = whole.astype(exact(d * int(abs(whole).max(initial=0)) ** 2))
                far = pa.array([v if v < 2**63 else None for v in (whole * whole).sum(1).tolist()], pa.int64())
                place = pa.array(np.repeat(np.arange(len(at)), k))
                each = len(at) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(each, m.n, np.int64)), far.take(place),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())), pa.array(m.explained * len(at), pa.float64()), pa.array([errors[d]] * each, pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
