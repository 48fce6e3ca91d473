"""Packing along a space-filling curve.

Tokens of a document are counted in hashed buckets; the vector, scaled to length 1, is projected to DIMS fixed random
directions, and the Hilbert key of the projected point is the document's place. Documents are range-sorted by place
(ties by a hash of the id, then the id) and laid end to end; sequences are cut from that line, so neighbours on the
curve share sequences and only the last sequence of all can be short. Long documents lie near to each other on the
curve, so they are sorted as slices of SLICE ids and put together again where they are laid: ranges of as many rows
then have about as many ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, bodies, dropped, id_column, mix, parts_for, small, text_rows, written
from .words import as_text, byte_bpe, per_worker

DIMS, BITS, BUCKETS = 4, 10, 256
#: Most ids of a row that is sorted.
SLICE = 1024


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (one a row, coordinates below 2**bits)."""
    x = points.astype(np.int64).T.copy()
    dims = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        low = q - 1
        for d in range(dims):
            set_ = (x[d] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        q >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_places(ids: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """63-bit places of documents by their tokens (one after another; sizes: of each document): the Hilbert key, then bits of a hash of the id, so that equal documents can be divided."""
    directions = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    directions -= directions.mean(axis=0)
    bucket = (mix(np.arange(int(tokens.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(1)) >> np.uint64(56)).astype(np.int64)
    v = np.bincount(np.repeat(np.arange(sizes.size) * BUCKETS, sizes) + bucket[tokens], minlength=sizes.size * BUCKETS).reshape(-1, BUCKETS).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    points = np.clip((v @ directions / 4 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return (hilbert(points) << 23) | (mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(41)).astype(np.int64)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pieces of documents in sequences of at most `length` ids: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null text counts as empty: its end id alone. Each row of `docs` is packed, repeated ones too. All sequences but
    the last are full. No documents: no pieces. Of rows that repeat an id and its text the slices may lie in turns."""

    def encode_rows(batches):
        import xxhash

        encode = per_worker(("byte_bpe", tokenizer), lambda: byte_bpe(tokenizer))
        for batch in batches:
            for ids, texts in bodies(batch):
                out = [np.append(encode(as_text(x)), np.uint32(end_id)) for x in texts]
                sizes, line = np.array([x.size for x in out], np.int64), np.concatenate(out)
                narrow = np.dtype("<u2" if int(line.max()) < 1 << 16 else "<u4")
                same = np.array([xxhash.xxh3_64_intdigest(x) for x in out], np.uint64).view(np.int64)
                slices = -(-sizes // SLICE)
                of = np.repeat(np.arange(sizes.size), slices)
                start = (np.arange(of.size) - (np.cumsum(slices) - slices)[of]) * SLICE
                n = np.minimum(SLICE, sizes[of] - start)
                raw, ends = line.astype(narrow).tobytes(), np.cumsum(n) * narrow.itemsize
                cuts = [raw[a:b] for a, b in zip((ends - n * narrow.itemsize).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([id_column(ids[of]), *map(pa.array, (curve_places(ids, line, sizes)[of], same[of], sizes[of], start, n)), pa.array(cuts, pa.binary())], ["doc_id", "place", "same", "total", "start", "n", "ids"])

    def lay(batches):
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, same, total, start, n = (batch.column(c).fill_null(NULL_ID).to_numpy(zero_copy_only=False) for c in ("doc_id", "same", "total", "start", "n"))
            goes_on = (doc[1:] == doc[:-1]) & (same[1:] == same[:-1]) & (start[1:] == start[:-1] + n[:-1])
            first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            raw, bounds = batch.column("ids").to_pylist(), np.append(first, n.size).tolist()
            whole = [b"".join(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            sizes = np.add.reduceat(n, first)
            at = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([id_column(doc[first]), pa.array(np.full(first.size, shard, np.int32)), *map(pa.array, (at, total[first], start[first], sizes)), pa.array(whole, pa.binary())], ["doc_id", "shard", "before", "total", "start", "n", "ids"])

    def cut(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * len(names)
        for batch in batches:
            rows = []
            for doc, at, total, before, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "total", "start", "n", "ids"))):
                ids, start = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4"), 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    rows.append((doc, before + start, size, zlib.crc32(ids[start : start + size].tobytes()), total, (at + start) // length, offset))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    spark = docs.sparkSession
    rows = written(text_rows(docs).mapInArrow(encode_rows, "doc_id long, place long, same long, total long, start long, n long, ids binary"), "encoded")
    n_parts = parts_for(spark, 2 * (rows.agg(F.sum("n")).first()[0] or 0))
    order = ["place", "doc_id", "same", "start"]
    line = written(rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(lay, "doc_id long, shard int, before long, total long, start long, n long, ids binary"), "line")
    dropped(rows)
    totals = line.groupBy("shard").agg(F.sum("n").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    placed = line.join(small(bases, n_parts), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "total", "start", "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
