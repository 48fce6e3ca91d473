"""What the operators share: tables, the folder all executors see, packs of documents, and exchanges of packed arrays.

Conventions that hold for every operator of this subpackage:

* a null text counts as an empty one; a null id is kept and sorts first;
* repeated rows are kept, one result row for each input row;
* empty tables give empty results with the usual columns;
* input columns that an operator does not name are never read, so they may have any name.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that stands for a null doc_id inside packed arrays.
NULL_ID = -(2**63)
#: Bytes of text in a pack; a longer document is a pack of its own.
PACK_BYTES = 2 << 20
#: Bytes that one task of an exchange should hold.
PART_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one only where that is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (at := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at := f"file://{tempfile.mkdtemp()}")
    return at.rstrip("/")


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """The rows of `df` as a Parquet table in the shared folder: cuts the lineage, and is whole whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def least_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, n_bytes: float, each: int = PART_BYTES) -> int:
    return max(least_parts(spark), int(n_bytes // each) + 1)


def small(df: DataFrame, rows: int, most: int = 1 << 20) -> DataFrame:
    """For a join: a table known to have at most `rows` short rows is broadcast if those are no more than `most`; beyond, it is joined as Spark likes."""
    return F.broadcast(df) if rows <= most else df


def spread_join(rows: DataFrame, told: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of `told` (a row for each key; _n: how many rows have it), joined by `key` without a task that gets all rows of a hot key.

    Keys of more than max(1000, total / 100,000) rows are 100,000 at most, and are broadcast; the others are joined as Spark likes.
    rows must be a written table, or cheap: it is read twice."""
    many = F.col("_n") > max(1000, total // 100_000)
    hot = F.broadcast(told.where(many).drop("_n"))
    rest = rows.join(F.broadcast(told.where(many).select(key)), key, "left_anti").join(told.where(~many).drop("_n"), key, how)
    return rows.join(hot, key).unionByName(rest)


def text_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, body): the text as UTF-8 bytes, null as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("body"))


def bodies(batch: pa.RecordBatch, most: int = PACK_BYTES, places: bool = False) -> Iterator[tuple]:
    """(ids, texts) of a batch of text_rows(), in slices of about `most` bytes; places: (place in the batch, ids, texts)."""
    if not batch.num_rows:
        return
    ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    sizes = batch.column("body")
    ends = np.cumsum(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        found = ids[at:to], sizes.slice(at, to - at).to_pylist()
        yield (at, *found) if places else found
        at, before = to, int(ends[to - 1])


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string, for unblob()."""
    import zstandard

    parts = [np.ascontiguousarray(a) for a in arrays]
    head = ";".join(f"{a.dtype.str},{a.size}" for a in parts).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in parts))


def unblob(body: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for x in raw[4:at].decode().split(";"):
        kind, size = x.split(",")
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += out[-1].nbytes
    return out


PACKS = "pack long, docs long, raw long, body binary"


def packs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = PACK_BYTES, keep: bool = False, form: Callable[[np.ndarray, list[bytes]], bytes] | None = None) -> DataFrame:
    """Documents in packs, sorted by id in each: a written table of (pack, docs, raw bytes, body). A pack is one row, so later stages see the same packs whatever is retried.

    form: makes another body of (ids, texts) than the one for pack_texts(). keep: with a column rest, all columns of the documents' rows, for unpacked_rows()."""
    source = text_rows(docs, text, doc_id)
    if keep:  # the other columns in one struct, so that they may have any name
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
        source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("body"), F.col(text).isNull().alias("none"), rest.alias("rest"))
    names = ["pack", "docs", "raw", "body"] + ["rest"] * keep

    def pack(batches):
        task = TaskContext.get()
        seq = task.partitionId() << 32
        held, rests, size = [], [], 0

        def out():
            nonlocal seq
            order = sorted(range(len(held)), key=lambda k: held[k][0])
            rows = [held[k] for k in order]
            ids, texts = np.array([x[0] for x in rows], np.int64), [x[1] for x in rows]
            row = [seq, len(rows), sum(map(len, texts)), (form or text_pack)(ids, texts)]
            if keep:
                whole = pa.Table.from_batches(rests).take(pa.array(order))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(whole)
                row.append(sink.getvalue().to_pybytes())
            seq += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] * (len(names) - 3)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            if keep:
                rest = batch.select(["rest", "none"])
            for at, ids, texts in bodies(batch, most, places=True):
                start = 0
                for k, (i, x) in enumerate(zip(ids.tolist(), texts)):
                    if held and (size + len(x) > most or len(held) >= 1 << 16):
                        if keep and k > start:
                            rests.append(rest.slice(at + start, k - start))
                        yield out()
                        held, rests, size, start = [], [], 0, k
                    held.append((i, x))
                    size += len(x)
                if keep:
                    rests.append(rest.slice(at + start, len(texts) - start))
        if held:
            yield out()

    return written(source.mapInArrow(pack, PACKS + ", rest binary" * keep), "packs", "uncompressed")


def text_pack(ids: np.ndarray, texts: list[bytes]) -> bytes:
    """The usual body of a pack."""
    return blob(ids, np.array([len(x) for x in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))


def unpacked_rows(rest: bytes, texts: list[bytes], names: list[str], text: str) -> pa.Table:
    """The rows of a pack, in its order, with these texts: the columns `names`, `text` among them. Null texts stay null; what is left of a cut character goes."""
    table = pa.ipc.open_stream(rest).read_all().combine_chunks()
    whole = [None if none else x.decode("utf-8", "ignore") for x, none in zip(texts, table.column("none").to_pylist())]
    chunks = table.column("rest").chunks
    others = iter(chunks[0].flatten() if chunks else [])
    return pa.table([pa.array(whole, pa.string()) if c == text else next(others) for c in names], names)


def pack_texts(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts with the end, bytes) of a pack's body."""
    ids, lens, raw = unblob(body)
    return ids, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), raw


def pack_list(body: bytes) -> tuple[np.ndarray, list[bytes]]:
    ids, starts, raw = pack_texts(body)
    raw = raw.tobytes()
    return ids, [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


MAIL = "part int, pack long, body binary"


def mail(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, pack, body = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(pack, pa.int64()), pa.array(body, pa.binary())], ["part", "pack", "body"])


def to_parts(source: DataFrame, emit: Callable[[int, bytes], Iterator[tuple[int, bytes]]], columns: str = MAIL) -> DataFrame:
    """Mail of each pack to parts: emit(pack, body) gives (part, body)."""

    def run(batches):
        for batch in batches:
            for p, body in zip(batch.column("pack").to_pylist(), batch.column("body").to_pylist()):
                for part, out in emit(p, body):
                    yield mail([(part, p, out)])

    return source.select("pack", "body").mapInArrow(run, columns)


def at_parts(sent: DataFrame, n_parts: int, answer: Callable[[np.ndarray, list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Each part in a task of its own: answer(packs, bodies) gives (pack, body) of replies; result: mail back to packs."""

    def run(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for part, p, body in zip(*(batch.column(c).to_pylist() for c in ("part", "pack", "body"))):
                by.setdefault(part, []).append((p, body))
        for part, rows in sorted(by.items()):
            rows.sort(key=lambda x: x[0])
            for p, out in answer(np.array([x[0] for x in rows], np.int64), [x[1] for x in rows]):
                yield mail([(part, p, out)])

    return sent.repartitionById(n_parts, "part").mapInArrow(run, MAIL)


def at_packs(source: DataFrame, replies: list[DataFrame], handle: Callable, schema: str) -> DataFrame:
    """Packs beside the replies to them: handle(pack, body, [{part: body} for each of replies]) gives a pyarrow table of `schema`."""
    both = source.select(F.lit(-1).alias("kind"), F.lit(-1).alias("part"), "pack", "body")
    for k, r in enumerate(replies):
        both = both.unionByName(r.select(F.lit(k).alias("kind"), "part", "pack", "body"))
    n = len(replies)

    def run(group: pa.Table) -> pa.Table:
        own, told = None, [{} for _ in range(n)]
        for kind, part, body in zip(*(group.column(c).to_pylist() for c in ("kind", "part", "body"))):
            if kind < 0:
                own = body
            else:
                told[kind][part] = body
        return handle(group.column("pack")[0].as_py(), own, told)

    return both.groupBy("pack").applyInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x
