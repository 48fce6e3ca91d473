"""Token ids of documents in sorted-string-table files.

A file holds documents in ascending order of their ids, in blocks of about BLOCK_BYTES whose keys are
prefix-compressed, then a Bloom filter of the keys, a sparse index (first key, place and size of each block) and a
footer of fixed size. Spark's text writer puts a line feed after each row it writes, here after each section; the
format counts it as the section's last byte. So files go through Spark's own committer to any store it can write.

Layout of a file, all numbers little-endian but keys (big-endian, sign bit flipped, so that byte order is id order):

    data block*   zstd of the entries (u16 shared, u16 own, u32 value bytes, own key bytes, value); then u32 crc of all before, LF
    filter        u32 hashes, then the bits, LF
    index         per block: key (9 bytes), u64 place, u32 size, LF
    footer        u64 filter place, u32 filter size, u64 index place, u32 index size, u64 entries, u64 tokens,
                  u32 shard, u8 bytes of an id, 8 bytes MAGIC, LF

A key is 9 bytes: 0 for a null id or else 1, then the id. Repeated ids are kept as entries of their own.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, bodies, dropped, id_column, parts_for, shared_dir, text_rows, written
from .words import as_text, per_worker, word_bpe

MAGIC = b"LGSSTv01"
FOOTER = struct.Struct("<QIQIQQIB8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7


def key_of(doc_id: int) -> bytes:
    return bytes(9) if doc_id == NULL_ID else b"\1" + ((doc_id + 2**63) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else NULL_ID


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """keys: ids as int64; a row of bit places for each."""
    from .common import mix

    h = mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Sections of one file, without their line feeds; entries must come in ascending order."""

    def __init__(self, shard: int, width: int, block_bytes: int = BLOCK_BYTES):
        self.shard, self.width, self.block_bytes = shard, width, block_bytes
        self.block, self.size, self.first, self.last, self.place = [], 0, b"", b"", 0
        self.index, self.ids, self.tokens = [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int, ids: bytes):
        key = key_of(doc_id)
        if key < self.last:
            raise ValueError("ids must ascend")
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block.append(struct.pack("<HHI", shared, 9 - shared, len(ids)) + key[shared:] + ids)
        self.size += len(self.block[-1])
        self.last = key
        self.ids.append(doc_id)
        self.tokens += len(ids) // self.width
        if self.size >= self.block_bytes:
            yield self._section()

    def _section(self) -> bytes:
        body = self.zstd.compress(b"".join(self.block))
        body += struct.pack("<I", zlib.crc32(body))
        self.index.append(self.first + struct.pack("<QI", self.place, len(body)))
        self.block, self.size = [], 0
        self.place += len(body) + 1
        return body

    def end(self):
        if self.block:
            yield self._section()
        bits = max(64, BLOOM_BITS * len(self.ids))
        held = np.zeros(bits, bool)
        held[_bloom_places(np.array(self.ids, np.int64), bits).ravel()] = True
        bloom = struct.pack("<II", BLOOM_HASHES, bits) + np.packbits(held).tobytes()
        index = b"".join(self.index)
        yield bloom
        yield index
        at = self.place + len(bloom) + 1
        yield FOOTER.pack(self.place, len(bloom), at, len(index), len(self.ids), self.tokens, self.shard, self.width, MAGIC)


class Reader:
    """A file's content: anything that slices to bytes (bytes, a memory map). get() reads footer, filter, index and one block or more of equal keys."""

    def __init__(self, content):
        end = len(content) - 1
        f = FOOTER.unpack(bytes(content[end - FOOTER.size : end]))
        if f[-1] != MAGIC or bytes(content[end:]) != b"\n":
            raise ValueError("not a file of this format, or cut short")
        self.content, (self.bloom_at, self.bloom_size, self.index_at, self.index_size, self.entries, self.tokens, self.shard, self.width, _) = content, f
        index = bytes(content[self.index_at : self.index_at + self.index_size])
        rows = [index[i : i + 21] for i in range(0, len(index), 21)]
        self.keys = [r[:9] for r in rows]
        self.places = [struct.unpack("<QI", r[9:]) for r in rows]

    def may_hold(self, doc_id: int) -> bool:
        raw = bytes(self.content[self.bloom_at : self.bloom_at + self.bloom_size])
        _, bits = struct.unpack("<II", raw[:8])
        at = _bloom_places(np.array([doc_id], np.int64), bits)[0]
        held = np.frombuffer(raw, np.uint8, offset=8)
        return bool(((held[at >> 3] >> (7 - (at & 7))) & 1).all())

    def block(self, k: int):
        """(key, value) of the entries of block k."""
        at, size = self.places[k]
        raw = bytes(self.content[at : at + size])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        raw = zstandard.ZstdDecompressor().decompress(raw[:-4])
        key, i = b"", 0
        while i < len(raw):
            shared, own, n = struct.unpack_from("<HHI", raw, i)
            key = key[:shared] + raw[i + 8 : i + 8 + own]
            yield key, raw[i + 8 + own : i + 8 + own + n]
            i += 8 + own + n

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each entry with this doc_id, by binary search of the index."""
        from bisect import bisect_left

        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        for k in range(max(0, bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[k] > key:
                break
            out += [self._ids(v) for x, v in self.block(k) if x == key]
        return out

    def __iter__(self):
        for k in range(len(self.keys)):
            for key, value in self.block(k):
                yield id_of(key), self._ids(value)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): each whole text's ids and end_id as little-endian unsigned numbers of `width` bytes (2 where the vocabulary allows, else 4)."""
    width = id_width(path, end_id)

    def run(batches):
        encode = per_worker(("word_bpe", path), lambda: word_bpe(path))
        for batch in batches:
            for ids, texts in bodies(batch):
                flat, counts, others = encode([as_text(x) for x in texts])
                flat, ends = flat.astype(f"<u{width}"), np.cumsum(counts)
                tail = np.array([end_id], f"<u{width}").tobytes()
                out = [(np.array(others[k], f"<u{width}") if k in others else flat[e - n : e]).tobytes() + tail for k, (e, n) in enumerate(zip(ends.tolist(), counts.tolist()))]
                yield pa.RecordBatch.from_arrays([id_column(ids), pa.array([len(x) // width for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_width(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(end_id + 1, Tokenizer.from_file(path).get_vocab_size()) <= 1 << 16 else 4


def write_sstables(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, file_bytes: int = 16 << 20) -> None:
    """Encodes whole texts and writes them to files under `out`, in ascending order of (doc_id, then a hash of the ids for repeated doc_ids) over all files.

    Null texts count as empty (the end id alone), null doc_ids sort first. No documents: a folder without entries.
    Encoded rows are written once to the shared folder; the sort then samples and moves ids, 2 bytes each, never texts."""
    spark = docs.sparkSession
    width = id_width(tokenizer, end_id)
    rows = written(encoded(docs, tokenizer, end_id), "ids")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    n = parts_for(spark, total * width, file_bytes)

    def run(batches):
        writer = Writer(TaskContext.get().partitionId(), width)
        some = False
        for batch in batches:
            out = []
            for i, x in zip(batch.column("doc_id").fill_null(NULL_ID).to_pylist(), batch.column("ids").to_pylist()):
                some = True
                out += writer.add(i, x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(list(writer.end()), pa.binary())], ["value"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    files = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("compression", "none").option("lineSep", "\n").text(out)
    dropped(rows)


def read_sstables(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, n_tokens, ids_crc32, before: ids before it in its file) of each entry of the files under `path`."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer().to_pybytes()
                if not raw:
                    continue
                file = Reader(raw)
                ids, counts, sums = [], [], []
                for i, x in file:
                    ids.append(i)
                    counts.append(x.size)
                    sums.append(zlib.crc32(x.tobytes()))
                n = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n.size, file.shard, np.int32)), id_column(np.array(ids, np.int64)), pa.array(n), pa.array(sums, pa.int64()), pa.array(np.cumsum(n) - n)], ["shard", "doc_id", "n_tokens", "ids_crc32", "before"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "shard int, doc_id long, n_tokens long, ids_crc32 long, before long")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes the files and returns (doc_id, start, n_tokens, ids_crc32, shard), read back from them.

    Starts add up the totals of the files (one row a file) and the places within each file."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    write_sstables(docs, out, tokenizer, end_id)
    back = written(read_sstables(spark, out), "entries")
    totals = back.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return back.join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")
