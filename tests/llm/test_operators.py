"""Each operator against a brute-force version, over a small table with nulls, empty and long texts, ties, repeats and columns whose names clash."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdeéßñ") for _ in range(RNG.randint(1, 6))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pack long, body string, part int, shard int, id long, n int, size string"


def words(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def texts():
    base, passage = words(80), words(40)
    out = [None, "", " ", "one", "two words", "a" * 400, base, base, base + " more", base.upper(), words(3000), "İstanbul ǅ 東京 😀 <|endoftext|> it's 12,5\t\n x", "ab " * 90]
    out += [words(RNG.randint(5, 120)) + " " + passage + " " + words(5) for _ in range(8)]
    for _ in range(12):  # near copies of one another
        w = base.split()
        for _ in range(RNG.randint(0, 2)):
            w[RNG.randrange(len(w))] = RNG.choice(VOCAB)
        out.append(" ".join(w))
    return out + [words(RNG.randint(1, 60)) for _ in range(30)]


TEXTS = dict(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else "hot" if i % 3 else f"s{i}", None if t is None else len(t), 1, "x", 2, 3, 4, 5, "y") for i, t in TEXTS.items()]
    RNG.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_kd_shards(docs, none, shards):
    from loomgrid.llm.op01_kd_shards import sharded

    rows = sharded(docs, shards).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(TEXTS)
    by = {}
    for r in rows:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards and sorted(r["slot"] for r in x) == list(range(len(x))) for s, x in by.items())
    sizes, most = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)], max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * most
    assert sharded(none, shards).count() == 0


def test_kd_shards_hold_neighbours_in_metadata(spark, sf):
    """A shard's documents span less of each dimension's order than a deal at random, and all together far less; the sizes stay near equal."""
    from loomgrid.llm.op01_kd_shards import sharded

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    meta = {r["doc_id"]: (r["n_chars"], r["source"], r["lang"]) for r in docs.collect()}
    rows = sharded(docs, 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    ids = [r["doc_id"] for r in rows]
    dealt = dict(zip(random.Random(1).sample(ids, len(ids)), (k % 8 for k in range(len(ids)))))

    def spans(shard_of):
        out = []
        for d in range(3):
            order = {v: k for k, v in enumerate(sorted({m[d] for m in meta.values()}, key=lambda v: (v is not None, v)))}
            for s in range(8):
                own = [order[meta[i][d]] for i in ids if shard_of[i] == s]
                out.append((max(own) - min(own) + 1) / len(order))
        return np.array(out).reshape(3, 8).mean(1)

    ours, random_ = spans({r["doc_id"]: r["shard"] for r in rows}), spans(dealt)
    assert (ours <= random_).all() and ours.prod() < 0.5 * random_.prod()
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)



def test_sstable(spark, docs, none, tmp_path):
    from loomgrid.llm.op02_sstable import Reader, token_index

    t, at, want = Tokenizer.from_file(WORD), 0, []
    for i in sorted(TEXTS):
        ids = t.encode(TEXTS[i] or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(u32(ids))))
        at += len(ids)
    assert got(token_index(docs, WORD, out=f"file://{tmp_path}/sst"), "doc_id", "start", "n_tokens", "ids_crc32") == want
    files = [Reader(p.read_bytes()) for p in sorted((tmp_path / "sst").glob("part-*")) if p.stat().st_size]
    assert [i for f in files for i, _ in f] == sorted(TEXTS)
    found = [x.tolist() for f in files for x in f.get(10)]
    assert found == [t.encode(TEXTS[10], add_special_tokens=False).ids + [2]]
    assert not any(f.get(10**9) for f in files)
    assert token_index(none, WORD).count() == 0


def test_sstable_repeated_and_null_ids():
    from loomgrid.llm.common import NULL_ID
    from loomgrid.llm.op02_sstable import Reader, Writer

    w, out = Writer(0, 2, block_bytes=40), []
    rows = [(NULL_ID, b"\1\0"), (-5, b""), (3, b"\2\0"), (3, b"\3\0\4\0"), *[(k, bytes(20)) for k in range(4, 60)]]
    for i, x in rows:
        out += w.add(i, x)
    file = Reader(b"".join(x + b"\n" for x in [*out, *w.end()]))
    assert [(i, x.astype("<u2").tobytes()) for i, x in file] == rows
    assert [x.tolist() for x in file.get(3)] == [[2], [3, 4]] and len(file.get(NULL_ID)) == 1 and file.get(2) == []
    with pytest.raises(ValueError):
        list(w.add(1, b""))


def test_prefix_bpe(docs, none):
    from loomgrid.llm.op04_bpe import round_trip

    t, want = Tokenizer.from_file(BYTE), []
    for i in sorted(TEXTS):
        ids = t.encode(TEXTS[i] or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got(round_trip(docs, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert round_trip(none, BYTE).count() == 0


@pytest.mark.parametrize("slice_", [1024, 16])
def test_packing(docs, none, monkeypatch, slice_):
    from loomgrid.llm import op10_packing as op
    from loomgrid.llm.op10_packing import hilbert, packed

    monkeypatch.setattr(op, "SLICE", slice_)
    t, rows = Tokenizer.from_file(BYTE), packed(docs, BYTE, length=64).collect()
    fill, own = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(u32(ids[r["start"] : r["start"] + r["length"]]))
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        own.setdefault(r["doc_id"], []).append((r["start"], r["length"], len(ids)))
    assert sum(v != 64 for v in fill.values()) <= 1 and set(own) == set(TEXTS)
    for x in own.values():
        assert sum(n for _, n, _ in x) == x[0][2]
    assert packed(none, BYTE).count() == 0
    grid = np.array([(a, b) for a in range(8) for b in range(8)])
    path = grid[np.argsort(hilbert(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all() and len(set(hilbert(grid, 3).tolist())) == 64


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats(docs, none, monkeypatch, hot):
    from loomgrid.llm import op07_suffix_dedup as op

    monkeypatch.setattr(op, "HOT", hot)
    want = brute_repeats(sorted(TEXTS.items()), 100)
    assert got(op.repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert op.repeats(none).count() == 0


def test_cut_keeps_rows(docs):
    from loomgrid.llm.op07_suffix_dedup import repeats

    out = repeats(docs, cut=True)
    assert out.schema == docs.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == set(TEXTS) and rows[0]["text"] is None and rows[3]["text"] == "one" and rows[7]["text"] == "" and rows[7]["source"] == {r["doc_id"]: r for r in docs.collect()}[7]["source"]


def test_suffix_ranks():
    from loomgrid.llm.op07_suffix_dedup import suffix_ranks

    rng = np.random.default_rng(1)
    for n in [*range(1, 30), 500]:
        for k in (1, 2, 40):
            s = rng.integers(0, k, n)
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            assert suffix_ranks(s)[order].tolist() == list(range(n))


def brute_links(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and least[a] != least[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    old, new = max(least[a], least[b]), min(least[a], least[b])
                    least = {i: new if c == old else c for i, c in least.items()}
                    changed = True
    return [(i, len(sets[i]), least[i]) for i in sorted(sets)]


@pytest.mark.parametrize("k, num, block, most_bytes", [(3, 90, 1024, 64 << 20), (5, 80, 1024, 64 << 20), (3, 60, 2, 64 << 20), (3, 60, 1024, 1200)])
def test_jaccard(docs, none, monkeypatch, k, num, block, most_bytes):
    from loomgrid.llm import op09_jaccard as op

    monkeypatch.setattr(op, "MOST_BYTES", most_bytes)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "MOST", 4 * block)
    want = brute_links(sorted(TEXTS.items()), k, num, 100)
    assert len({c for *_, c in want}) < len(want)
    assert got(op.linked(docs, k, num, 100), "doc_id", "n_shingles", "component_id") == want
    assert op.linked(none).count() == 0


def test_jaccard_copies(spark, monkeypatch):
    """Groups of near copies in bands of many tiles: a class goes to few of them, with the links of all pairs."""
    from loomgrid.llm import op09_jaccard as op
    from loomgrid.plans.workers import exchanges

    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        words = rng.integers(1 << 40, size=rng.integers(60, 320))
        for _ in range(4):
            own = np.where(rng.random(words.size) < rng.choice([0.01, 0.03, 0.05]), rng.integers(1 << 40, size=words.size), words)
            rows.append((len(rows), " ".join(map("w{}".format, own))))
    monkeypatch.setattr(op, "BLOCK", 8)
    monkeypatch.setattr(op, "MOST", 16)
    found = []
    moved = exchanges(spark, lambda: found.extend(got(op.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100), "doc_id", "n_shingles", "component_id")))
    most = max(r["written_rows"] for r in moved.collect())
    want = brute_links(rows, 3, 80, 100)
    assert found == want and 60 < len({c for *_, c in want}) < 200
    assert most <= 4 * len(rows)


@pytest.mark.parametrize("num", [60, 80, 90])
def test_jaccard_labels(num):
    """Linked sets keep a common label, whatever the labels of their shared shingles and whichever others have been found shared."""
    from loomgrid.llm import op09_jaccard as op

    rng, den, tried, cut = np.random.default_rng(num), 100, 0, 0
    few, fitting = op.SMALL, op.SMALL * den // num + 2
    bound = lambda n, limit: 2**64 - 1 if n < limit else min(2**64 - 1, int(2 * (den - num) / den * 2**64))
    for _ in range(3000):
        common = int(rng.integers(20, 400))
        own = rng.multinomial(common * den // num - common, [f := rng.choice([0, 0.2, 0.5]), 1 - f])
        h = rng.permutation(rng.integers(2**64, size=common + own.sum(), dtype=np.uint64))
        kinds, whole = int(rng.choice([1, 3, 30, 10**6])), rng.random()
        labels, shared = lambda x: (x % np.uint64(kinds)).astype(np.uint32), np.concatenate([h[:common], h[common:][rng.random(own.sum()) < whole]])  # noqa: E731, B023
        kept = []
        for s in (h[: common + own[0]], np.delete(h, np.s_[common : common + own[0]])):
            s, n = np.sort(s), s.size
            sent = s[: max(int(np.searchsorted(s, np.uint64(bound(n, fitting)), "right")), op.lead(n, num, den))]
            below, hit = int(np.searchsorted(sent, np.uint64(bound(n, few)), "right")), np.isin(sent, shared)
            assert below - hit[:below].sum() <= op.lacking(n, num, den)
            kept.append(op.kept_labels(labels(sent), hit, below, n, num, den, fitting))
            cut += kept[-1].size < np.unique(labels(sent[hit])).size
        assert np.intersect1d(*kept).size
        tried += 1
    assert tried == 3000 and cut > 500


def test_components(spark):
    from loomgrid.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    rows = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {rows[i] for i in range(41)} == {0} and {rows[i] for i in (100, 101, 102)} == {100}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x[20:60] = x[0]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (950, [0.0] * 64, 1), (960, [float("nan")] * 64, 1), (980, [], 1), (1000, [None] + [1.0] * 63, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), x


#: Bytes of a cell, data of a block within it, queries searched at once: all in one cell, and many cells of several blocks each.
CELLS = pytest.mark.parametrize("cell,block,queries", [(1 << 27, 1 << 15, 2048), (4096, 7, 3)])


def test_queries_meet_each_cell_of_their_kind_once(spark, monkeypatch):
    """Data of two kinds and rows for all cells, queries of three kinds in batches of 5 rows: which data each query met."""
    import pyarrow as pa

    from loomgrid.llm import vectors

    monkeypatch.setattr(vectors, "CELL_BYTES", 100)
    data = spark.createDataFrame([(k % 2, str(k).encode(), k) for k in range(60)] + [(k, None, 1000 + k) for k in (0, 1)], "kind int, body binary, id long").repartition(4)
    asked = spark.createDataFrame([(k % 3, k, str(k).encode()) for k in range(45)], "kind int, q long, body binary").repartition(3)

    def hold(table):
        ids = table.column("id").to_pylist()
        assert ids[0] >= 1000 and len(set(table.column("kind").to_pylist())) == 1
        return ids

    def answer(ids, batch):
        q = [x for x in batch.column("q").to_pylist() for _ in ids]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids * batch.num_rows)], ["q", "id"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = vectors.streamed(data, asked, 500, hold, answer, "q long, id long")  # 6 cells
        rows = [(r["q"], r["id"]) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(x for x in rows if x[1] < 1000) == sorted((q, k) for q in range(45) for k in range(60) if k % 2 == q % 3)
    assert {x[1] for x in rows if x[1] >= 1000 and x[0] % 3 == 1} == {1001}


@CELLS
def test_hamming(spark, vectors, monkeypatch, cell, block, queries):
    import loomgrid.llm.op03_hamming as op03
    import loomgrid.llm.vectors as cells
    from loomgrid.llm.op03_hamming import hamming_neighbours, sign_codes

    monkeypatch.setattr(cells, "CELL_BYTES", cell)
    monkeypatch.setattr(op03, "BLOCK", block)
    monkeypatch.setattr(op03, "QUERIES", queries)
    df, _ = vectors
    codes = sign_codes(df)
    bits = {r["vec_id"]: np.array([0.0 if v is None else v for v in r["embedding"]]) > 0 for r in df.collect() if r["embedding"] and len(r["embedding"]) == 64}
    want = []
    for q in sorted(i for i in bits if i % 50 == 0):
        near = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items())[:10]
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got(hamming_neighbours(codes, codes.where("id % 50 = 0")), "query_id", "rank", "vec_id", "distance") == want
    few = codes.where("id < 3")
    assert hamming_neighbours(few, few).count() == 9
    assert hamming_neighbours(codes.where("false"), codes.where("false")).count() == 0


@CELLS
def test_products(vectors, monkeypatch, cell, block, queries):
    import loomgrid.llm.op06_anisotropic as op06
    import loomgrid.llm.vectors as cells
    from loomgrid.llm.op06_anisotropic import nearest_products, usable

    monkeypatch.setattr(cells, "CELL_BYTES", cell * 16)
    monkeypatch.setattr(op06, "BLOCK", block)
    monkeypatch.setattr(op06, "QUERIES", queries)
    df, x = vectors
    rows = usable(df)
    assert rows.count() == 400
    out = {}
    for r in nearest_products(rows, rows.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        assert r["score"] == pytest.approx(float(x[r["vec_id"]] @ x[r["query_id"]]))
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 400, 20):
        best = [i for i in np.lexsort((np.arange(400), -np.round(x @ x[q], 9))).tolist() if i != q][:20]
        assert len(out[q]) == 20 and q not in out[q]
        hits += len(set(best) & set(out[q]))
    assert hits >= 0.9 * 400
    assert out[0] == list(range(20, 40))
    none = rows.where("false")
    assert nearest_products(none, none).count() == 0


def test_maxent(docs, none):
    import math

    from loomgrid.llm.op08_maxent import scored

    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in TEXTS.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in TEXTS}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = scored(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(TEXTS)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r["score"] < 0
    assert scored(none).count() == 0


def test_maxent_adds_up_to_one():
    """Over all known words and an unknown one of each tail class, in any context."""
    from loomgrid.llm.op08_maxent import BEFORE, TAIL, Model

    rng, u = np.random.default_rng(0), np.uint64
    words, counts = rng.integers(0, 2**63, 90).astype(u), np.arange(90, 0, -1).astype(float)
    others, few = rng.integers(0, 2**63, 40).astype(u), np.ones(40)
    mass = np.bincount(np.concatenate([words, others]).astype(np.int64) & (TAIL - 1), weights=np.concatenate([counts, few]) + 1, minlength=TAIL)
    m = Model(words, counts, mass)
    m.start(rng.integers(0, 5, (BEFORE + 2 + TAIL, 90 + TAIL)).astype(float))
    m.B += rng.standard_normal(m.B.shape).astype(np.float32)
    outcomes = np.concatenate([words, others, (np.arange(TAIL).astype(u) | u(1 << 63))])
    c = np.concatenate([counts, few, np.zeros(TAIL)])
    h = np.stack([np.full(outcomes.size, words[3]), np.full(outcomes.size, others[1]), outcomes], axis=1).ravel()
    got_ = m.log10(h, np.full(outcomes.size, 3), np.repeat(c, 3)).reshape(-1, 3)[:, 2]
    assert (10**got_).sum() == pytest.approx(1, abs=1e-4)


def test_toxicity(spark, none):
    from loomgrid.llm.op05_toxicity import toxicity, without_toxic

    rng = random.Random(1)
    rows = []
    for i in range(1500):
        bad = i % 8 == 0
        w = [rng.choice(VOCAB) for _ in range(60)]
        for _ in range(5 * bad):
            w[rng.randrange(60)] = rng.choice(["grolm", "snuff!", "vrakk"])
        rows.append((i, " ".join(w), int(bad)))
    rows += [(5000, None, 0), (5001, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3)
    labels = df.where("doc_id < 1400").selectExpr("doc_id", "0 as quality", "y as toxic")
    out = {r["doc_id"]: r for r in toxicity(df, labels).collect()}
    assert len(out) == len(rows) and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert np.mean([out[i]["predicted"] == y for i, _, y in rows]) > 0.98 and 0 <= out[5001]["score"] < 0.5
    kept = {r["doc_id"] for r in without_toxic(df, labels).collect()}
    assert kept == {i for i in out if not out[i]["predicted"]}
    assert {r["score"] for r in toxicity(df.limit(5), labels.where("false")).collect()} == {0.5}
    assert toxicity(none, labels).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    firsts = {i for i, _, c in brute_links(sorted(TEXTS.items()), 5, 80, 100) if i == c}
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    assert set(left) == firsts
    cut = {i: x for i, *x in brute_repeats([(i, TEXTS[i]) for i in sorted(firsts)], 100)}
    for i, t in left.items():
        assert (t is None) == (TEXTS[i] is None)
        assert cut[i][1] or (t or "") == (TEXTS[i] or "")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == firsts


def test_tokens_are_the_same_whatever_a_worker_forgets():
    from xxhash import xxh3_64_intdigest

    from loomgrid.llm.op08_maxent import END, TAIL, Tokens, pack_tokens, token_pack

    rng = random.Random(3)
    texts = [b"", b" \t", *(" ".join(rng.choice(VOCAB) for _ in range(rng.randrange(40))).encode() for _ in range(30)), b"A a\xc3\x84 a"]
    short, long = Tokens(most=3), Tokens()
    seen = {}
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        for held in (short, long):
            words, of, sizes = held.of(some)
            assert words.size == np.unique(words).size and sizes.tolist() == [len(t.lower().split()) + 1 for t in some]
            spelt = [w for t in some for w in [*t.lower().split(), None]]
            for w, h in zip(spelt, words[of].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert seen[None] == int(END) and len(set(seen.values())) == len(seen)
    assert all(h % TAIL == xxh3_64_intdigest(w[-2:]) % TAIL for w, h in seen.items() if w)
    ids, sizes, words, of = pack_tokens(token_pack(np.array([4, 9]), [b"x y x", b""]))
    assert ids.tolist() == [4, 9] and sizes.tolist() == [4, 1] and words.size == 3 and of.tolist()[0] == of.tolist()[2]


def test_curve_places_go_by_tokens():
    """Documents with the same counts of tokens share a Hilbert key, whatever their order; unlike ones need not; ids divide equal ones."""
    from loomgrid.llm.op10_packing import curve_places

    docs = [[7, 8, 9, 1], [9, 7, 8, 1], [20000, 30000, 40000, 1], [1]]
    sizes = np.array([len(d) for d in docs])
    got_ = curve_places(np.arange(4), np.concatenate(docs).astype(np.uint32), sizes)
    assert got_[0] >> 23 == got_[1] >> 23 != got_[2] >> 23 and len(set(got_.tolist())) == 4 and (got_ >= 0).all()
    assert got_.tolist() == [curve_places(np.array([k]), np.array(d, np.uint32), np.array([len(d)]))[0] for k, d in enumerate(docs)]
    assert curve_places(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)).size == 0


def test_maxent_tells_rare_words_apart_by_what_they_follow(spark):
    """Words beyond the most frequent ones, all of one class: in an order seen in training they score above the same words the other way round."""
    from loomgrid.llm import op08_maxent as op

    frequent, rare = [f"a{i}" for i in range(op.TOP)], [f"w{i}zz" for i in range(200)]  # two last bytes make the class
    texts_ = [" ".join(frequent[i : i + 512] * 3) for i in range(0, op.TOP, 512)] + [" ".join(rare)]
    train = [i for i in range(100) if zlib.crc32(b"%d" % i) % 7 != 2][: len(texts_)]
    held = [i for i in range(100) if zlib.crc32(b"%d" % i) % 7 == 2][:2]
    asked = [" ".join(rare[50:100]), " ".join(rare[50:100][::-1])]
    rows = {r["doc_id"]: r for r in op.scored(spark.createDataFrame([*zip(train, texts_), *zip(held, asked)], "doc_id long, text string")).collect()}
    seen, unseen = (rows[i] for i in held)
    assert seen["held_out"] and unseen["held_out"] and seen["n_known"] == unseen["n_known"] == 51
    assert seen["score"] > unseen["score"] + 10


def test_maxent_pairs_and_triples_add_up_to_one():
    from loomgrid.llm.op08_maxent import blended

    rng = np.random.default_rng(1)
    v = 12
    q = rng.dirichlet(np.ones(v))
    triple = rng.integers(0, 4, v)
    pair = triple + rng.integers(0, 4, v)
    # texts u v w for each w: n(v) is the sum over pairs, n(u v) that over triples
    column = lambda first, second, last: np.stack([np.full(v, first), np.full(v, second), last], 1).ravel()
    got_ = blended(column(-1, -1, np.log10(q)), column(9, pair.sum(), np.ones(v, int)), column(1, triple.sum(), pair), column(1, 1, triple), np.full(v, 3))
    assert (10 ** got_.reshape(-1, 3)[:, 2]).sum() == pytest.approx(1)


def test_labels_of_other_documents_do_not_use_up_the_sample(spark):
    from loomgrid.llm.op05_toxicity import learned

    docs = spark.createDataFrame([(i, f"plain words {i} " + ("grolm" if i % 8 == 0 else "again")) for i in range(400)], "doc_id long, text string")
    labels = spark.range(40_000).selectExpr("id as doc_id", "0 as quality", "int(id % 8 = 0) as toxic")
    models, _ = learned(docs, labels, 5, 0, 400, "text", "doc_id")
    assert models.words[0].size


def test_all_expressions_that_differ_are_kept(spark):
    """With few toxic documents a single one's expressions all differ, however many they are."""
    from loomgrid.llm.op05_toxicity import learned

    ids = [i for i in range(200) if zlib.crc32(b"%d" % i) % 5 > 1][:60]
    n = (1 << 18) + 5000
    docs = spark.createDataFrame([(i, " ".join(map("x{}".format, range(n))) if i == ids[0] else f"plain words {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, toxic int")
    models, _ = learned(docs, labels, 5, 0, 400, "text", "doc_id")
    assert models.words[0].size >= n


def test_products_recall_on_the_table(spark):
    """All queries of sf0.1 against brute force: at least 0.95 of the nearest are found, each with its exact score."""
    from loomgrid.llm.queries import op6_anisotropic_mips

    sf = "/root/testdata/sf0.1"
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = {}
    for r in op6_anisotropic_mips(spark, sf).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]].tolist()) & set(found[ids[k]]))
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.95 * 20 * len(found)
