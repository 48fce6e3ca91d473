"""Every operator and stage over one awkward table: repeated and null ids, repeated rows, null and empty texts, a text over the size of a pack, and columns named like the operators' own."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, _other string, text string, __id long, __body binary, pack long, shard int, slot int, n_chars long, lang string, source string, class string, `a.b` int, score double"


def lines():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    vocab = [word() for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = words(90), words(30)
    near = base.split()
    near[50] = "zzz"
    rows = [(3, base), (5, " ".join(near)), (5, words(60)), (7, base + " more"), (None, words(40)), (None, None), (None, base), (9, ""), (9, ""), (11, None), (12, passage + " " + words(9)), (12, passage + " " + words(9)), (13, words(20)), (13, words(20))]
    rows += [(20, words(25))] * 4 + [(21, words(400_000))] + [(30 + i, words(rng.randint(1, 50))) for i in range(20)]
    assert max(len(t or "") for _, t in rows) > 1.5 * 2**20
    return rows


ROWS = lines()


def frame(spark, rows):
    return spark.createDataFrame([(i, "x", t, 1, b"y", 2, 3, 4, None if t is None else len(t), None, "hot", "z", 5, 0.5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


def ordered(rows):
    return Counter(map(tuple, rows))


def same(df, columns, want):
    assert ordered(df.select(*columns).collect()) == ordered(want)


def sets(t, k):
    w = (t or "").lower().split()
    return frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k, num):
    """Number of each row's group; rows without words are alone."""
    own, of = [sets(t, k) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= num * len(own[a] | own[b]):
                old, new = of[a], of[b]
                of = [new if x == old else x for x in of]
    return own, of


def least(ids):
    return min(ids, key=lambda i: -(2**63) if i is None else i)


def test_jaccard(docs):
    from loomgrid.llm.op09_jaccard import linked

    own, of = groups(ROWS, 3, 90)
    same(linked(docs), ["doc_id", "n_shingles", "component_id"], [(i, len(own[k]), least([j for (j, _), g in zip(ROWS, of) if g == of[k]])) for k, (i, _) in enumerate(ROWS)])


def kept_by_join():
    _, of = groups(ROWS, 5, 80)
    out, seen = [], set()
    for k in sorted(range(len(ROWS)), key=lambda k: -(2**63) if ROWS[k][0] is None else ROWS[k][0]):
        if not (ROWS[k][1] or "").split() or of[k] not in seen:
            out.append(ROWS[k])
        if (ROWS[k][1] or "").split():
            seen.add(of[k])
    return out


def test_stages_keep_rows_and_columns(spark, docs, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = p.toxicity(spark, docs, str(tmp_path))
    assert at.schema == docs.schema and at.count() == len(ROWS)
    at = p.one_of_near_copies(spark, docs, str(tmp_path))
    assert at.schema == docs.schema
    same(at, ["doc_id", "text"], kept_by_join())
    assert {tuple(r[c] for c in ("_other", "__id", "pack", "shard", "slot", "class", "score")) for r in at.select("_other", "__id", "pack", "shard", "slot", "class", "score").collect()} == {("x", 1, 2, 3, 4, "z", 0.5)}
    cut = p.without_repeats(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns
    rows = cut.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS) and sum(r["text"] is None for r in rows) == sum(t is None for _, t in ROWS)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert sum(len(r["text"] or "") for r in rows if r["doc_id"] == 20) < 2 * len(ROWS[14][1])
    for stage in (p.toxicity, p.one_of_near_copies, p.without_repeats):
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_suffixes(docs):
    """Rows of equal ids have no order of their own: what goes is the same, but not from which of them."""
    from loomgrid.llm.op07_suffix_dedup import repeats

    out = repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in out) == Counter((i, len(t or "")) for i, t in ROWS)
    unique = [(i, t) for i, t in ROWS if Counter(j for j, _ in ROWS)[i] == 1]
    got = {r["doc_id"]: r for r in out}
    earlier = lambda i: [t or "" for j, t in ROWS if (-(2**63) if j is None else j) < i]
    for i, t in unique:
        if t and len(t) < 5000:
            gone, before = bytearray(len(t)), "\0".join(earlier(i))
            for s in range(len(t) - 99):
                if t[s : s + 100] in before or t.find(t[s : s + 100]) < s:
                    gone[s : s + 100] = b"\1" * 100
            assert got[i]["n_removed"] == sum(gone), i
            assert got[i]["kept_sha256"] == hashlib.sha256(bytes(x for x, g in zip(t.encode(), gone) if not g)).hexdigest()
    assert sorted(r["n_removed"] for r in out if r["doc_id"] == 20) == [0] + [len(ROWS[14][1])] * 3


@pytest.mark.parametrize("slice_", [1024, 8])
def test_bpe_and_packing(docs, monkeypatch, slice_):
    from loomgrid.llm import op10_packing
    from loomgrid.llm.op04_bpe import round_trip
    from loomgrid.llm.op10_packing import packed

    monkeypatch.setattr(op10_packing, "SLICE", slice_)
    t = Tokenizer.from_file(BYTE)
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x in ROWS]
    raw = lambda x: np.array(x, "<u4").tobytes()
    same(round_trip(docs, BYTE), ["doc_id", "n_tokens", "ids_sha256"], [(i, len(x), hashlib.sha256(raw(x)).hexdigest()) for (i, _), x in zip(ROWS, ids)])
    rows = packed(docs, BYTE, length=2048).collect()
    whole = Counter((i, len(x) + 1) for (i, _), x in zip(ROWS, ids))
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == whole and sum(r["length"] for r in rows) == sum(len(x) + 1 for x in ids)
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert sum(n != 2048 for n in fill.values()) <= 1
    long = [x + [1] for (i, _), x in zip(ROWS, ids) if i == 21][0]
    assert all(r["ids_crc32"] == zlib.crc32(raw(long[r["start"] : r["start"] + r["length"]])) for r in rows if r["doc_id"] == 21)
    # rows that repeat an id, with one text or several: each place of each row is in one piece, and each piece is of one of them
    by = {}
    for (i, _), x in zip(ROWS, ids):
        by.setdefault((i, len(x) + 1), []).append(x + [1])
    held = Counter((r["doc_id"], r["doc_tokens"], k) for r in rows if r["doc_id"] != 21 for k in range(r["start"], r["start"] + r["length"]))
    assert held == Counter({(i, n, k): len(x) for (i, n), x in by.items() if i != 21 for k in range(n)})
    assert all(any(r["ids_crc32"] == zlib.crc32(raw(x[r["start"] : r["start"] + r["length"]])) for x in by[r["doc_id"], r["doc_tokens"]]) for r in rows)


def brute_tree(rows, m):
    """Shards of rows (weight, keys) by the rule alone; keys are told apart, so that no row number is needed."""
    if m == 1 or not rows:
        return {r[-1]: 0 for r in rows}
    d = max(range(len(rows[0][1])), key=lambda d: (max(r[1][d] >> 32 for r in rows) - min(r[1][d] >> 32 for r in rows), -d))
    rows = sorted(rows, key=lambda r: r[1][d])
    sought, below, k = sum(r[0] for r in rows) * (m // 2) / m, 0, 0
    while k < len(rows) - 1 and below + rows[k][0] < sought:
        below += rows[k][0]
        k += 1
    k += not sought - below < below + rows[k][0] - sought
    left, right = brute_tree(rows[:k], m // 2), brute_tree(rows[k:], m - m // 2)
    return left | {i: s + m // 2 for i, s in right.items()}


@pytest.mark.parametrize("cell", [None, 40])
def test_tree_is_the_k_d_tree(spark, cell):
    from loomgrid.llm.op01_kd_shards import TOP, coordinate, kd_shards
    from pyspark.sql import functions as F

    rng = random.Random(2)
    meta = spark.createDataFrame([(i, rng.randint(1, 50), rng.choice(["a", "b", "c" * i, None]), rng.random() ** 4) for i in range(150)], "id long, w long, kind string, x double").repartition(3)
    dims = ["kind", "x", "id"]
    rows = meta.select("id", "w", F.shiftrightunsigned(F.xxhash64("id", "w", *dims), 32).alias("h"), *[coordinate(meta, d).alias(f"c{k}") for k, d in enumerate(dims)]).collect()
    spans = [(min(r[f"c{k}"] for r in rows), max(r[f"c{k}"] for r in rows)) for k in range(3)]
    keyed = [(r["w"], [int((r[f"c{k}"] - lo) / (hi - lo) * TOP) << 32 | r["h"] for k, (lo, hi) in enumerate(spans)], r["id"]) for r in rows]
    for m in (5, 8):
        got = kd_shards(meta, dims, "w", "id", shards=m, cell=cell).collect()
        assert {r["id"]: r["shard"] for r in got} == brute_tree(keyed, m)
    whole = sum(r["w"] for r in rows)
    got = kd_shards(meta, dims, "w", "id", target=whole // 6 + 1, cell=cell).collect()
    assert {r["shard"] for r in got} == set(range(6))


@pytest.mark.parametrize("cell", [None, 9])
def test_shards(spark, docs, cell):
    from loomgrid.llm.op01_kd_shards import sharded

    rows = sharded(docs, 4, cell=cell).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    alike = spark.createDataFrame([(None if i % 2 else 5, "x" * 34) for i in range(400)], "doc_id long, text string")
    got = Counter(r["shard"] for r in sharded(alike, 8, cell=cell and 30).collect())
    assert set(got.values()) == {50} and len(got) == 8


def test_scores(docs):
    from loomgrid.llm.op05_toxicity import toxicity
    from loomgrid.llm.op08_maxent import fold, scored
    from loomgrid.llm.common import NULL_ID

    labels = docs.sparkSession.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    out = toxicity(docs, labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    out = scored(docs).collect()
    held = {i: int(fold(np.array([NULL_ID if i is None else i]), 7)[0]) == 2 for i, _ in ROWS}
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in ROWS if not held[i] for w in words(t))
    want = Counter((i, held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), sum(c.values())) for i, t in ROWS)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out) == want and all(r["score"] < 0 for r in out)


def test_products_of_repeated_ids(spark):
    """A query's own row is left out, not the other rows of its id or with its vector."""
    from loomgrid.llm.op06_anisotropic import nearest_products, usable

    rng = np.random.default_rng(7)
    rows = [(20, v) for v in rng.standard_normal((30, 8)).tolist()] + [(100 + k, v) for k, v in enumerate(rng.standard_normal((100, 8)).tolist())]
    rows += [rows[0]] * 2 + [(21, rows[0][1]), (40, rows[50][1]), (40, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, q int, score double").repartition(3)
    own = usable(df)
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest_products(own, own.where("id % 20 = 0"), k=20).collect())
    want = Counter()
    for a, (q, x) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-round(float(np.dot(x, v)), 9), i) for b, (i, v) in enumerate(rows) if b != a)[:20]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(near))
    assert got == want and sum(want.values()) >= 34 * 20


def test_vectors(spark):
    from loomgrid.llm.op03_hamming import hamming_neighbours, sign_codes
    from loomgrid.llm.op06_anisotropic import nearest_products, usable

    rng = np.random.default_rng(1)
    lengths = [*range(1, 41), *range(200, 260, 20), 64, 64, 64]  # those of several lengths have codebooks of their own
    last = len(lengths) - 3
    rows = [(i, rng.standard_normal(n).tolist(), 1) for i, n in enumerate(lengths)] + [(last, [1.0] * 64, 2), (None, [1.0] * 64, 3), (5000, None, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q int").repartition(3)
    own = usable(df)
    assert own.count() == len(rows) - 2
    out = nearest_products(own, own.where(f"id in (30, {last + 1}, {last})")).collect()
    of = {}
    for r in out:
        of.setdefault(r["query_id"], []).append(r["vec_id"])
    assert 30 not in of and sorted(of[last + 1]) == [last, last, last + 2] and Counter(of[last]) == {last: 2, last + 1: 2, last + 2: 2}  # two rows have the id `last`; each has the other as a candidate
    codes = sign_codes(df)
    near = hamming_neighbours(codes, codes.where(f"id = {last}"), k=3).collect()
    assert len(near) == 6 and all(r["distance"] == 0 for r in near if r["rank"] == 1)
