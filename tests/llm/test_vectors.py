"""Whitening and integer codes against plain numpy over the whole table, and on awkward rows."""

import hashlib
import math

import numpy as np
import pytest


def table(spark, rows, extra="label int"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>, {extra}")


def plain_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    """{(vec_id, x): (code, error)}, label errors and the hash, row by row."""
    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda x, p: np.array(x[p * width : (p + 1) * width], dtype=object)
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (((x - book[e]) ** 2).sum(), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(cut(x, p), books[p]) for _, x, _ in kept]
            for e in set(of):
                own = [cut(x, p) for (_, x, _), f in zip(kept, of) if f == e]
                books[p][e] = sum(own) // len(own)
    out, labels = [], {}
    for i, x, label in kept:
        at = [near(cut(x, p), books[p]) for p in range(parts)]
        error = int(sum(((cut(x, p) - books[p][e]) ** 2).sum() for p, e in enumerate(at)))
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in at), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, c, e, labels[label], sha) for i, c, e, label in out], key=repr)


def test_codes_equal_plain_ones(spark, monkeypatch):
    """With 16 entries, so that they compete and some stay unused; the whole table's test has 256."""
    from loomgrid.llm import op13_codes
    from loomgrid.llm.op13_codes import coded

    monkeypatch.setattr(op13_codes, "ENTRIES", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.3, np.repeat(rng.normal(size=(3, 8)), 40, 0)])
    rows = [(k if k % 97 else None, v.tolist(), k % 3 if k % 5 else None) for k, v in enumerate(x)]
    rows += [(7, [0.5] * 8, 1), (7, [0.25] * 8, 1), (7, [0.25] * 8, 1), (1000, None, 1), (1001, [0.1] * 7 + [None], 1), (1002, [0.1] * 7 + [float("nan")], 2), (1003, [float("-inf")] + [0.1] * 7, 2)]
    want = plain_codes(rows, entries=16)
    for parts in (1, 5):
        got = coded(table(spark, rows).repartition(parts))
        assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == want


def test_codes_of_the_table(spark, sf):
    """All rows of the embeddings, by matrices instead of row by row."""
    from loomgrid.llm.queries import op13_integer_codes

    rows = sorted((r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    x = np.floor(1024 * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64).reshape(len(rows), 4, -1)
    books = x[:256].copy()
    far = lambda: ((x[:, None] - books[None]) ** 2).sum(-1)
    for _ in range(4):
        at = far().argmin(1)
        for p in range(4):
            for e in np.unique(at[:, p]):
                books[e, p] = x[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    d = far()
    at, error = d.argmin(1), d.min(1).sum(1)
    sha = hashlib.sha256(",".join(map(str, books.swapaxes(0, 1).ravel().tolist())).encode()).hexdigest()
    label = np.array([r[2] for r in rows])
    want = [(r[0], bytes(a.tolist()).hex(), int(e), int(error[label == r[2]].sum()), sha) for r, a, e in zip(rows, at, error)]
    assert sorted(map(tuple, op13_integer_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == want


def test_codes_edges(spark):
    from loomgrid.llm.op13_codes import coded, nearest

    rows = [(1, [0.5, -0.5, 0.25], 1), (2, [0.5] * 8, 1), (3, [], 2), (4, [1e300] * 8, 2), (None, [0.5] * 8, None)]
    df = table(spark, rows).selectExpr("*", "1 as id", "'x' as mark", "array(1) as x", "2 as error")
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded(df).collect()}
    assert got == {(1, "00000000", 0, 0), (2, "00000000", 0, 0), (3, "00000000", 0, 0), (None, "00000000", 0, 0)}
    assert coded(df.where("false")).count() == 0
    big = np.array([[2**31 - 2] * 4, [-(2**31)] * 4])
    entry, least = nearest(big, big[::-1])
    assert entry.tolist() == [1, 0] and least.tolist() == [0, 0] and nearest(big[:1], big[1:])[1].tolist() == [4 * (2**32 - 2) ** 2]


def plain_whitening(x):
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], v[:, ::-1].T


def compare(rows, ids, x, fit, top=4):
    n, s, e, v = plain_whitening(fit)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(ids)
    for k in range(min(top, x.shape[1])):
        want = (x - s / n) @ v[k] / np.sqrt(e[k])
        got = np.array([by[i][k + 1]["whitened"] for i in ids])
        assert min(abs(got - want).max(), abs(got + want).max()) < 1e-8
    for i, row in zip(ids, x):
        assert len(by[i]) == min(top, x.shape[1])
        for k, r in by[i].items():
            assert r["n"] == n and r["deviation"] == sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s))
            assert r["explained"] == pytest.approx(e[k - 1] / e.sum(), rel=1e-9) and 0 <= r["identity_error"] < 1e-9


def test_whitening_equals_eigenvectors(spark):
    from loomgrid.llm.op12_whitening import whitened

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 7)) * [3, 2, 1.5, 1, 0.5, 0.2, 0.1] + [100, -50, 0, 3, 0, 0, 0]
    x[1000:2000] = x[999]  # a third of all rows is one vector, which counts once
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    whole = np.floor(256 * x).astype(np.int64)
    fit = np.unique(whole, axis=0)
    for parts in (1, 20):
        compare(whitened(table(spark, rows + [(9000, None, 0), (9001, [float("inf")] * 7, 0), (9002, [None] * 7, 0)]).repartition(parts)).collect(), range(3000), whole, fit)


def test_whitening_of_the_table(spark, sf):
    from loomgrid.llm.queries import op12_svd_whitening

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    compare(op12_svd_whitening(spark, sf).collect(), [r["vec_id"] for r in rows], x, np.unique(x, axis=0))


def test_merging_loses_nothing():
    from loomgrid.llm.op12_whitening import described, merged

    x = np.random.default_rng(3).integers(-300, 300, (100, 9)) + np.arange(9) * 1000
    parts = [described(x[a:b]) for a, b in ((0, 3), (3, 40), (40, 41), (41, 100))]
    whole = merged(merged(parts[0], parts[1]), merged(parts[2], parts[3]))
    c = x - x.mean(0)
    assert whole.n == 100 and (whole.sums == x.sum(0)).all() and whole.vt.shape == (9, 9)
    assert np.allclose((whole.vt.T * whole.s**2) @ whole.vt, c.T @ c, rtol=1e-12)


def test_whitening_edges(spark):
    from loomgrid.llm.op12_whitening import whitened

    rows = [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (None, [1.0, 0.25], 1), (2, [0.125] * 3, 1), (3, [], 1), (4, None, 1), (5, [2.0**21] * 5, 1), (6, [-(2.0**21)] * 5, 1), (7, [1e300] * 5, 1)]
    df = table(spark, rows).selectExpr("*", "1 as id", "array(1) as x", "2 as n")
    got = whitened(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (2, 3)] + [(i, k) for i in (5, 6) for k in (1, 2, 3, 4)]
    for r in got:
        lone = r["vec_id"] == 2 or r["component"] > 1
        assert (r["whitened"] is None) == lone and r["n"] == (1 if r["vec_id"] == 2 else 2)
        assert r["whitened"] is None or abs(r["whitened"]) == pytest.approx(1)
    assert whitened(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["tight groups", "heavy tails", "several scales", "small"])
def test_products_that_codes_cant_tell_apart(spark, kind):
    """All of the nearest are found where codes err by more than products differ."""
    from loomgrid.llm.op06_anisotropic import nearest_products, usable

    rng = np.random.default_rng(3)
    normal = rng.standard_normal((6000, 8))
    x = {
        "tight groups": np.repeat(rng.standard_normal((6, 8)), 1000, 0) + 1e-3 * normal,
        "heavy tails": rng.standard_t(1.5, normal.shape),
        "several scales": normal * np.exp(8 * rng.standard_normal((6000, 1))),
        "small": normal * 1e-140,
    }[kind]
    rows = usable(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"))
    got = {}
    for r in nearest_products(rows, rows.where("id % 200 = 0")).collect():
        got[r["query_id"], r["rank"]] = r["vec_id"]
    for q in range(0, 6000, 200):
        score = (x * x[q]).sum(axis=1)
        want = [k for k in np.lexsort((np.arange(6000), -score)).tolist() if k != q][:20]
        assert [got[q, rank] for rank in range(1, 21)] == want
    assert len(got) == 20 * 30
