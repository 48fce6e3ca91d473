import numpy as np
import pytest

from loomgrid.operators import arrays, blocks

RNG = np.random.default_rng(3)


def frame(spark, x):
    i, j = np.indices(x.shape)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": x.ravel()}))


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("size", [3, 5, 16])
def test_blocks_do_not_depend_on_their_size(spark, size):
    x, y = RNG.random((11, 9)), RNG.random((9, 7))
    bx, by = blocks.blocked(frame(spark, x), 11, 9, size), blocks.blocked(frame(spark, y), 9, 7, size)
    assert np.allclose(dense(blocks.long_form(bx, size), x.shape), x)
    assert np.allclose(dense(blocks.long_form(blocks.dot(bx, by), size), (11, 7)), x @ y)


@pytest.mark.parametrize("size", [4, 10])
def test_transpose_sum(spark, size):
    x = RNG.random((10, 10))
    want = (x + x.T).sum()
    assert arrays.transpose_sum(frame(spark, x)).first()[0] == pytest.approx(want)
    assert blocks.transpose_sum(blocks.blocked(frame(spark, x), 10, 10, size)).first()[0] == pytest.approx(want)


def mean_filter(x, k):
    wide = np.pad(x, k, mode="symmetric")
    n, m = x.shape
    return sum(wide[a : a + n, b : b + m] for a in range(2 * k + 1) for b in range(2 * k + 1)) / (2 * k + 1) ** 2


@pytest.mark.parametrize("k, size", [(1, 4), (1, 13), (2, 5), (2, 13), (3, 6)])
def test_mean_filter(spark, k, size):
    x = RNG.random((13, 11)) if k < 3 else RNG.random((12, 12))
    long = frame(spark, x)
    got = blocks.stencil(blocks.blocked(long, *x.shape, size), blocks.mean_kernel(k), *x.shape, size)
    assert np.allclose(dense(blocks.long_form(got, size), x.shape), mean_filter(x, k))


@pytest.mark.parametrize("shape, size", [((5, 3), 2), ((5, 3), 4), ((5, 3), 50), ((1, 7), 3), ((9, 1), 2), ((1, 1), 5), ((11, 15), 3), ((27, 23), 4)])
def test_stencil_of_any_kernel_and_block(spark, shape, size):
    """Against shifted copies of the mirrored array; halos may span several blocks, or the whole array."""
    x, kernel = RNG.random((13, 11)), RNG.standard_normal(shape)
    h, w = shape[0] // 2, shape[1] // 2
    wide = np.pad(x, ((h, h), (w, w)), mode="symmetric")
    want = sum(kernel[a, b] * wide[2 * h - a : 2 * h - a + 13, 2 * w - b : 2 * w - b + 11] for a in range(shape[0]) for b in range(shape[1]))
    got = blocks.stencil(blocks.blocked(frame(spark, x), 13, 11, size), kernel, 13, 11, size)
    assert np.allclose(dense(blocks.long_form(got, size), x.shape), want)


def test_stencil_says_what_it_cannot_do(spark):
    x = blocks.blocked(frame(spark, RNG.random((3, 3))), 3, 3, 2)
    for kernel in (np.ones((2, 3)), np.ones(3), np.ones((9, 1))):
        with pytest.raises(ValueError):
            blocks.stencil(x, kernel, 3, 3, 2)


def test_blocks_from_vectors(spark):
    x = RNG.random((23, 7))
    got = blocks.from_vectors(vectors(spark, x).repartition(4), "id", "v", 7, 4)
    assert got.count() == 12 and np.allclose(dense(blocks.long_form(got, 4), x.shape), x)


def test_product_over_a_cube(spark):
    """One inner block still gives work to all slots, and what is copied is bounded."""
    assert blocks.cells(64, 1, 1, 8, 256) == (8, 1, 1) and blocks.cells(1, 1, 64, 8, 256)[2] == 8 and blocks.cells(1, 1, 1, 8, 256) == (1, 1, 1)
    gi, gj, gk = blocks.cells(1000, 1000, 1000, 8, 256)
    assert max(-(-1000 // gi) * -(-1000 // gk), -(-1000 // gk) * -(-1000 // gj)) <= 256
    x, y = RNG.random((40, 5)), RNG.random((5, 9))
    bx, by = blocks.blocked(frame(spark, x), 40, 5, 5), blocks.blocked(frame(spark, y), 5, 9, 5)
    out = blocks.dot(bx, by, slots=8)
    assert out.rdd.getNumPartitions() == 8 and np.allclose(dense(blocks.long_form(out, 5), (40, 9)), x @ y)
    for most in (1, 2, 7):
        x, y = RNG.random((11, 17)), RNG.random((17, 7))
        got = blocks.dot(blocks.blocked(frame(spark, x), 11, 17, 3), blocks.blocked(frame(spark, y), 17, 7, 3), slots=3, most=most)
        assert np.allclose(dense(blocks.long_form(got, 3), (11, 7)), x @ y)
    with pytest.raises(ValueError, match="inner"):
        blocks.dot(bx, bx)
    assert blocks.dot(bx.where("false"), by).count() == 0


def test_svd(spark):
    x = RNG.standard_normal((200, 6))
    got = [r["s"] for r in blocks.singular_values(vectors(spark, x).repartition(9), "v", 6, fan_in=2).orderBy("k").collect()]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(got, s)


def whole(f, n):
    u = np.zeros((n, len(f.s)))
    for r in f.u.collect():
        u[r["i"]] = r["u"]
    return u, f.vt.orderBy("k", "j").toPandas()["v"].to_numpy().reshape(len(f.s), -1)


@pytest.mark.parametrize("worst", [1.0, 1e-9, 1e-15, 0.0])
def test_full_svd_is_orthogonal_however_badly_conditioned(spark, worst):
    n, d = 300, 6
    base = np.linalg.qr(RNG.standard_normal((n, d)))[0] * np.linspace(1, worst, d) @ np.linalg.qr(RNG.standard_normal((d, d)))[0]
    for parts, fan_in, rows in ((1, 8, None), (30, 3, 4), (9, 2, 7))[2 * (worst != 1e-9) :]:
        f = blocks.svd(vectors(spark, base).repartition(parts), "id", "v", d, fan_in=fan_in, rows_each=rows)
        u, vt = whole(f, n)
        assert abs(u.T @ u - np.eye(d)).max() < 1e-12 and abs(vt @ vt.T - np.eye(d)).max() < 1e-12
        assert abs((u * f.s) @ vt - base).max() < 1e-13 and np.allclose(f.s, np.linalg.svd(base, compute_uv=False), atol=1e-14)
        cells = dense(blocks.rebuilt(f), base.shape)
        assert np.allclose(cells, base, atol=1e-13)


def test_full_svd_of_few_rows_or_none(spark):
    x = RNG.standard_normal((3, 5))
    f = blocks.svd(vectors(spark, x), "id", "v", 5)
    u, vt = whole(f, 3)
    assert len(f.s) == 3 and np.allclose((u * f.s) @ vt, x)
    none = blocks.svd(vectors(spark, x).where("false"), "id", "v", 5)
    assert none.u.count() == 0 and none.vt.count() == 0 and blocks.rebuilt(none).count() == 0


def test_fft(spark):
    x = RNG.standard_normal((5, 12))
    want = np.fft.fft(x.T, axis=0)
    for r in blocks.fft(vectors(spark, x), "id", "v").collect():
        assert complex(r["re"], r["im"]) == pytest.approx(want[r["i"], r["j"]])


@pytest.mark.parametrize("n, most", [(1, 4), (2, 4), (12, 4096), (30, 4), (97, 4096), (97, 4), (64, 2), (3, 1)])
def test_fft_along_the_rows(spark, n, most):
    """By factors, or by a chirp where there are none, with rows that are missing."""
    from loomgrid.operators import fourier

    x = RNG.standard_normal((n, 3))
    df = vectors(spark, x).repartition(4)
    if n == 30:
        x[7] = 0
        df = df.where("id <> 7").unionByName(spark.createDataFrame([(99, [1.0] * 3), (3, [1.0]), (None, [1.0] * 3)], "id long, v array<double>"))
    got = np.full((n, 3), np.nan, complex)
    for r in fourier.fft_rows(df, "id", "v", n, 3, most).collect():
        got[r["i"], r["j"]] = complex(r["re"], r["im"])
    assert np.allclose(got, np.fft.fft(x, axis=0))


def test_long_form_operators(spark):
    x, y = RNG.normal(10, 1, 40), RNG.normal(10, 1, 40)
    col = lambda v: spark.createDataFrame([(k, float(a)) for k, a in enumerate(v)], "i long, v double")
    get = lambda df: [r["v"] for r in df.orderBy("i").collect()]
    assert get(arrays.added(col(x), col(y))) == pytest.approx(list(x + y))
    assert get(arrays.masked(col(x), col(y), 10)) == pytest.approx(list(x[y > 10]))
    index = [3, 3, 39, 0]
    assert get(arrays.gathered(col(x), spark.createDataFrame(list(enumerate(index)), "i long, v long"))) == pytest.approx(list(x[index]))
    m = RNG.random((8, 3))
    assert np.allclose(dense(arrays.every(frame(spark, m), 3), (3, 3)), m[::3])
    assert arrays.total(frame(spark, m)).first()[0] == pytest.approx(m.sum())
    assert arrays.mean(frame(spark, m)).first()[0] == pytest.approx(m.mean())
