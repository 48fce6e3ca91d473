"""The language model: equal scores however the table is dealt, and gains over the base on held-out texts."""

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def scores(df):
    from loomgrid.llm.op08_maxent import scored

    return {r["doc_id"]: r for r in scored(df).collect()}


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = scores(docs.repartition(1)), scores(docs.repartition(7))
    assert len(one) > 100 and one == many  # to the last bit
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_packs_of_tokens_keep_hashes_and_places():
    from loomgrid.llm import op08_maxent as op

    texts = [b"a b a c d", b"", b"b e f g a a"]
    words, of, sizes = op.Tokens().of(texts)
    ids, n, w, at = op.pack_tokens(op.token_pack(np.arange(3), texts))
    assert n.tolist() == sizes.tolist() and w[at].tolist() == words[of].tolist()
    for k in (6, 8):
        assert op.unhashed(*op.hashed(w, 3, k), k).tolist() == (w >> np.uint64(64 - 8 * k) << np.uint64(64 - 8 * k)).tolist()
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 99).astype(np.uint64))
    assert op.unkeyed(op.keyed(keys)).tolist() == (keys >> np.uint64(24)).tolist()
    assert op.unkeyed(op.keyed(keys[:0])).size == 0


def test_rounds_go_uphill():
    """On text of one kind each round raises the likelihood of the classes."""
    from loomgrid.llm import op08_maxent as op

    rng = np.random.default_rng(0)
    words = np.arange(60, dtype=np.uint64) << np.uint64(32)
    w = np.concatenate([[a, (a * 7 + 3) % 60, (a * 5) % 60] for a in rng.integers(0, 60, 2000)]).astype(np.uint16)
    sizes = np.full(w.size // 20, 20)
    counts = np.bincount(w, minlength=60).astype(float)
    mass = np.bincount((words & np.uint64(op.TAIL - 1)).astype(np.int64), weights=counts + 1, minlength=op.TAIL)
    m = op.Model(words, counts, mass)
    assert (m.tail_mass == 1).all()
    m.start(np.ones((op.BEFORE + 2 + op.TAIL, 60 + op.TAIL)))
    last = m.chances(w, sizes).mean()
    assert np.isfinite(m.chances(w, sizes)).all()
    for _ in range(4):
        sums = [np.zeros(x.shape, np.int64) for x in 2 * [m.A, m.B, m.T]]
        m.occurrences(w, sizes, sums)
        assert sum(x.sum() for x in sums[:3]) == 3 * w.size
        m.move(sums)
        now = m.chances(w, sizes).mean()
        assert now > last
        last = now


def test_expectations_once_for_each_context(monkeypatch):
    """Sums are those of every token; the weights of a context are worked out once."""
    from loomgrid.llm import op08_maxent as op

    rng = np.random.default_rng(0)
    words = np.arange(50, dtype=np.uint64) << np.uint64(32)
    w, sizes = rng.integers(0, 50 + 1 + op.TAIL, 9000), np.full(90, 100)
    w[w == 50] = 0
    m = op.Model(words, np.arange(50.0, 0, -1), np.full(op.TAIL, 2000.0))
    m.start(rng.integers(0, 9, (op.BEFORE + 2 + op.TAIL, 50 + op.TAIL)).astype(float))
    for x in (m.A, m.B, m.T):
        x += rng.standard_normal(x.shape).astype(np.float32)
    w[:4500] = w[4500:]
    keys, c = m.contexts(w, sizes), m.classes(w)
    x = m.weights(*keys)
    x -= x.max(axis=1, keepdims=True)
    own, e = x[np.arange(w.size), c].copy(), np.exp(x)
    g = np.rint(e * (op.UNIT / e.sum(axis=1, keepdims=True))).astype(np.int64)
    want = [np.zeros(y.shape, np.int64) for y in 2 * [m.A, m.B, m.T]]
    for k, met, expected in zip(keys, want, want[3:]):
        np.add.at(met, (k, c), 1)
        np.add.at(expected, k, g)
    rows, weights = [], op.Model.weights
    monkeypatch.setattr(op.Model, "weights", lambda self, *k: rows.append(k[0].size) or weights(self, *k))
    got = [np.zeros_like(y) for y in want]
    m.occurrences(w, sizes, got)
    distinct = len(set(zip(keys[0].tolist(), keys[1].tolist())))
    assert all((a == b).all() for a, b in zip(got, want)) and sum(rows) == distinct < w.size
    share = np.log(np.concatenate([np.maximum(m.class_mass, 1), m.tail_mass]))[c]
    assert m.chances(w, sizes) == pytest.approx((own - np.log(e.sum(axis=1)) - share) / np.log(10), abs=1e-6) and sum(rows) == 2 * distinct


@pytest.mark.parametrize("tasks", [1, 40, 1100])
def test_sums_as_a_tree(spark, tasks):
    from loomgrid.llm.common import MAIL, blob, mail
    from loomgrid.llm.op08_maxent import _summed

    def send(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield mail([(i % 2, i, blob(np.array([i, 1, 2**40])))])

    got = _summed(spark.range(tasks).mapInArrow(send, MAIL), tasks)
    for k in {i % 2 for i in range(tasks)}:
        own = range(k, tasks, 2)
        assert got[k].tolist() == [sum(own), len(own), len(own) * 2**40]
