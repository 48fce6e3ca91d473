"""The toxicity models against Kneser-Ney models written out word by word."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest


class Brute:
    """P_c(w | v) from dictionaries, by the formulas alone."""

    def __init__(self, texts, toxic, z, d, stem, edge):
        self.split = lambda t: [w for x in t.encode().lower().split() if (w := x.strip(edge))]
        self.stem = lambda w: w[:stem]
        contexts, words, stems, docs, tokens = defaultdict(set), Counter(), Counter(), Counter(), Counter()
        for t, c in zip(texts, toxic):
            w = self.split(t)
            docs[c] += 1
            tokens[c] += len(w)
            for k, x in enumerate(w):
                contexts[c, w[k - 1] if k else None, x].add(w[k - 2] if k > 1 else None)
            words.update((c, x) for x in set(w))
            stems.update((c, x) for x in {x[:stem] for x in w})
        pairs = Counter({k: len(x) for k, x in contexts.items()})
        total = lambda counts: {c: max(1, sum(n for k, n in counts.items() if k[0] == c)) for c in (0, 1)}
        self.vocabulary = {w for _, w in words}
        self.heads = Counter()
        for (c, v, _), n in pairs.items():
            self.heads[c, v] += n

        def discounted(counts, share):
            out = {}
            for k in {k[1:] for k in counts}:
                n = [counts[(c, *k)] for c in (0, 1)]
                e = sum(n) * share
                if abs(n[1] - e) >= z * math.sqrt(max(e * (1 - share), 1e-9)):
                    out.update({(c, *k): max(n[c] - d, 0) for c in (0, 1)})
            return out

        by_docs = docs[1] / sum(docs.values())
        self.d = [discounted(pairs, tokens[1] / sum(tokens.values())), discounted(words, by_docs), discounted(stems, by_docs)]
        self.n, self.m = total(words), total(stems)
        self.g = {c: 1 - sum(x for k, x in self.d[1].items() if k[0] == c) / self.n[c] for c in (0, 1)}
        self.h = {c: 1 - sum(x for k, x in self.d[2].items() if k[0] == c) / self.m[c] for c in (0, 1)}
        self.left = {(c, v): 1 - sum(x for k, x in self.d[0].items() if k[:2] == (c, v)) / max(1, n) for (c, v), n in self.heads.items()}
        self.counts = Counter()
        for (_, w), k in words.items():
            self.counts[w] += k
        self.mass = Counter()
        for w, k in self.counts.items():
            self.mass[w[:stem]] += k
        self.whole = sum(self.mass.values()) + len(self.mass) + 1
        self.base = math.log(self.g[1] * self.h[1]) - math.log(self.g[0] * self.h[0])

    def p(self, c, v, w, stem):
        """Of a word; None for those never seen, whose stem is given, or None for those of new stems."""
        n, t = self.counts[w] if w is not None else 1, self.mass[stem]
        shared = (t + 1) / self.whole
        by_stem = self.d[2].get((c, stem), 0) / self.m[c] + self.h[c] * shared
        by_word = self.d[1].get((c, w), 0) / self.n[c] + self.g[c] * by_stem * n / (t + 1)
        return self.d[0].get((c, v, w), 0) / max(1, self.heads[c, v]) + self.left.get((c, v), 1) * by_word

    def total(self, text):
        w = self.split(text)
        seen = [(x if x in self.vocabulary else None, self.stem(x)) for x in w]
        return sum(math.log(self.p(1, w[k - 1] if k else None, x, s)) - math.log(self.p(0, w[k - 1] if k else None, x, s)) - self.base for k, (x, s) in enumerate(seen))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 11))) for _ in range(150)]
    rows = []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 50))]
        bad = i % 5 == 0
        for _ in range(4 * bad):
            w[rng.randrange(len(w) + 1) : 0] = rng.choice([["grolm!"], ["snuffles"], ["snuffle,"], ["kind", "vrakk"], ["--"]])
        rows.append((i, " ".join(w), int(bad)))
    rows += [(500 + i, rows[5][1], 1) for i in range(20)]  # copies of one text
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_models_are_kneser_ney(spark, corpus, monkeypatch, parts):
    from loomgrid.llm import op05_toxicity as op

    monkeypatch.setattr(op, "ZS", (2.5,))
    df = spark.createDataFrame(corpus, "doc_id long, text string, toxic int").repartition(parts)
    models, curve = op.learned(df.select("doc_id", "text"), df.select("doc_id", "toxic"), 5, 0, 10_000, "text", "doc_id")
    own = {}
    for i, t, y in corpus:
        if zlib.crc32(b"%d" % i) % 5 > 1:
            own.setdefault(t, y)
    brute = Brute(list(own), list(own.values()), 2.5, op.D, op.STEM, op.EDGE)
    assert models.pairs[0].size and models.words[0].size and models.stems[0].size
    asked = [t for _, t, _ in corpus] + ["", "grolm never seen", "snufflet kind vrakk kind", "--"]
    for t in asked:
        word, stem, sizes = op.words_of([t.encode()])
        assert float(models.ratios(word, stem, sizes).sum()) == pytest.approx(brute.total(t), abs=1e-9)
    word, stem, sizes = op.words_of([t.encode() for t in asked])  # many texts at once
    together = np.bincount(np.repeat(np.arange(sizes.size), sizes), weights=models.ratios(word, stem, sizes), minlength=sizes.size)
    assert together == pytest.approx([brute.total(t) for t in asked], abs=1e-9)
    x = models.features([t.encode() for t in asked])
    n = np.maximum([len(brute.split(t)) for t in asked], 1)
    want = np.array([brute.total(t) for t in asked])
    assert x[:, 0] == pytest.approx(np.sign(want) * np.log1p(50 * np.abs(want) / n), abs=1e-9)
    # each history's likelihoods add up to 1, with a word never seen of each stem and one of a new stem
    for c in (0, 1):
        for v in [None, b"grolm", b"kind", *list(brute.vocabulary)[:10], b"new"]:
            seen = sum(brute.p(c, v, w, brute.stem(w)) for w in brute.vocabulary)
            assert seen + sum(brute.p(c, v, None, s) for s in brute.mass) + brute.p(c, v, None, None) == pytest.approx(1)


def test_z_is_chosen_without_the_held_out_labels(spark, corpus):
    """With the values as shipped: the models are those of the chosen Z, which does best on one fold outside the held-out one; other labels of the held-out fold change nothing."""
    from loomgrid.llm import op05_toxicity as op

    df = spark.createDataFrame(corpus, "doc_id long, text string, toxic int").repartition(3)
    models, curve = op.learned(df.select("doc_id", "text"), df.select("doc_id", "toxic"), 5, 0, 10_000, "text", "doc_id")
    fold = lambda i: zlib.crc32(b"%d" % i) % 5
    own, tuned = {}, {}
    for i, t, y in corpus:
        if fold(i) > 1:
            own.setdefault(t, y)
        elif fold(i) == 1:
            tuned[i] = (t, y)
    found = {}
    for z in op.ZS:
        brute = Brute(list(own), list(own.values()), z, op.D, op.STEM, op.EDGE)
        n = [max(1, len(brute.split(t))) for t, _ in tuned.values()]
        total = np.array([brute.total(t) for t, _ in tuned.values()])
        x = np.sign(total)[:, None] * np.log1p(np.abs(total)[:, None] * np.stack([50 / np.array(n), 1 / np.sqrt(n)], 1))
        half = op.mix(np.array(list(tuned), np.uint64)) >> np.uint64(63)
        found[z] = round(op._halves(x, np.array([y for _, y in tuned.values()], float), half), 6)
    assert models.z in op.ZS and found[models.z] == pytest.approx(max(found.values()), abs=1e-5)
    brute = Brute(list(own), list(own.values()), models.z, op.D, op.STEM, op.EDGE)
    for t in list(own)[:100]:
        word, stem, sizes = op.words_of([t.encode()])
        assert float(models.ratios(word, stem, sizes).sum()) == pytest.approx(brute.total(t), abs=1e-9)
    other = spark.createDataFrame([(i, t, 1 - y if fold(i) == 0 else y) for i, t, y in corpus], "doc_id long, text string, toxic int")
    again, same = op.learned(other.select("doc_id", "text"), other.select("doc_id", "toxic"), 5, 0, 10_000, "text", "doc_id")
    assert again.z == models.z and same.tolist() == curve.tolist()


@pytest.mark.parametrize("share", [10, 80])
def test_stage_keeps_what_nothing_speaks_against(spark, share):
    """Whatever share of the labels is toxic: texts with a toxic expression go; null, empty, unknown and clean ones stay."""
    from loomgrid.llm.op05_toxicity import toxicity, without_toxic

    rng = random.Random(share)
    plain = lambda: " ".join(f"word{rng.randrange(60)}" for _ in range(12))
    bad = {i: rng.random() * 100 < share for i in range(3000)}
    rows = [(i, plain() + (" grolm snuffles vrakk" if bad[i] else " fine kindly calm"), "x", 1) for i in bad]
    odd = [(None, None, "x", 1), (None, "", "y", 2), (-1, None, "x", 1), (-2, "", "x", 1), (-3, "zzz qqq", "x", 1), (-4, "...", "x", 1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, _other string, __id int")
    labels = spark.createDataFrame([(i, int(b)) for i, b in bad.items()], "doc_id long, toxic int")
    kept = without_toxic(df, labels)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter(odd + [r for r in rows if not bad[r[0]]])
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity(df, labels).where("doc_id >= 0").collect()}
    assert predicted == {i: int(b) for i, b in bad.items()}
    assert without_toxic(df, labels.where("false")).collect() == df.collect()


def test_labels_of_one_class_speak_for_nothing(spark):
    from loomgrid.llm.op05_toxicity import without_toxic

    df = spark.createDataFrame([(i, f"word{i % 7} grolm" if i % 3 else None) for i in range(60)], "doc_id long, text string")
    for label in (0, 1):
        labels = spark.createDataFrame([(i, label) for i in range(60)], "doc_id long, toxic int")
        assert without_toxic(df, labels).count() == 60
