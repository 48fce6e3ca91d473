"""Toxicity by class-conditional Kneser-Ney models: length-normalised toxic and ordinary log-likelihoods are compared.

A text is its words (lower case, outer punctuation off); a word's stem is its first STEM bytes. The likelihood of a word
w after v in class c (toxic or ordinary) is interpolated from pair to word to stem to counts that both classes share:

    P_c(w | v) = d_c(v w) / n_c(v .) + g_c(v) P_c(w)     g_c(v) = 1 - sum over w of d_c(v w) / n_c(v .)
    P_c(w)     = d_c(w) / n_c        + g_c Q_c(stem of w) P(w | stem)
    Q_c(s)     = d_c(s) / m_c        + h_c Q(s)          Q(s) = (T(s) + 1) / (T + S + 1),  P(w | s) = n(w) / (T(s) + 1)

Counts of pairs are continuation counts: the distinct words met before the pair, in documents of the class; so a passage
that is copied counts once. Counts of words and stems are documents of distinct texts. d is the discounted count: n - D
where the two classes' counts differ by Z standard deviations or more; elsewhere the whole count is discount, and its
mass goes to the back-off. Z is chosen among ZS by the labels outside the held-out fold alone: the models count all of
those but one fold, and of that fold one half after the other tells how well a curve fitted to its other half does (by
the sum of log-likelihoods; ties to the larger Z). n(w): documents of both classes; T(s): their sum over the stem's words; T, S: sums over all
stems, and their number; the 1's are for words never seen, of known and of new stems. For each history the likelihoods
of all words and of those never seen add up to 1 (tested).

A document's total is the sum of log P_1 - log P_0 over its words, less what a text of equal length without any
expression that differs gets. Its features are the total by length and by the root of the length, in logarithms, with
their signs; a logistic curve fitted to labelled documents that the models have not counted turns them into a score.

Labels are learned from at most SAMPLE labelled documents of the table outside the held-out fold, those of least hash.
What differs is few and bounded by the sample; it is all that goes to the tasks that score: other terms are equal in
both classes, and are never computed.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAIL, at_parts, blob, bodies, dropped, id_column, mail, mix, pack_list, packs, parts_for, text_rows, to_parts, unblob, written
from .op08_maxent import fold
from .words import MOST_WORDS, Numbered, ascii_words, per_worker

#: Labelled rows to learn from, discount, standard deviations that are tried, bytes of a stem.
SAMPLE, D, ZS, STEM = 40_000, 0.75, (4.5, 6.0, 8.0, 11.0), 7
EDGE = b".,;:!?\"'()[]{}<>|*#-_/\\"
U = np.uint64
HIGH = U(0xFFFFFFFF00000000)


class Words:
    """Hashes of the stripped words and of their stems, through numbers of the raw tokens that a worker has met."""

    def __init__(self, most: int = MOST_WORDS):
        self.most = most
        self.forget()

    def forget(self):
        self.numbers, self.word, self.stem = Numbered(), np.zeros(0, U), np.zeros(0, U)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, stem) of the texts' words one after another, and the words of each text. Tokens of punctuation alone are no words."""
        import xxhash

        if self.word.size > self.most:
            self.forget()
        rows = [ascii_words(t) for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        tokens = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        if new := self.numbers.new:
            h = xxhash.xxh3_64_intdigest
            bare = [t.strip(EDGE) for t in new]
            self.word = np.concatenate([self.word, np.array([h(w) if w else 0 for w in bare], U)])
            self.stem = np.concatenate([self.stem, np.array([h(w[:STEM], seed=1) if w else 0 for w in bare], U)])
            self.numbers.new = []
        word = self.word[tokens]
        some = word != 0
        doc = np.repeat(np.arange(sizes.size), sizes)[some]
        return word[some], self.stem[tokens][some], np.bincount(doc, minlength=sizes.size)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return per_worker("toxic_words", Words).of(texts)


def before(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What is before each word in its text; 0 before the first."""
    out = np.concatenate([np.zeros(1, x.dtype), x[:-1]]) if x.size else x.copy()
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return out


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """32 bits of the history's hash, then 32 bits of the word's: the sample's words are few enough to be told apart by these."""
    return (history & HIGH) | (word >> U(32))


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each x is among the sorted keys, where)."""
    if not keys.size:
        return np.zeros(x.size, bool), np.zeros(x.size, np.int64)
    at = np.minimum(np.searchsorted(keys, x), keys.size - 1)
    return keys[at] == x, at


def discounted(n1: np.ndarray, n0: np.ndarray, share: float, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts less their discounts: D where they differ by z standard deviations from `share` of their sum, else all."""
    expected = (n1 + n0) * share
    far = np.abs(n1 - expected) >= z * np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    return np.where(far, np.maximum(n1 - D, 0), 0), np.where(far, np.maximum(n0 - D, 0), 0)


class Models:
    """What differs between the classes. Each table: (sorted keys, columns): pairs (2: d_c / n_c), histories (2: g_c), words (4: d_c / n_c, Q(stem), P(w | stem)), stems (3: d_c / m_c, Q)."""

    def __init__(self, pairs=None, histories=None, words=None, stems=None, g=(1.0, 1.0), h=(1.0, 1.0), z=0.0):
        tables = []
        for keys, columns in (pairs or (np.zeros(0, U), np.zeros((0, 2))), histories or (np.zeros(0, U), np.zeros((0, 2))), words or (np.zeros(0, U), np.zeros((0, 4))), stems or (np.zeros(0, U), np.zeros((0, 3)))):
            order = np.argsort(keys)
            tables.append((keys[order], columns[order]))
        self.pairs, self.histories, self.words, self.stems = tables
        self.g, self.h, self.z = g, h, z
        self.base = float(np.log(g[0] * h[0]) - np.log(g[1] * h[1]))

    def ratios(self, word: np.ndarray, stem: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P_1 - log P_0 of each word, less `base`, the same of a word of which nothing differs. Classes are in the order toxic, ordinary."""
        out = np.zeros(word.size)
        history = before(word, sizes)
        has = [found(t[0], x) for t, x in ((self.pairs, pair_keys(history, word)), (self.histories, history & HIGH), (self.words, word), (self.stems, stem))]
        i = np.flatnonzero(has[0][0] | has[1][0] | has[2][0] | has[3][0])
        if not i.size:
            return out
        pair, hist, own, st = (np.where(ok[i][:, None], t[1][at[i]], empty) if t[0].size else np.broadcast_to(np.array(empty, float), (i.size, len(empty)))
                               for (ok, at), t, empty in zip(has, (self.pairs, self.histories, self.words, self.stems), ([0, 0], [1, 1], [0, 0, 1, 1], [0, 0, 1])))
        q = np.where(has[2][0][i], own[:, 2], st[:, 2])  # where neither the word nor its stem is known here, these factors are the same in both classes
        logs = []
        for c in (0, 1):
            by_stem = st[:, c] + self.h[c] * q
            logs.append(np.log(pair[:, c] + hist[:, c] * (own[:, c] + self.g[c] * by_stem * own[:, 3])))
        out[i] = logs[0] - logs[1] - self.base
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """(texts, 2): the total by length and by its root, in logarithms with signs; 0 for texts without words."""
        word, stem, sizes = words_of(texts)
        total = np.bincount(np.repeat(np.arange(sizes.size), sizes), weights=self.ratios(word, stem, sizes), minlength=sizes.size)
        n = np.maximum(sizes, 1)
        return np.sign(total)[:, None] * np.log1p(np.abs(total)[:, None] * np.stack([50 / n, 1 / np.sqrt(n)], axis=1))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(w.size)
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -5, 5)
    return w


def scores(models: Models, curve: np.ndarray, texts: list[bytes]) -> np.ndarray:
    return judged(models, curve, texts)[0]


def judged(models: Models, curve: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, whether anything in the text speaks for one class)."""
    x = models.features(texts)
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30))), x.any(axis=1)


def _dealt(part: np.ndarray, n: int):
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n + 1)).tolist()
    return [(p, order[a:b]) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]


def _counted(keys: np.ndarray, toxic: np.ndarray, weights=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, index of one of each, its toxic and its ordinary count)."""
    k, first, of = np.unique(keys, return_index=True, return_inverse=True)
    n1, n0 = (np.bincount(of, weights=(toxic == c) if weights is None else weights[1 - c], minlength=k.size) for c in (1, 0))
    return k, first, n1, n0


def learned(docs: DataFrame, labels: DataFrame, by: int, held: int, sample: int, text: str, doc_id: str) -> tuple[Models, np.ndarray]:
    """The models, counted over the sample's folds but the first after the held-out one, with the Z that does best on that one, and the curve, fitted to it."""
    spark, zs = docs.sparkSession, ZS
    of_fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(by))
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(of_fold("doc_id") != held)
    named = named.join(docs.select(F.col(doc_id).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in rows}
    if not toxic:
        return Models(), np.zeros(3)
    tuned = (held + 1) % by
    chosen = spark.createDataFrame(pa.table({"_chosen": pa.array(list(toxic), pa.int64())}).to_pandas())
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_chosen"))
    # equal texts are counted once, as the least id's
    own = own.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256), F.when(of_fold("doc_id") == tuned, F.col("doc_id"))).agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.*")
    source = packs(own)
    n_parts = parts_for(spark, source.agg(F.sum("raw")).first()[0] or 0)

    def ask(pack, body):
        ids, texts = pack_list(body)
        use = np.flatnonzero(fold(ids, by) != tuned)
        label = np.array([toxic[i] for i in ids[use].tolist()], np.uint8)
        word, stem, sizes = words_of([texts[i] for i in use.tolist()])
        doc = np.repeat(np.arange(sizes.size), sizes)
        history = before(word, sizes)
        pair, two = pair_keys(history, word), (before(history, sizes) >> U(32)).astype(np.uint32)
        # pairs with the word before them, in each class: distinct here, then over all packs
        triple = np.unique(mix(pair) ^ mix(two.astype(U) * U(2) + label[doc]), return_index=True)[1]
        yield 2 * n_parts, blob(np.bincount(label, minlength=2), np.bincount(label[doc], minlength=2))
        pair, two, kind = pair[triple], two[triple], label[doc[triple]]
        for p, i in _dealt((mix(pair & HIGH) % U(n_parts)).astype(np.int64), n_parts):
            yield p, blob(pair[i], two[i], kind[i])
        one = np.unique(mix(word) ^ doc.astype(U), return_index=True)[1]  # each word of each document
        w, first, n1, n0 = _counted(word[one], label[doc[one]])
        of = stem[one][first]
        one = np.unique(mix(stem) ^ doc.astype(U), return_index=True)[1]
        s, _, m1, m0 = _counted(stem[one], label[doc[one]])
        at_stem = dict(_dealt((mix(s) % U(n_parts)).astype(np.int64), n_parts))
        for p, i in _dealt((mix(of) % U(n_parts)).astype(np.int64), n_parts):
            j = at_stem[p]
            yield n_parts + p, blob(w[i], of[i], n1[i].astype(np.int32), n0[i].astype(np.int32), s[j], m1[j].astype(np.int32), m0[j].astype(np.int32))

    sent = written(to_parts(source, ask), "counts")
    add = lambda ids, got: iter([(-1, blob(*[sum(x) for x in zip(*map(unblob, got))]))]) if got else iter(())
    sums = [unblob(r["body"]) for r in at_parts(sent.where(F.col("part") == 2 * n_parts).withColumn("part", F.lit(0)), 1, add).collect()]  # four numbers
    n_docs, n_words = sums[0] if sums else (np.zeros(2), np.zeros(2))
    share, pair_share = (float(x[1]) / max(1.0, float(x.sum())) for x in (n_docs, n_words))

    def pairs(pack_ids, got):
        pair, two, kind = (np.concatenate(x) for x in zip(*map(unblob, got)))
        one = np.unique(mix(pair) ^ mix(two.astype(U) * U(2) + kind), return_index=True)[1]
        pair, _, n1, n0 = _counted(pair[one], kind[one])
        history, of = np.unique(pair & HIGH, return_inverse=True)
        totals = [np.maximum(np.bincount(of, weights=n, minlength=history.size), 1) for n in (n1, n0)]
        for k, z in enumerate(zs):
            d = discounted(n1, n0, pair_share, z)
            shares = [x / t[of] for x, t in zip(d, totals)]
            left = [1 - np.bincount(of, weights=x, minlength=history.size) for x in shares]
            keep = (d[0] > 0) | (d[1] > 0)
            some = np.unique(of[keep])
            yield k, blob(pair[keep], *[x[keep] for x in shares], history[some], *[x[some] for x in left])

    got = [[] for _ in zs]
    for r in at_parts(sent.where(F.col("part") < n_parts), n_parts, pairs).collect():  # the expressions that differ
        got[r["pack"]].append(unblob(r["body"]))
    none = (np.zeros(0, U), *np.zeros((2, 0)), np.zeros(0, U), *np.zeros((2, 0)))
    by_pair = [[np.concatenate(x) for x in zip(*g)] if g else none for g in got]
    asked = [np.unique(x[0] & U(0xFFFFFFFF)) for x in by_pair]

    def words(pack_ids, got):
        w, of, n1, n0, s, m1, m0 = (np.concatenate(x) for x in zip(*map(unblob, got)))
        w, first, n1, n0 = _counted(w, None, (n1, n0))
        of = of[first]
        s, _, m1, m0 = _counted(s, None, (m1, m0))
        mass = np.bincount(np.searchsorted(s, of), weights=n1 + n0, minlength=s.size)
        for k, z in enumerate(zs):
            d, e = discounted(n1, n0, share, z), discounted(m1, m0, share, z)
            keep = (d[0] > 0) | (d[1] > 0) | found(asked[k], w >> U(32))[0]
            i = np.searchsorted(s, of[keep])
            kept = (e[0] > 0) | (e[1] > 0)
            sums = [x.sum() for x in (n1, n0, m1, m0, *d, *e)]
            yield k, blob(w[keep], d[0][keep], d[1][keep], (n1 + n0)[keep], mass[i], s[kept], e[0][kept], e[1][kept], mass[kept], np.array([*sums, s.size]))

    got = [[] for _ in zs]
    for r in at_parts(sent.where((F.col("part") >= n_parts) & (F.col("part") < 2 * n_parts)).withColumn("part", F.col("part") - n_parts), n_parts, words).collect():
        got[r["pack"]].append(unblob(r["body"]))
    dropped(sent)
    tried = [_model(*x, z) for *x, z in zip(by_pair, got, zs)]

    def tune(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                ids, texts = pack_list(body)
                own = np.flatnonzero(fold(ids, by) == tuned)
                if own.size:
                    x = [m.features([texts[i] for i in own.tolist()]) for m in tried]
                    half = mix(ids[own].astype(U)) >> U(63)
                    yield mail([(0, 0, blob(np.column_stack([*x, half, [toxic[i] for i in ids[own].tolist()]]).ravel()))])

    wide = 2 * len(zs) + 2
    rows = [unblob(r["body"])[0].reshape(-1, wide) for r in source.select("body").mapInArrow(tune, MAIL).collect()]  # some numbers for each labelled row of a fold of the sample
    dropped(source)
    if not rows:
        return tried[-1], np.zeros(3)
    x = np.concatenate(rows)
    x = x[np.lexsort(x.T)]
    best = max(range(len(zs)), key=lambda k: (round(_halves(x[:, 2 * k : 2 * k + 2], x[:, -1], x[:, -2]), 9), zs[k]))
    return tried[best], logistic(x[:, 2 * best : 2 * best + 2], x[:, -1])


def _model(pairs: list, got: list, z: float) -> Models:
    """From what the parts found: pairs (keys, shares of both classes, histories, what is left for the back-off), words and stems."""
    if not got:
        return Models(z=z)
    pair, p1, p0, history, g1, g0 = pairs
    w, d1, d0, n, mass, s, e1, e0, s_mass = (np.concatenate(x) for x in list(zip(*got))[:-1])
    n1, n0, m1, m0, a1, a0, b1, b0, n_stems = np.sum([x[-1] for x in got], axis=0)
    n1, n0, m1, m0 = (max(1.0, x) for x in (n1, n0, m1, m0))
    whole = n1 + n0 + n_stems + 1
    return Models(
        (pair, np.stack([p1, p0], 1)),
        (history, np.stack([g1, g0], 1)),
        (w, np.stack([d1 / n1, d0 / n0, (mass + 1) / whole, n / (mass + 1)], 1)),
        (s, np.stack([e1 / m1, e0 / m0, (s_mass + 1) / whole], 1)),
        (1 - a1 / n1, 1 - a0 / n0),
        (1 - b1 / m1, 1 - b0 / m0),
        z,
    )


def _halves(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> float:
    """The log-likelihood of each half's labels by the curve fitted to the other."""
    total = 0.0
    for h in (0, 1):
        own = half == h
        if own.any() and (~own).any():
            c = logistic(x[~own], y[~own])
            t = np.clip(c[0] + x[own] @ c[1:], -30, 30)
            total -= np.log1p(np.exp(np.where(y[own] > 0, -t, t))).sum()
    return total


def toxicity(docs: DataFrame, labels: DataFrame, by: int = 5, held: int = 0, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text, a row for each row of `docs`, repeated ids too.

    held_out: crc32(doc_id as text) mod `by` = `held`; labels of such rows are never looked at. A null doc_id is never
    labelled; its fold is that of the empty text. score: 0 to 1, higher where label 1 is likelier; empty and null texts
    get the curve's value for no difference. A document labelled twice counts as toxic if one label says so. Without
    labels all scores are 0.5. Other columns, of any name, are not read."""
    models, curve = learned(docs, labels, by, held, sample, text, doc_id)

    def run(batches):
        for batch in batches:
            for ids, texts in bodies(batch):
                score = scores(models, curve, texts)
                yield pa.RecordBatch.from_arrays([id_column(ids), pa.array(fold(ids, by) == held), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return text_rows(docs, text, doc_id).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, by: int = 5, held: int = 0, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns, that toxicity() does not predict to be toxic; without labels to learn from, all of them. No shuffle; rows are judged by their texts alone.

    A text in which nothing speaks for either class (null, empty, or of expressions that don't differ) stays, however many of the labels are toxic."""
    models, curve = learned(docs, labels, by, held, sample, text, doc_id)
    if not curve.any():
        return docs

    plain = [f"c{k}" for k in range(len(docs.columns))]  # names that mapInArrow can resolve, whatever the columns are called
    at_text = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            body = batch.column(at_text).cast(pa.binary()).fill_null(b"")
            for at in range(0, batch.num_rows, 512):
                texts = body.slice(at, 512).to_pylist()
                score, known = judged(models, curve, texts)
                yield batch.slice(at, len(texts)).filter(pa.array((score < 0.5) | ~known))

    renamed = docs.toDF(*plain)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
