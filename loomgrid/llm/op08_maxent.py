"""A hashed maximum-entropy language model with a class-factored softmax.

The likelihood of a word is that of its class given the two words before, times that of the word in its class. The
TOP most frequent training words are in CLASSES classes, words that follow the same words together; the others are in
TAIL classes by a hash of their last two bytes. A word with c training occurrences has the share (c + 1) / (sum of
(c + 1) over its class's words), where each tail class has 1 more in the sum for words never seen. So the likelihoods
of all known words and of an unknown word add up to 1 in every context.

Features of a class: its bias, the word before (bigram), the word before that (skip), and both (trigram), hashed to
CONTEXTS buckets. Bigram weights start from counts, then all are moved in ROUNDS of distributed gradient updates: each
round sums, over the training documents whose hash lies in its share, how often each feature was met and how often the
model expected it, and moves every weight by the difference of the two logarithms. What the model expects depends on the
two words before alone, so it is worked out once for each context that a task meets, times how often. Tasks read about SHARE_BYTES of text
each and are summed as a tree, in whole numbers: the result depends on the documents alone, not on how they are packed,
on the order in which tasks end or on the number of cores.

Words then get features of their own: every pair and every triple of training words, however rare, exact by 64-bit hash
and as many as the training text has. The likelihood of a word w after u, v is
    (n(u v w) + TRIPLE * p) / (n(u v) + TRIPLE), where p = (n(v w) + PAIR * q) / (n(v) + PAIR)
and q is the likelihood above: a log-linear model whose pair and triple weights and normaliser are known in closed form.
What follows v adds up to n(v) and what follows u v to n(u v), so the likelihoods still add up to 1, and words of one
class part by what they follow. The start of a text is a context like others; a first word has no triple.

Counts cover all training documents. A pack of documents sends each distinct word's count to the word's part, which
answers with the word's total, and pairs and triples get theirs likewise, so no table of all words or contexts is ever
in one place; only TOP words and the weights of classes (fixed sizes) go to all tasks. Words are hashed once, into packs
of tokens; with the counts and the TOP words these turn into packs of tokens with 16-bit codes, counts and what a text's
base score owes to them. Rounds and scores read these, in numpy batches. A pack numbers its words by frequency, those
met once by their hashes, which are then told by their differences. Words count by 64 bits of hash; in pairs and triples
they stand by 48, and a part tells its pairs and triples apart by 40 bits beside those that chose the part.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAIL, NULL_ID, at_packs, at_parts, blob, dropped, id_column, mail, mix, packs, parts_for, settle, to_parts, unblob, written
from .words import MOST_WORDS, Numbered, ascii_words, per_worker

#: Words with places of their own, their classes, classes of the others, words whose followers are counted, buckets of trigrams.
TOP, CLASSES, TAIL, BEFORE, CONTEXTS = 4096, 32, 32, 512, 1 << 13
#: Ends of the rounds of gradient steps, as shares of the training documents: each takes the documents whose hash lies in its share.
ROUNDS = (1 / 32, 2 / 32, 4 / 32, 8 / 32, 16 / 32, 1.0)
#: Size of the steps, occurrences added to those counted, contexts whose gradients are added up at once, and the unit that they are rounded to.
RATE, PRIOR, STEP, UNIT = 0.5, 2.0, 4096, 1 << 18
#: Bytes of text that one task of a round reads: it sends all weights' sums once.
SHARE_BYTES = 64 << 20
#: Small texts are shared by all slots, this much each at least; sums don't depend on how they are shared.
LEAST_SHARE = 2 << 20
#: Occurrences that the level below counts for among the words after a word, and after two words.
PAIR, TRIPLE = 100.0, 10.0
#: Tokens whose followers are counted at once.
FOLLOW = 1 << 21
U = np.uint64
#: Stands for the end of a text among the words' hashes; its low bits give its tail class.
END = U(0x5851F42D4C957F20)
#: Stands for the start of a text, as the word before its first.
START = U(0x14057B7EF767814F)
ALL = CLASSES + TAIL


def fold(ids: np.ndarray, by: int) -> np.ndarray:
    """crc32(doc_id as text) modulo `by`; a null id is the empty text."""
    return np.array([zlib.crc32(b"" if i == NULL_ID else b"%d" % i) % by for i in ids.tolist()], np.int64)


def spread(ids: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each id, by hash; of equal ids the same."""
    return (mix(ids.astype(U) + U(3)) >> U(11)).astype(np.float64) / 2**53


class Tokens:
    """Tokens of texts as 64-bit hashes whose five low bits are the tail class, through numbers of the words that a worker has met."""

    def __init__(self, most: int = MOST_WORDS):
        self.most = most
        self.forget()

    def forget(self):
        self.numbers, self.hashes = Numbered(), np.array([END])
        self.numbers[None] = 0  # the end of a text

    def of(self, texts: list[bytes]):
        """(hashes of the distinct tokens, place of each token among them, tokens of each text); the end of each text is a token."""
        import xxhash

        if self.hashes.size > self.most:
            self.forget()
        rows = [[*ascii_words(t), None] for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        tokens = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        if new := self.numbers.new:
            h = xxhash.xxh3_64_intdigest
            self.hashes = np.concatenate([self.hashes, np.fromiter((h(w) & ~(TAIL - 1) | h(w[-2:]) % TAIL for w in new), U, len(new))])
            self.numbers.new = []
        met = np.flatnonzero(np.bincount(tokens, minlength=self.hashes.size))
        places = np.zeros(self.hashes.size, np.uint16 if met.size <= 1 << 16 else np.uint32)
        places[met] = np.arange(met.size)
        return self.hashes[met], places[tokens], sizes


def planes(x: np.ndarray, k: int) -> np.ndarray:
    """The k low bytes of whole numbers, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).ravel()


def unplaned(p: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((p.size // k, 8), np.uint8)
    out[:, :k] = p.reshape(k, -1).T
    return out.view("<u8").ravel().astype(U)


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; cumsum() undoes it."""
    return np.diff(x, prepend=U(0)) if x.size else x


def hashed(words: np.ndarray, often: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k high bytes of the first `often` hashes, and of the others, which are sorted."""
    x = words >> U(64 - 8 * k)
    return planes(x[:often], k), planes(deltas(x[often:]), k)


def unhashed(first: np.ndarray, rest: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([unplaned(first, k), np.cumsum(unplaned(rest, k), dtype=U)]) << U(64 - 8 * k)


def token_pack(ids: np.ndarray, texts: list[bytes]) -> bytes:
    """Body of a pack of tokens, for pack_tokens(): distinct tokens by how often they are met, then those met once by their hashes."""
    words, of, sizes = per_worker("tokens", Tokens).of(texts)
    n = np.bincount(of, minlength=words.size)
    order = np.lexsort((words, np.where(n > 1, -n, 0)))
    place = np.empty(words.size, U)
    place[order] = np.arange(words.size, dtype=U)
    return blob(ids, sizes, *hashed(words[order], int((n > 1).sum()), 8), planes(place[of], 4 if words.size >> 24 else 3))


def places(of: np.ndarray, n_tokens: int) -> np.ndarray:
    """Place of each token among the distinct ones."""
    return unplaned(of, of.size // max(1, n_tokens) or 3).astype(np.int64)


def pack_tokens(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tokens of each text, hashes of the distinct tokens, place of each token among them)."""
    ids, sizes, first, rest, of = unblob(body)
    return ids, sizes, unhashed(first, rest, 8), places(of, int(sizes.sum()))


def follows(words: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pair and of the triple that end with each token; a first token's triple is its pair."""
    h = words[of]
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[START], h[:-1]])
    before[starts] = START
    pair = mix(before * U(0x9E3779B97F4A7C15) + h)
    triple = mix(np.concatenate([[U(0)], pair[:-1]]) * U(0xC2B2AE3D27D4EB4F) + h)
    triple[starts] = pair[starts]
    return pair, triple


def keyed(keys: np.ndarray) -> np.ndarray:
    """40 bits of each of a part's sorted keys."""
    return planes(deltas(keys >> U(24)), 5)


def unkeyed(p: np.ndarray) -> np.ndarray:
    return np.cumsum(unplaned(p, 5), dtype=U)


def tight(counts: np.ndarray) -> np.ndarray:
    """Counts in the least whole numbers that hold them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def blended(q: np.ndarray, c: np.ndarray, pair: np.ndarray, triple: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the likelihood of each token. q: log10 of it by classes; c, pair, triple: training counts of the token, its pair and its triple."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    before, two = np.concatenate([[0], c[:-1]]), np.concatenate([[0], pair[:-1]])
    before[starts] = c[ends - 1]  # texts start as often as they end
    p = (pair + PAIR * 10.0**q) / (before + PAIR)
    out = (triple + TRIPLE * p) / (two + TRIPLE)
    out[starts] = p[starts]
    return np.log10(out)


class Model:
    """Weights and what follows from them. Tokens are codes: below n a frequent word's number, n the start of a text, then the tail classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray):
        """words: hashes, the most frequent first; counts: their occurrences; tail_mass: sum of (c + 1) over all training words of each tail class."""
        self.n = n = words.size
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.mass = counts + 1.0
        self.tail_mass = tail_mass - np.bincount((words & U(TAIL - 1)).astype(np.int64), weights=self.mass, minlength=TAIL) + 1
        self.cls = np.zeros(n, np.int64)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Codes of tokens with these hashes."""
        tail = self.n + 1 + (h & U(TAIL - 1)).astype(np.int64)
        if not self.n:
            return tail.astype(np.uint16)
        at = np.minimum(np.searchsorted(self.words, h), self.n - 1)
        return np.where(self.words[at] == h, self.order[at], tail).astype(np.uint16)

    def classes(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([self.cls, [0], np.arange(CLASSES, ALL)])[w]

    def contexts(self, w: np.ndarray, sizes: np.ndarray):
        """(word before, word before that, bucket of both) of each token; a tail word counts as its tail class."""
        starts = np.cumsum(sizes) - sizes
        one, two = np.full(w.size, self.n), np.full(w.size, self.n)
        one[1:] = w[:-1]
        two[2:] = w[:-2]
        one[starts] = self.n
        two[starts] = self.n
        two[starts[sizes > 1] + 1] = self.n
        return one, two, self.bucket(one, two)

    def bucket(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (mix(one.astype(U) * U(1 << 20) + two.astype(U)) % U(CONTEXTS)).astype(np.int64)

    @property
    def width(self) -> int:
        """Codes that there are: one * width + two is the number of a context."""
        return self.n + 1 + TAIL

    def start(self, pairs: np.ndarray):
        """Classes, biases and bigram weights from counts. pairs: (word before, below BEFORE or any other; word or n + tail class)."""
        n = self.n
        rows = np.sqrt(pairs[:, :n].T / np.maximum(pairs[:, :n].sum(0)[:, None], 1.0))
        rng = np.random.default_rng(0)
        centres = rows[: CLASSES] if n >= CLASSES else rows
        for _ in range(12 if n > CLASSES else 0):
            self.cls = (rows @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            for c in range(CLASSES):
                own = self.cls == c
                centres[c] = np.average(rows[own], axis=0, weights=self.mass[own]) if own.any() else rows[rng.integers(n)]
        if n <= CLASSES:
            self.cls = np.arange(n)
        else:
            self.cls = (rows @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        by = np.zeros((pairs.shape[0], ALL))
        np.add.at(by.T, self.cls, pairs[:, :n].T)
        by[:, CLASSES:] = pairs[:, n:]
        self.class_mass = np.bincount(self.cls, weights=self.mass, minlength=CLASSES)
        share = by.sum(0) + 0.5
        share /= share.sum()
        self.b = np.log(share).astype(np.float32)
        self.A = np.zeros((n + 1 + TAIL, ALL), np.float32)
        grown = np.log((by + 20 * share) / (by.sum(1, keepdims=True) + 20)) - np.log(share)
        m = min(BEFORE, n)
        self.A[:m] = grown[:m]
        self.A[m:n] = grown[BEFORE]
        self.A[n:] = grown[BEFORE + 1 :]
        self.B = np.zeros_like(self.A)
        self.T = np.zeros((CONTEXTS, ALL), np.float32)

    def weights(self, one, two, both) -> np.ndarray:
        """Weights of the classes in each context, before they are normalised."""
        x = self.A[one]
        x += self.B[two]
        x += self.T[both]
        x += self.b
        return x

    def chances(self, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the likelihood of each token's class over the sum that its words share."""
        one, two, both = self.contexts(w, sizes)
        c = self.classes(w)
        out = -np.log(np.concatenate([np.maximum(self.class_mass, 1), self.tail_mass]))[c]
        met, at = np.unique(one * self.width + two, return_inverse=True)
        most, total = np.empty((2, met.size), np.float32)
        for a in range(0, met.size, STEP):
            i = slice(a, a + STEP)
            first, second = np.divmod(met[i], self.width)
            x = self.weights(first, second, self.bucket(first, second))
            most[i] = x.max(axis=1)
            x -= most[i, None]
            total[i] = np.log(np.exp(x, out=x).sum(axis=1))
        own = self.A[one, c] + self.B[two, c] + self.T[both, c] + self.b[c]  # as weights() adds them
        return (out + ((own - most[at]) - total[at])) / np.log(10)

    def log10(self, h: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 likelihood of each token, by its hash; counts: its occurrences in training."""
        return np.log10(counts + 1.0) + self.chances(self.codes(h), sizes)

    def met(self, w: np.ndarray, sizes: np.ndarray, sums: list[np.ndarray], seen: np.ndarray):
        """Adds up, for each row and class of A, B and T, how often the class was met (sums[0:3]), and how often each context was (seen, by its number)."""
        keys = self.contexts(w, sizes)
        c = self.classes(w)
        for k, met in zip(keys, sums):
            met.ravel()[:] += np.bincount(k * ALL + c, minlength=met.size)
        contexts, times = np.unique(keys[0] * self.width + keys[1], return_counts=True)
        seen[contexts] += times.astype(np.uint32)

    def occurrences(self, w: np.ndarray, sizes: np.ndarray, sums: list[np.ndarray]):
        """met() and expected() of these texts alone."""
        seen = np.zeros(self.width**2, np.uint32)
        self.met(w, sizes, sums, seen)
        self.expected(seen, sums)

    def expected(self, seen: np.ndarray, sums: list[np.ndarray]):
        """Adds up how often each class was to be expected (sums[3:6]) in the contexts seen, in units of 1 / UNIT, so that sums are whole numbers and come out the same in any order."""
        contexts = np.flatnonzero(seen)
        for a in range(0, contexts.size, STEP):
            i = contexts[a : a + STEP]
            one, two = np.divmod(i, self.width)
            keys = one, two, self.bucket(one, two)
            g = self.weights(*keys)
            g -= g.max(axis=1, keepdims=True)
            np.exp(g, out=g)
            g *= UNIT / g.sum(axis=1, keepdims=True)
            g = np.rint(g, out=g).astype(np.int64) * seen[i, None]
            for k, expected in zip(keys, sums[3:]):
                order = np.argsort(k.astype(np.uint16), kind="stable")  # of 16 bits: a radix sort
                own = k[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                expected[own[first]] += np.add.reduceat(g[order], first, axis=0)

    def move(self, sums: list[np.ndarray]):
        """A step uphill: every weight by RATE of the log of how much oftener its feature was met than expected."""
        for weights, met, expected in zip((self.A, self.B, self.T), sums, sums[3:]):
            weights += (RATE * np.log((met + PRIOR) / (expected / UNIT + PRIOR))).astype(np.float32)


def written_alone(df: DataFrame, label: str) -> DataFrame:
    """written(), whose shuffle files go as soon as the table is there, not when the driver's garbage is next collected."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(df.select("*"), label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _summed(rows: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of the arrays of whole numbers that `tasks` tasks sent under a few keys (part); 32 at most meet in one task. They have fixed sizes, so the sums may reach the driver."""

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, to, body in zip(*(batch.column(c).to_pylist() for c in ("part", "pack", "body"))):
                x = unblob(body)[0].astype(np.int64)
                sums[k, to] = sums[k, to] + x if (k, to) in sums else x
        for (k, to), x in sums.items():
            yield mail([(k, to, blob(tight(x)))])

    while True:
        tasks = -(-tasks // 32)
        rows = rows.withColumn("pack", F.pmod("pack", F.lit(tasks))).repartition(min(6 * tasks, 4096), "part", "pack").mapInArrow(add, MAIL)
        if tasks == 1:
            return {r["part"]: unblob(r["body"])[0] for r in rows.collect()}


def scored(docs: DataFrame, by: int = 7, held: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    held_out rows (crc32(doc_id as text) mod `by` = `held`) take no part in any count or step. Null and empty texts are
    their end alone. Without training rows every word is unknown and scores are those of an even split over classes."""
    spark = docs.sparkSession
    source = packs(docs, text, doc_id, form=token_pack)
    source_bytes = source.agg(F.sum("raw")).first()[0] or 0
    n_parts = parts_for(spark, source_bytes)

    def shares(words):
        part = ((words >> U(32)) % U(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
        return [(p, order[a:b]) for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]

    def ask(pack, body):
        ids, sizes, words, of = pack_tokens(body)
        counts = np.bincount(of[np.repeat(fold(ids, by) != held, sizes)], minlength=words.size)
        for part, i in shares(words):
            yield part, blob(words[i], counts[i])

    def answer(pack_ids, got):
        rows = [unblob(x) for x in got]
        words, of = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        totals = np.bincount(of, weights=np.concatenate([r[1] for r in rows]).astype(np.float64), minlength=words.size).astype(np.int64)
        for p, x in zip(pack_ids.tolist(), np.split(totals[of], np.cumsum([r[0].size for r in rows])[:-1])):
            yield p, blob(x)
        known = totals > 0
        words, totals = words[known], totals[known]
        best = np.argsort(-totals, kind="stable")[:TOP]
        mass = np.bincount((words & U(TAIL - 1)).astype(np.int64), weights=totals + 1.0, minlength=TAIL).astype(np.int64)
        yield -1, blob(words[best], totals[best], mass, np.array([totals.sum(), words.size]))

    replies = written(at_parts(to_parts(source, ask), n_parts, answer), "counts")
    settle(spark)

    def merge(batches):
        """The most frequent words of several parts, a word being in one part only, and the sums of their masses."""
        rows = [unblob(b) for batch in batches for b in batch.column("body").to_pylist()]
        if rows:
            words, totals = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
            best = np.lexsort((words, -totals))[:TOP]
            yield mail([(0, -1, blob(words[best], totals[best], sum(r[2] for r in rows), sum(r[3] for r in rows)))])

    stats, n = replies.where("pack < 0"), n_parts
    while n > 1:  # each step merges about 32 parts, each of fixed size
        n = -(-n // 32)
        stats = stats.repartitionById(n, F.pmod(F.xxhash64("body"), F.lit(n)).cast("int")).mapInArrow(merge, MAIL)
    top = [unblob(r["body"]) for r in stats.collect()]
    words, counts, mass, (total, distinct) = top[0] if top else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(TAIL), (0, 0))
    total, distinct = int(total), int(distinct)
    model = Model(words, counts.astype(np.float64), mass.astype(np.float64))

    def code(pack, body, told):
        ids, sizes, words, of = pack_tokens(body)
        c = np.zeros(words.size, np.int64)
        for part, i in shares(words):
            c[i] = unblob(told[0][part])[0]
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x[of], starts)
        _, _, first, _, line = unblob(body)
        own = blob(ids, sizes, (fold(ids, by) == held).astype(np.uint8), add((c > 0).astype(np.int64)), add(np.log10((c + 1) / (total + distinct + 1))), *hashed(words, first.size // 8, 6), tight(c), model.codes(words), line)
        return pa.table({"pack": pa.array([pack], pa.int64()), "body": pa.array([own], pa.binary())})

    coded = written(at_packs(source, [replies.where("pack >= 0")], code, "pack long, body binary"), "coded", "uncompressed")
    dropped(source)
    dropped(replies)
    settle(spark)
    n_tasks = max(int(source_bytes // SHARE_BYTES) + 1, min(spark.sparkContext.defaultParallelism, int(source_bytes // LEAST_SHARE) + 1))
    tasks = coded.select("body").coalesce(n_tasks)

    def training(body, lo=0.0, hi=1.0):
        ids, sizes, out, *_, codes, of = unblob(body)
        own = (out == 0) & (spread(ids) >= lo) & (spread(ids) < hi)
        return codes[places(of, int(sizes.sum()))[np.repeat(own, sizes)]], sizes[own]

    def follow(batches):
        n = model.n
        row = np.concatenate([np.minimum(np.arange(n), BEFORE), np.arange(BEFORE + 1, BEFORE + 2 + TAIL)])
        out, waiting, some = np.zeros((BEFORE + 2 + TAIL, n + TAIL), np.int64), [], False

        def count():
            if waiting:
                out.ravel()[:] += np.bincount(np.concatenate(waiting), minlength=out.size)
                waiting.clear()

        for batch in batches:
            for body in batch.column("body").to_pylist():
                w, sizes = training(body)
                if w.size:
                    one, _, _ = model.contexts(w, sizes)
                    waiting.append(row[one] * (n + TAIL) + np.where(w < n, w, w - 1))
                    some = True
                    if sum(x.size for x in waiting) >= FOLLOW:
                        count()
        count()
        if some:
            yield mail([(0, TaskContext.get().partitionId(), blob(tight(out.ravel())))])

    pairs = _summed(tasks.mapInArrow(follow, MAIL), n_tasks).get(0, np.zeros((BEFORE + 2 + TAIL) * (model.n + TAIL)))
    model.start(pairs.astype(np.float64).reshape(BEFORE + 2 + TAIL, -1))
    shapes = [x.shape for x in (model.A, model.B, model.T)]

    def gather(lo, hi):
        def run(batches):
            sums = [np.zeros(s, np.int64) for s in 2 * shapes]
            seen = np.zeros(model.width**2, np.uint32)  # 17 million numbers at most
            for batch in batches:
                for body in batch.column("body").to_pylist():
                    w, sizes = training(body, lo, hi)
                    if w.size:
                        model.met(w, sizes, sums, seen)
            model.expected(seen, sums)
            if sums[0].any():
                for k, x in enumerate(sums):
                    yield mail([(k, TaskContext.get().partitionId(), blob(tight(x.ravel())))])

        return run

    for lo, hi in zip((0.0, *ROUNDS[:-1]), ROUNDS):
        sums = _summed(tasks.mapInArrow(gather(lo, hi), MAIL), n_tasks)
        if sums:
            model.move([sums[k].reshape(s) for k, s in enumerate(2 * shapes)])
        settle(spark)

    n_grams = parts_for(spark, source_bytes)

    def grams(level, words, of, sizes):
        """Distinct keys of a pack's pairs (level 0) or triples (1), the place of each token's key, and the keys' places by part."""
        keys, at = np.unique(follows(words, of, sizes)[level], return_inverse=True)
        part = ((keys & U(0xFFFFFF)) % U(n_grams)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if n_grams <= 1 << 16 else part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(n_grams + 1)).tolist()
        return keys, at, [(p, order[a:b]) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]

    def opened(body):
        ids, sizes, out, _, _, first, rest, c, codes, of = unblob(body)
        return ids, sizes, out, unhashed(first, rest, 6), c, codes, places(of, int(sizes.sum()))

    def ask_grams(level):
        def ask(pack, body):
            _, sizes, out, words, _, _, of = opened(body)
            keys, at, dealt = grams(level, words, of, sizes)
            counts = np.bincount(at[np.repeat(out == 0, sizes)], minlength=keys.size)
            for part, i in dealt:
                yield part, blob(keyed(keys[i]), tight(counts[i]))

        return ask

    def answer_grams(pack_ids, got):
        rows = [unblob(x) for x in got]
        keys, of = np.unique(np.concatenate([unkeyed(r[0]) for r in rows]), return_inverse=True)
        totals = np.bincount(of, weights=np.concatenate([r[1] for r in rows]).astype(np.float64), minlength=keys.size).astype(np.int64)
        for p, x in zip(pack_ids.tolist(), np.split(totals[of], np.cumsum([r[1].size for r in rows])[:-1])):
            yield p, blob(tight(x))

    told_grams = []
    for level, label in enumerate(("pairs", "triples")):  # one after the other: less disk at once
        settle(spark)
        told_grams.append(written_alone(at_parts(to_parts(coded, ask_grams(level)), n_grams, answer_grams), label))
    settle(spark)

    def finish(pack, body, told):
        ids, sizes, out, words, c, codes, of = opened(body)
        known, base = unblob(body)[3:5]
        counts = []
        for level in (0, 1):
            keys, at, dealt = grams(level, words, of, sizes)
            n = np.zeros(keys.size, np.int64)
            for part, i in dealt:
                n[i] = unblob(told[level][part])[0]
            counts.append(n[at])
        c, (pair, triple) = c[of].astype(np.int64), counts
        by_token = blended(np.log10(c + 1.0) + model.chances(codes[of], sizes), c, pair, triple, sizes)
        score = np.add.reduceat(by_token, np.cumsum(sizes) - sizes)
        columns = {"doc_id": id_column(ids), "held_out": pa.array(out == 1), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(ids.size, total, np.int64)), "base_score": pa.array(base), "score": pa.array(score)}
        return pa.table(columns)

    return at_packs(coded, told_grams, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
