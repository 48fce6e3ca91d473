"""Removal of repeated byte strings by suffix sorting with difference covers.

A byte goes if a string of `length` bytes that covers it also starts earlier. Sorting every suffix of a corpus moves
each position several times; nearly all of them have no partner. So positions that provably have none are left out:

1. Anchors. The start of each window of `length` bytes is given to an anchor: the leftmost least hash among the
   GRAM-byte grams of the window. Equal windows have equal anchors at equal offsets. The starts that share an anchor
   form a run; its class is its gram's hash and a hash of all its bytes, 128 bits in all.
2. Classes. Each pack of documents sends each of its classes once, to the part of the gram's hash, and learns whether
   the run is the first of its class over all packs (if not, all its windows start earlier elsewhere), and whether
   other classes share its gram (if not, its windows have no partner).
3. Suffix sorting. First runs that share a gram send their bytes, at most 2 * length - GRAM of them, to the gram's
   part. There the suffixes are sorted by the difference-cover algorithm modulo 3: triples at sampled positions are
   sorted and named, the names' own suffixes sorted by recursion, the remaining suffixes by their first byte and the
   sampled rank behind it, and both merged; adjacent suffixes are compared over `length` bytes, and of equal ones the
   earliest is kept. Grams with very many classes are split to single windows first, each sent once by each pack.

Hashes only leave positions out or stand for whole runs at 128 bits; all other matches are of the bytes themselves.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_packs, at_parts, blob, dropped, id_column, mix, pack_texts, packs, parts_for, settle, to_parts, unblob, unpacked_rows, written

#: Bytes of a gram; a run has at most length - GRAM + 1 windows.
GRAM = 50
#: Windows that are handled at once, and bytes of a local suffix sort (its names fit in 21 bits).
CHUNK, SORT_BYTES = 1 << 19, 1 << 20
#: Classes of one gram beyond which runs are split to windows.
HOT = 2048
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes modulo 2**64 of substrings, over random numbers for bytes and an odd base."""

    def __init__(self, seed: int, n: int):
        rng = np.random.default_rng(seed)
        self.of = rng.integers(0, 2**64, 256, U)
        base = int(rng.integers(0, 2**62)) * 4 + 3
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 2**64), n)

    def sums(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros(text.size + 1, U)
        np.cumsum(self.of[text] * self.up[: text.size], out=out[1:])
        return out


class Runs:
    """Runs of the windows of a pack: start, size (windows), anchor, gram hash and class hash of each, in order."""

    def __init__(self, length: int):
        self.length = length
        self.one, self.two = Rolling(1, CHUNK + length), Rolling(2, CHUNK + length)

    def of(self, starts: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """starts: of the documents in raw, with the end."""
        length, span = self.length, self.length - GRAM + 1
        lasts = starts[1:] - length  # the last window of each document
        out = []
        for a in range(0, max(0, raw.size - length + 1), CHUNK):
            b = min(a + CHUNK, raw.size - length + 1)
            text = raw[a : b + length - 1]
            sums = self.one.sums(text)
            h = mix((sums[GRAM:] - sums[:-GRAM]) * self.one.down[: text.size - GRAM + 1])
            n = U(20)
            low = ((h >> n) << n) | np.arange(h.size, dtype=U)
            size = 1
            while 2 * size <= span:
                low = np.minimum(low[: low.size - size], low[size:])
                size *= 2
            if size < span:
                low = np.minimum(low[: low.size - (span - size)], low[span - size :])
            anchor = (low[: b - a] & U((1 << 20) - 1)).astype(np.int64)
            d0, d1 = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            good = np.zeros(b - a, bool)
            for s, e in zip(np.maximum(starts[d0:d1], a).tolist(), np.minimum(lasts[d0:d1] + 1, b).tolist()):
                if e > s:
                    good[s - a : e - a] = True
            at = np.flatnonzero(good)
            if not at.size:
                continue
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(anchor[at]) != 0)]))
            s = at[first]
            size = np.diff(np.concatenate([first, [at.size]]))
            p, e = anchor[s], s + size - 1 + length
            sums = self.two.sums(text)
            g = mix(((sums[e] - sums[s]) * self.two.down[s]) ^ (size.astype(U) << U(40)) ^ ((p - s).astype(U) << U(52)))
            out.append((s + a, size, p + a, h[p], g))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)] * 2


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix of s, non-negative integers below 2**21, by the difference cover {1, 2} modulo 3."""
    n = s.size
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return rank
    t = np.zeros(n + 3, np.int64)
    t[:n] = s + 1
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one more if n % 3 == 1, so that the two halves don't run together
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (t[sample] << 42) | (t[sample + 1] << 21) | t[np.minimum(sample + 2, n + 2)]
    order = np.argsort(triples, kind="stable")
    new = np.concatenate([[True], np.diff(triples[order]) != 0])
    names = np.empty(sample.size, np.int64)
    names[order] = np.cumsum(new) - 1
    if not new.all():
        names = suffix_ranks(names)
    rank = np.full(n + 3, -1, np.int64)
    rank[sample] = names
    zeros = np.arange(0, n, 3)
    m = sample.size + 2
    one = lambda i: t[i] * m + rank[i + 1] + 1  # noqa: E731  first byte, then the sampled rank behind it
    r2 = np.unique(t, return_inverse=True)[1] if t.max() >= 1 << 20 else t
    two = lambda i: ((r2[i] << 21) | r2[i + 1]) * m + rank[i + 2] + 1
    k0 = one(zeros)
    by0 = np.argsort(k0, kind="stable")
    zeros = zeros[by0]
    place0 = np.empty(n, np.int64)
    place0[zeros] = np.arange(zeros.size)
    real = sample < n
    sorted_sample = np.empty(sample.size, np.int64)
    sorted_sample[names] = sample
    sorted_sample = sorted_sample[sorted_sample < n]
    final = np.empty(n, np.int64)
    is1 = sorted_sample % 3 == 1
    s1, s2 = sorted_sample[is1], sorted_sample[~is1]
    k1, k2 = one(s1), two(s2)
    z1, z2 = k0[by0], two(zeros)
    final[zeros] = np.arange(zeros.size) + np.searchsorted(k1, z1) + np.searchsorted(k2, z2)
    place = np.arange(sorted_sample.size)
    final[s1] = place[is1] + np.searchsorted(z1, k1)
    final[s2] = place[~is1] + np.searchsorted(z2, k2)
    assert real.sum() + zeros.size == n
    return final


def equal_groups(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A number for each position in `at`, equal where the `length` bytes from there are: neighbours in suffix order are compared."""
    rank = suffix_ranks(text.astype(np.int64))
    order = np.argsort(rank[at], kind="stable")
    p = at[order]
    words = np.zeros(text.size + 8, np.uint8)
    words[: text.size] = text
    wide = np.lib.stride_tricks.as_strided(words.view(), (text.size, 8), (1, 1))
    same = np.ones(max(0, p.size - 1), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        i = np.flatnonzero(same)
        same[i] = (wide[p[i] + k] == wide[p[i + 1] + k]).all(axis=1)
    group = np.empty(at.size, np.int64)
    group[order] = np.cumsum(np.concatenate([[0], ~same])) if p.size else []
    return group


def _shares(part: np.ndarray, n: int):
    """(part, indices in order) of each part that has any."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n + 1))
    return [(k, order[a:b]) for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]


def _classes(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each class in order, which class each is of)."""
    order = np.lexsort((g, h))
    new = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)]) if h.size else np.zeros(0, bool)
    of = np.empty(h.size, np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]  # lexsort is stable: the first of each class
    by = np.argsort(first, kind="stable")
    back = np.empty(first.size, np.int64)
    back[by] = np.arange(first.size)
    return first[by], back[of] if h.size else of


def repeats(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", cut: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); with cut, the rows of `docs` with what is left of their texts instead.

    A cut text loses the bytes of characters that are cut in half too; null texts stay null.

    Null texts count as empty. Texts shorter than `length` are kept whole. Rows with equal ids are told apart by their
    order in the packs: one of them counts as the earlier. Strings are judged on the input, and never cross documents."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark, names = docs.sparkSession, docs.columns
    source = packs(docs, text, doc_id, keep=cut)
    total = source.agg(F.sum("raw")).first()[0] or 0
    n_parts = parts_for(spark, total)

    def found(body):
        ids, starts, raw = pack_texts(body)
        runs = Runs(length).of(starts, raw)
        return ids, starts, raw, runs

    def ask(pack, body):
        ids, starts, _, (s, _, _, h, g) = found(body)
        first, _ = _classes(h, g)
        doc = np.searchsorted(starts, s[first], "right") - 1
        h, g = h[first], g[first]
        for part, i in _shares((h % U(n_parts)).astype(np.int64), n_parts):
            held, of = np.unique(doc[i], return_inverse=True)
            yield part, len(i).to_bytes(4, "little") + h[i].tobytes() + g[i].tobytes() + blob(np.diff(of, prepend=0).astype(np.uint16), ids[held])

    def answer(pack_ids, got):
        hs, gs, docs_, sizes = [], [], [], []
        for body in got:
            n = int.from_bytes(body[:4], "little")
            hs.append(np.frombuffer(body, U, n, 4))
            gs.append(np.frombuffer(body, U, n, 4 + 8 * n))
            delta, ids = unblob(body[4 + 16 * n :])
            docs_.append(ids[np.cumsum(delta)])
            sizes.append(n)
        h, g, doc = map(np.concatenate, (hs, gs, docs_))
        told = np.zeros(h.size, np.uint8)
        by = np.argsort(h, kind="stable")
        same = np.diff(h[by]) == 0
        shared = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if shared.size:
            shared.sort()
            order = shared[np.lexsort((shared, doc[shared], g[shared], h[shared]))]
            new_h = np.concatenate([[True], np.diff(h[order]) != 0])
            new = new_h | np.concatenate([[True], np.diff(g[order]) != 0])
            of = np.cumsum(new_h) - 1
            kinds = np.bincount(of, weights=new).astype(np.int64)[of]
            told[order] = np.where(~new, 1, np.where(kinds > HOT, 3, np.where(kinds > 1, 2, 0)))
        for p, x in zip(pack_ids.tolist(), np.split(told, np.cumsum(sizes)[:-1])):
            yield p, blob(x)

    replies = written(at_parts(to_parts(source, ask), n_parts, answer), "classes")
    settle(spark)

    def resolve(pack, body, told):
        ids, starts, raw, (s, size, p, h, g) = found(body)
        first, of = _classes(h, g)
        state = np.zeros(first.size, np.uint8)
        for part, i in _shares((h[first] % U(n_parts)).astype(np.int64), n_parts):
            state[i] = unblob(told[0][part])[0]
        own = np.zeros(s.size, bool)
        own[first] = True
        state = np.where(own, state[of], 1) if s.size else state
        state[(state == 0) & ~own] = 1
        gone = state == 1
        ask2 = state == 2
        rs, rn, rh, ranchor = s[ask2], size[ask2], h[ask2], p[ask2]
        if (hot := np.flatnonzero(state == 3)).size:  # one window each, sent once by a pack; keyed by the window's own hash
            at = np.repeat(s[hot], size[hot]) + (np.arange(size[hot].sum()) - np.repeat(np.cumsum(size[hot]) - size[hot], size[hot]))
            digest = np.array([int.from_bytes(hashlib.blake2b(raw[i : i + length].tobytes(), digest_size=8).digest(), "little") for i in at.tolist()], U)
            _, head, back = np.unique(digest, return_index=True, return_inverse=True)
            repeat = head[back] != np.arange(at.size)
            later = np.zeros(at.size, bool)
            for k in np.flatnonzero(repeat).tolist():
                later[k] = bytes(raw[at[k] : at[k] + length]) == bytes(raw[at[head[back[k]]] : at[head[back[k]]] + length])
            gone_at = at[later]
            at, digest = at[~later], digest[~later]
            rs, rn, rh, ranchor = np.concatenate([rs, at]), np.concatenate([rn, np.ones(at.size, np.int64)]), np.concatenate([rh, digest]), np.concatenate([ranchor, at])
        else:
            gone_at = np.zeros(0, np.int64)
        order = np.argsort(rs, kind="stable")
        rs, rn, rh = rs[order], rn[order], rh[order]
        rows = [(-1, pack, blob(np.concatenate([s[gone], gone_at]), np.concatenate([size[gone], np.ones(gone_at.size, np.int64)]), rs, rn, rh))]
        doc = np.searchsorted(starts, rs, "right") - 1
        for part, i in _shares((rh % U(n_parts)).astype(np.int64), n_parts):
            lens = rn[i] + length - 1
            at = np.repeat(rs[i] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            rows.append((part, pack, blob(rh[i], ids[doc[i]], rn[i].astype(np.int32), raw[at])))
        part, pk, out = zip(*rows)
        return pa.table({"part": pa.array(part, pa.int32()), "pack": pa.array(pk, pa.int64()), "body": pa.array(out, pa.binary())})

    asked = written(at_packs(source, [replies], resolve, "part int, pack long, body binary"), "contexts", "uncompressed")
    dropped(replies)
    settle(spark)

    def judge(pack_ids, got):
        rows = [unblob(x) for x in got]
        counts = [x[0].size for x in rows]
        h, doc, size = (np.concatenate([x[k] for x in rows]) for k in range(3))
        raw, size = np.concatenate([x[3] for x in rows]), size.astype(np.int64)
        lens = size + length - 1
        begin = np.cumsum(lens) - lens
        wins = np.zeros(int(size.sum()), bool)
        win0 = np.cumsum(size) - size
        by = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(h[by]) != 0, [True]]))
        k = 0
        grown = np.concatenate([[0], np.cumsum(lens[by])])
        while k < edges.size - 1:  # as many whole grams as fit in a sort
            to = max(k + 1, int(np.searchsorted(grown[edges], grown[edges[k]] + SORT_BYTES, "right")) - 1)
            i = by[edges[k] : edges[to]]
            k = to
            if i.size < 2:
                continue
            i = i[np.lexsort((i, doc[i]))]  # by document; of one document they come from one pack, in order
            n = lens[i]
            text = raw[np.repeat(begin[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            m = size[i]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            group = equal_groups(text, np.repeat(np.cumsum(n) - n, m) + step, length)
            later = np.ones(group.size, bool)
            later[np.unique(group, return_index=True)[1]] = False
            wins[(np.repeat(win0[i], m) + step)[later]] = True
        at = 0
        for p, c in zip(pack_ids.tolist(), counts):
            n = int(size[at : at + c].sum())
            a = int(win0[at]) if c else 0
            yield p, blob(wins[a : a + n].astype(np.uint8))
            at += c

    verdicts = written(at_parts(asked.where("part >= 0"), n_parts, judge), "verdicts")
    settle(spark)

    schema = docs.schema if cut else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(pack, body, told):
        ids, starts, raw = pack_texts(body)
        gs, gn, rs, rn, rh = unblob(told[0][-1])
        for part, i in _shares((rh % U(n_parts)).astype(np.int64), n_parts):
            bits = unblob(told[1][part])[0].astype(bool)
            at = np.repeat(rs[i] - (np.cumsum(rn[i]) - rn[i]), rn[i]) + np.arange(int(rn[i].sum()))
            gs, gn = np.concatenate([gs, at[bits]]), np.concatenate([gn, np.ones(int(bits.sum()), np.int64)])
        edge = np.zeros(raw.size + 1, np.int32)
        np.add.at(edge, gs, 1)
        np.add.at(edge, gs + gn + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        begins[starts[:-1][starts[:-1] < raw.size]] |= gone[starts[:-1][starts[:-1] < raw.size]]
        taken, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
        kept = [raw[a:b][~gone[a:b]].tobytes() if taken[b] > taken[a] else raw[a:b].tobytes() for a, b in itertools.pairwise(starts.tolist())]
        if cut:
            return unpacked_rows(told[2][-1], kept, names, text)
        return pa.table({"doc_id": id_column(ids), "n_bytes": pa.array(np.diff(starts)), "n_removed": pa.array(np.diff(taken[starts])), "n_spans": pa.array(np.diff(spans[starts])), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})

    answers = [asked.where("part < 0"), verdicts]
    if cut:
        answers.append(source.select(F.lit(-1).alias("part"), "pack", F.col("rest").alias("body")))
    return at_packs(source, answers, finish, schema)
