"""Documents linked by the Jaccard similarity of their word shingles.

Equal sets are one class (a 128-bit hash of the set). Then:

1. Sharing. With similarity t, a set of n has at least n - floor((1 - t) n) shingles in common with any partner. Each
   class sends the shingles below a bound on their hash (all, for small sets) to the hash's part, which answers whether
   another class of a fitting size has it too, and with a label: the least class that has it and is linked with this
   one by a chain of fitting sizes. Classes that lack too many shared shingles have no link at all. The bound leaves
   twice as many shingles as may be lacking, so a shared passage or common lines alone keep no class.
2. Tiles. The classes left are put in bands of sizes, t ** WIDE apart in ratio, so that partners are in the same band or
   in neighbouring ones; a class so near to the band below that it may have partners there is that band's guest too.
   Bands are divided into tiles by labels. Two linked classes have the label of each shingle that they share, so a class
   goes to the tiles of its labels (see kept_labels() for those it may leave out). Shingles that the same classes share
   have one label: a class has a label for each group of copies or passage that it takes part in, not for each shingle,
   and the tiles of a band are as many as these copies of classes fill, so that sets move a few times in tables of any
   size. A tile of more than MOST classes, or of sets of more than MOST_BYTES, is divided into blocks, and pairs of
   blocks are tiles of their own.
3. In a tile, bitmaps of hashed shingles (parity, so that the bits in which two differ bound from below the shingles
   in which the sets differ, and so the overlap from above) leave few pairs, of which the sorted sets themselves are
   intersected. Pairs that are already connected within the tile are skipped: the components stay the same.
4. Components over classes: a row for each connecting link, no list of pairs within a group. A class is named by its
   least document and its hash, so the least class of a component tells the component's least document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, at_packs, at_parts, blob, dropped, mix, pack_list, packs, parts_for, settle, small, spread_join, to_parts, unblob, unpacked_rows, written
from .components import components
from .words import Hashes, ascii_words, per_worker

#: Classes (copies of them) for each tile of a band, classes of a tile beyond which it is divided, widths of bands, and the size up to which all shingles of a set are sent.
BLOCK, MOST, WIDE, SMALL = 4096, 8192, 4, 64
#: Bytes of a tile's sets beyond which it is divided too: a task holds two blocks.
MOST_BYTES = 64 << 20
U = np.uint64


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words, given the words' hashes; of all words as one run if there are fewer; none without words."""
    if not words.size:
        return words
    m = min(k, words.size)
    h = np.full(words.size - m + 1, m, U)
    for i in range(m):
        h = mix(h + words[i : words.size - m + 1 + i] * U(2 * i + 1))
    return np.unique(h)


class Sets:
    def __init__(self, k: int):
        self.k, self.hashes = k, Hashes()

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        return [shingles(self.hashes.of(ascii_words(t)), self.k) for t in texts]


def set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def lacking(n: int, num: int, den: int) -> int:
    """Most shingles of a set of n that a partner may lack: |x - y| = n - i, where i >= num / den * n at least."""
    return n - -(-n * num // den)


def tile_links(sizes: np.ndarray, sets: list[np.ndarray], upper: np.ndarray, block: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Connecting links (indices) of pairs of a tile. upper: which are guests of the band above, whose own pairs other tiles compare; block: which of two blocks each is of, so that pairs are between them, or one value for all."""
    n = len(sets)
    bits = max(64, 1 << math.ceil(math.log2(max(1, int(sizes.max())))))
    maps = np.zeros((n, bits // 64), U)
    for i, s in enumerate(sets):
        at = (s & U(bits - 1)).astype(np.int64)
        odd = np.flatnonzero(np.bincount(at, minlength=bits) & 1)
        np.bitwise_or.at(maps[i], odd >> 6, U(1) << (odd & 63).astype(U))
    order = np.lexsort((np.arange(n), sizes))
    sizes, maps, upper, block = sizes[order], maps[order], upper[order], block[order]
    sets = [sets[i] for i in order.tolist()]
    two = bool((block != block[0]).any())
    home = np.arange(n)
    out = []
    for i in range(n):
        ni = int(sizes[i])
        hi = int(np.searchsorted(sizes, ni * den // num, "right"))
        j = np.arange(i + 1, hi)
        j = j[home[j] != home[i]]
        if upper[i]:
            j = j[~upper[j]]
        if two:
            j = j[block[j] != block[i]]
        if not j.size:
            continue
        # overlap <= (n_i + n_j - differing) / 2, and it must be at least num / (num + den) * (n_i + n_j)
        total = ni + sizes[j]
        first = np.bitwise_count(maps[j, 0] ^ maps[i, 0])
        j = j[(total - first) * (num + den) >= 2 * num * total]
        if j.size:
            total = ni + sizes[j]
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
            j = j[(total - differ) * (num + den) >= 2 * num * total]
        for k in j.tolist():
            if home[k] == home[i]:
                continue
            at = np.searchsorted(sets[k], sets[i])
            at[at == sets[k].size] = 0
            common = int((sets[k][at] == sets[i]).sum())
            if den * common >= num * (ni + int(sizes[k]) - common):
                out.append((int(order[i]), int(order[k])))
                home[home == home[k]] = home[i]
    return out


def lead(n: int, num: int, den: int) -> int:
    """How many of the least hashes of a set of n must hold one in common with any partner."""
    return min(n, lacking(n, num, den) + 1)


def kept_labels(labels: np.ndarray, hit: np.ndarray, below: int, n: int, num: int, den: int, fitting: int) -> np.ndarray:
    """The labels by which a set of n meets its partners, of those of its shared shingles.

    labels, hit: of the shingles that were sent, least hash first; below: how many of them lie below the bound.
    Sets of less than `fitting` meet partners of less than fitting / t, so the shingles of both leads do. A larger set
    lacks lacking(n) at most, so it shares m = below - lacking(n) shingles below the bound, or more, with any partner:
    the same ones seen from either side, so the larger m holds for both. A set leaves out labels of less than m / 2 of
    them in all. Then both together leave out less than the larger m, and one shingle is left whose label neither does.
    Between these two are sizes with partners of either kind, which leave out none. A set of too few below the bound has
    sent its lead, and leaves out none: a partner that has left out some meets it below the bound, others by the lead."""
    if n < fitting:
        p = lead(n, num, den)
        return np.unique(labels[:p][hit[:p]])
    kinds, counts = np.unique(labels[hit], return_counts=True)
    if n < fitting * den // num + 2:
        return kinds
    order = np.argsort(counts, kind="stable")
    return kinds[order[np.cumsum(counts[order]) > (below - lacking(n, num, den) - 1) // 2]]


def _classed(docs: DataFrame, k: int, num: int, den: int, text: str, doc_id: str, keep_rows: bool):
    """(packs, documents (pack, place, doc_id, n, class, and for one document of each pack and class that may have links: near, body), number of documents)."""
    spark = docs.sparkSession
    source = packs(docs, text, doc_id, keep=keep_rows)
    total = source.agg(F.sum("raw").alias("raw"), F.sum("docs").alias("docs")).first()
    n_parts = parts_for(spark, total["raw"] or 0)
    share = min(1.0, 2 * (den - num) / den)
    few, fitting = SMALL, SMALL * den // num + 2

    def sent_below(n: int, limit: int) -> np.uint64:
        return U(2**64 - 1) if n < limit else U(min(2**64 - 1, int(share * 2**64)))

    def sets_of(body):
        ids, texts = pack_list(body)
        return ids, per_worker(("shingles", k), lambda: Sets(k)).of(texts)

    def firsts(sets):
        """Index of the first document of each distinct set that isn't empty."""
        return list({set_key(s): i for i, s in reversed(list(enumerate(sets))) if s.size}.values())[::-1]

    def sent(sets, rows):
        """(document's place in rows, hash) of what is sent, one after another: all below the bound, and the lead."""
        parts = [sets[i][: max(int(np.searchsorted(sets[i], sent_below(sets[i].size, fitting), "right")), lead(sets[i].size, num, den))] for i in rows]
        return np.repeat(np.arange(len(rows)), [x.size for x in parts]), np.concatenate(parts) if parts else np.zeros(0, U)

    def shares(h):
        part = ((h & U(0xFFFFFFFF)) % U(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
        return [(p, order[a:b]) for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]

    def ask(pack, body):
        _, sets = sets_of(body)
        rows = firsts(sets)
        of, h = sent(sets, rows)
        keys = np.array([int.from_bytes(set_key(sets[i])[:8], "little") for i in rows], U)
        sizes = np.array([sets[i].size for i in rows], np.int64)
        for part, i in shares(h):
            held, at = np.unique(of[i], return_inverse=True)
            yield part, len(i).to_bytes(4, "little") + (h[i] >> U(32)).astype(np.uint32).tobytes() + blob(np.diff(at, prepend=0).astype(np.int32), keys[held], sizes[held])

    def answer(pack_ids, got):
        hs, ks, ns, counts = [], [], [], []
        for body in got:
            n = int.from_bytes(body[:4], "little")
            hs.append(np.frombuffer(body, np.uint32, n, 4))  # the other half is the part, nearly: hashes taken for equal wrongly are a few in ten thousand, and lose no link
            step, keys, sizes = unblob(body[4 + 4 * n :])
            at = np.cumsum(step)
            ks.append(keys[at])
            ns.append(sizes[at])
            counts.append(n)
        h, key, size = map(np.concatenate, (hs, ks, ns))
        told, label = np.zeros(h.size, bool), np.zeros(h.size, np.uint32)
        by = np.argsort(h, kind="stable")
        same = np.diff(h[by]) == 0
        shared = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if shared.size:
            order = shared[np.lexsort((key[shared], size[shared], h[shared]))]
            # of each hash the classes by size: the nearest other class on either side decides
            a, b = order[:-1], order[1:]
            new = (h[a] != h[b]) | (key[a] != key[b])
            start = np.flatnonzero(np.concatenate([[True], new]))
            one = order[start]  # a row for each class of each hash
            of = np.cumsum(np.concatenate([[0], new]))
            fits = (h[one[:-1]] == h[one[1:]]) & (size[one[:-1]] * den >= size[one[1:]] * num)
            told[order] = (np.concatenate([[False], fits]) | np.concatenate([fits, [False]]))[of]
            chains = np.flatnonzero(np.concatenate([[True], ~fits]))
            least = np.minimum.reduceat(key[one], chains) & U(0xFFFFFFFF)
            label[order] = np.repeat(least, np.diff(chains, append=one.size))[of]
        ends = np.cumsum(counts)[:-1]
        for p, x, y in zip(pack_ids.tolist(), np.split(told, ends), np.split(label, ends)):
            yield p, blob(np.packbits(x), y[x])

    replies = written(at_parts(to_parts(source, ask), n_parts, answer), "shared")
    settle(spark)

    def keep(pack, body, told):
        """A row for each document, with the set of each class that may have links."""
        ids, sets = sets_of(body)
        rows = firsts(sets)
        of, h = sent(sets, rows)
        hit, labels = np.zeros(h.size, bool), np.zeros(h.size, np.uint32)
        for part, i in shares(h):
            bits, own = unblob(told[0][part])
            hit[i] = np.unpackbits(bits, count=i.size).astype(bool)
            labels[i[hit[i]]] = own
        out, near = [None] * len(sets), [None] * len(sets)
        ends = np.searchsorted(of, np.arange(len(rows) + 1))
        for r, i in enumerate(rows):
            s, a, b = sets[i], ends[r], ends[r + 1]
            tested = int(np.searchsorted(h[a:b], sent_below(s.size, few), "right"))
            if tested - int(hit[a : a + tested].sum()) > lacking(s.size, num, den):
                continue
            if (own := kept_labels(labels[a:b], hit[a:b], tested, s.size, num, den, fitting)).size:
                out[i], near[i] = s.tobytes(), own.view(np.int32).tolist()
        keys = [set_key(s) if s.size else None for s in sets]
        n = len(sets)
        return pa.table({"pack": pa.array([pack] * n, pa.int64()), "place": pa.array(range(n), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "n": pa.array([s.size for s in sets], pa.int64()), "class": pa.array(keys, pa.binary()), "near": pa.array(near, pa.list_(pa.int32())), "body": pa.array(out, pa.binary())})

    all_docs = written(at_packs(source, [replies], keep, "pack long, place int, doc_id long, n long, class binary, near array<int>, body binary"), "sets")
    dropped(replies)
    settle(spark)
    return source, all_docs, total["docs"] or 0


def _tiles(all_docs: DataFrame, num: int, den: int) -> DataFrame:
    """(to: band, tile, i, j: blocks, class, least, n, upper, block, body): a row for each copy of a class that may have links."""
    step = WIDE * math.log(den / num) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    below = F.floor(F.log(F.col("n") * (num / den * (1 - 1e-9))) / F.lit(step)).cast("int")  # the band of the least partner
    sides = F.array_distinct(F.array(F.struct(F.col("band").alias("to"), F.lit(False).alias("upper")), F.struct(below.alias("to"), (below < F.col("band")).alias("upper"))))
    own = all_docs.where("body is not null")

    def hosted(classes):
        return classes.withColumn("band", band).withColumn("_x", F.explode(sides)).select("*", "_x.*").drop("_x", "band")

    # bands of sizes are a hundred at most; one that is more than a tile has a tile for every BLOCK copies of classes and guests
    copies, size = F.size("near"), F.col("n") * 8
    filled = lambda times: F.greatest(F.sum(times) / BLOCK, F.sum(times * size) * 2 / MOST_BYTES)
    bands = hosted(own.select("class", "n", "near").dropDuplicates(["class"])).groupBy("to").agg(F.when(filled(F.lit(1)) <= 1, 1).otherwise(F.ceil(filled(copies))).cast("long").alias("tiles"), F.min("upper").alias("guests")).where("not guests").drop("guests")
    bands = written(bands, "bands")
    bands = small(bands, bands.count())

    def put(classes):
        out = hosted(classes).join(bands, "to")
        return out.withColumn("tile", F.explode(F.array_distinct(F.transform("near", lambda h: F.pmod(h, F.col("tiles")))))).drop("near", "tiles")

    full = put(own.select("class", "n", "near").dropDuplicates(["class"])).groupBy("to", "tile").agg(F.greatest(F.ceil(F.count("*") / MOST), F.ceil(F.sum("n") * 8 / MOST_BYTES)).cast("int").alias("blocks"))
    full = written(full.where("blocks > 1"), "full_tiles")
    classes = own.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("near").alias("near"), F.first("body").alias("body"))
    tiles = put(classes).join(small(full, full.count()), ["to", "tile"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "_x"), "j": F.greatest("block", "_x")})
    return tiles.select("to", "tile", "i", "j", "class", "least", "n", "upper", "block", "body")


def _components(all_docs: DataFrame, num: int, den: int) -> DataFrame:
    """(class, component: (least, class) of the least class it is linked with) of classes with links."""

    def compare(group: pa.Table) -> pa.Table:
        keys, sets = group.column("class").to_pylist(), [np.frombuffer(x, U) for x in group.column("body").to_pylist()]
        least = group.column("least").to_pylist()
        found = tile_links(group.column("n").to_numpy(), sets, group.column("upper").to_numpy(zero_copy_only=False), group.column("block").to_numpy(), num, den) if len(sets) > 1 else []
        ends = {f"{c}{end}": pa.array([x[pair[at]] for pair in found], kind) for at, end in enumerate("ab") for c, x, kind in (("least_", least, pa.int64()), ("class_", keys, pa.binary()))}
        return pa.table(ends)

    links = _tiles(all_docs, num, den).groupBy("to", "tile", "i", "j").applyInArrow(compare, "least_a long, class_a binary, least_b long, class_b binary")
    node = lambda end: F.struct(F.col(f"least_{end}").alias("least"), F.col(f"class_{end}").alias("class")).alias(end)
    return components(links.select(node("a"), node("b"))).select(F.col("node.class").alias("class"), "component")


def linked(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id: the least doc_id reachable by links of similarity num / den or more), a row for each row of `docs`.

    Documents without words, and null texts, have no shingles and no links. Every row is a document of its own: rows that
    repeat an id are linked by their texts like others, not by the id. A null doc_id counts as the least, and a component
    that holds one has a null component_id."""
    source, all_docs, total = _classed(docs, k, num, den, text, doc_id, False)
    dropped(source)
    of = _components(all_docs, num, den)
    known = all_docs.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n"))
    known = known.join(of, "class", "left").select("class", F.coalesce("component.least", "least").alias("component_id"), "_n")
    rows = all_docs.select("doc_id", F.col("n").alias("n_shingles"), "class")
    out = spread_join(rows.where("class is not null"), written(known, "known"), "class", total).drop("class")
    out = out.unionByName(rows.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.select(back("doc_id"), "n_shingles", back("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns, without those linked with a row of a smaller id: one row of each group stays.

    Of rows with the group's least id (null is the least) one stays. Rows without words are in no group and all stay."""
    names = docs.columns
    source, all_docs, total = _classed(docs, k, num, den, text, doc_id, True)
    of = _components(all_docs, num, den)
    row = F.struct("doc_id", "pack", "place")
    known = written(all_docs.where("class is not null").groupBy("class").agg(F.min(row).alias("first"), F.count("*").alias("_n")).join(of, "class", "left").withColumn("component", F.coalesce(F.col("component.class"), F.col("class"))), "known")
    winners = known.groupBy("component").agg(F.min("first").alias("winner"))
    # the classes in which a winner is; rows of all others go
    lost = known.select("class", "first", "_n").join(winners.select(F.col("winner").alias("first")), "first", "left_semi").select("class", "first", F.lit(True).alias("won"))
    known = written(known.select("class", "_n").join(lost, "class", "left"), "first_rows")
    rows = all_docs.where("class is not null").select("pack", "place", "doc_id", "class")
    going = spread_join(rows, known, "class", total).where(~(F.coalesce("won", F.lit(False)) & (F.struct("doc_id", "pack", "place") == F.col("first"))))
    going = going.groupBy("pack").agg(F.collect_list("place").alias("places"))  # a pack holds 65,536 rows at most

    def rest(batches):
        for batch in batches:
            for body, others, places in zip(*(batch.column(c).to_pylist() for c in ("body", "rest", "places"))):
                texts = pack_list(body)[1]
                keep = np.ones(len(texts), bool)
                keep[places or []] = False
                yield from unpacked_rows(others, texts, names, text).filter(pa.array(keep)).to_batches()

    return source.select("pack", "body", "rest").join(going, "pack", "left").mapInArrow(rest, docs.schema)
