"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a word exactly one token can be the last one of its encoding. The automaton over the vocabulary
gives all tokens that are suffixes of a prefix; the one whose predecessor (the last token of the prefix before it) may
stand beside it is stored; back-pointers from the whole word then give the ids. No merge queue is kept, and the time is
linear in the length of the word.

Two tokens may stand side by side if no merge across their border comes first. A merge's rank exceeds those that made
its parts, so merges happen in the order of ranks: only pairs of the left token's right spine and the right token's
left spine ever meet at the border, and walking both spines in rank order decides it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bodies, id_column, text_rows
from .words import BYTE_BPE, NOT_PLAIN, Pieces, as_text, byte_vocabulary, listed, per_worker

#: Pairs of tokens whose test a worker remembers.
MOST_PAIRS = 1_000_000
NEVER = 1 << 60


class PrefixBpe:
    """encode() and decode() as the tokenizers library does with a byte-level BPE file, without truncation or padding."""

    def __init__(self, path: str):
        import ahocorasick
        import public_tokenizers

        self.tokens, self.added, merges = byte_vocabulary(path)
        self.rank = {pair: k for k, pair in enumerate(merges)}
        by_bytes = {t: i for i, t in enumerate(self.tokens) if i not in set(self.added.values())}
        self.made = {by_bytes[self.tokens[a] + self.tokens[b]]: (a, b) for a, b in reversed(merges)}
        self.suffixes = ahocorasick.Automaton()
        for t, i in by_bytes.items():
            self.suffixes.add_word(t.decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.lens = [len(t) for t in self.tokens]
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = Pieces(lambda words: listed([self.word(w.encode()) if w not in self.added else [self.added[w]] for w in words]))

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(node, rank of the merge that takes it up) from the leaf at the border to the token; side 0: its left border, 1: its right."""
        if token not in self.spines[side]:
            nodes = [token]
            while nodes[-1] in self.made:
                nodes.append(self.made[nodes[-1]][side])
            nodes.reverse()
            self.spines[side][token] = [(x, self.rank[self.made[up]]) for x, up in zip(nodes, nodes[1:])] + [(token, NEVER)]
        return self.spines[side][token]

    def beside(self, left: int, right: int, limit: int = NEVER) -> bool:
        """Whether both are left as they are when their bytes are encoded together, as far as merges below `limit` go."""
        a, b, i, k = self.spine(left, 1), self.spine(right, 0), 0, 0
        while True:
            (x, up_x), (y, up_y) = a[i], b[k]
            if (r := self.rank.get((x, y), NEVER)) < min(up_x, limit) and r <= up_y:
                return False
            if up_x == up_y == NEVER:
                return True
            if up_x <= up_y:
                i += 1
            else:
                k += 1

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if token not in self.alone:
            parts = self.made.get(token)
            self.alone[token] = parts is None or all(map(self.whole, parts)) and self.beside(*parts, limit=self.rank[parts])
        return self.alone[token]

    def word(self, word: bytes) -> list[int]:
        last, lens, pairs = [-1] * (len(word) + 1), self.lens, self.pairs
        if len(pairs) > MOST_PAIRS:
            pairs.clear()
        for end, token in self.suffixes.iter(word.decode("latin-1")):
            if last[end + 1] < 0:
                before = end + 1 - lens[token]
                if not before:
                    fits = self.whole(token)
                elif (left := last[before]) < 0:
                    continue
                elif (fits := pairs.get((left, token))) is None:
                    fits = pairs[left, token] = self.whole(token) and self.beside(left, token)
                if fits:
                    last[end + 1] = token
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= lens[last[at]]
        return out[::-1]

    def split(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text):
            return BYTE_BPE.findall(text)
        parts = self.specials.split(text) if self.specials else [text]
        return [w for p in parts for w in ([p] if p in self.added else self.pattern.findall(p))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.pieces.ids([self.split(x) for x in texts])
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()]).decode("utf-8", "replace")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document's whole text, encoded and decoded again.

    No shuffle. A null text counts as empty: no ids, the hash of no bytes. Invalid UTF-8 is read with U+FFFD."""

    def run(batches):
        bpe = per_worker(("prefix_bpe", path), lambda: PrefixBpe(path))
        for batch in batches:
            for ids, texts in bodies(batch):
                got = bpe.encode([as_text(x) for x in texts])
                yield pa.RecordBatch.from_arrays(
                    [id_column(ids), pa.array([x.size for x in got], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got], pa.string()), pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in got], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
