"""Words of texts as numbers: each distinct word is handled once for each Python worker, texts then go through numpy."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

#: Distinct words that a worker holds; beyond, it starts afresh, with the same results.
MOST_WORDS = 400_000
#: Characters below this have settled Unicode classes, no combining marks and one lower case each (but U+0130).
PLAIN_END = 0x250


def _ranges(kind: str) -> str:
    """The characters below PLAIN_END of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _ranges("L"), _ranges("N")
_S = "\t\n\x0b\x0c\r \x85\xa0"
#: Texts that the patterns below divide as the tokenizers' own do.
NOT_PLAIN = re.compile(f"[^\x00-{chr(PLAIN_END - 1)}]|İ|<\\|")
#: The tokenizers' own patterns, written for plain characters.
BYTE_BPE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_BPE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class Numbered(dict):
    """word -> its number; a new word is put down in `new`."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Pieces:
    """Words to arrays of ids, through spell(words) -> (ids one after another, number of ids of each word), which sees a new word once."""

    def __init__(self, spell, dtype=np.uint32, most: int = MOST_WORDS):
        self.spell, self.dtype, self.most = spell, dtype, most
        self.hold([], np.zeros(0, dtype), np.zeros(0, np.int64))

    def hold(self, words: list, flat: np.ndarray, lens: np.ndarray):
        self.numbers = Numbered()
        self.numbers.update(zip(words, range(len(words))))
        self.flat = np.zeros(max(1 << 16, 2 * flat.size), self.dtype)
        self.flat[: flat.size] = flat
        self.starts = np.zeros(max(1 << 14, 2 * len(words)) + 1, np.int64)  # of word n, with the end of the last
        self.starts[1 : len(words) + 1] = np.cumsum(lens)
        self.uses = np.zeros(self.starts.size, np.int64)
        self.count = len(words)

    def _learn(self):
        new = self.numbers.new
        if not new:
            return
        flat, lens = self.spell(new)
        at, n = int(self.starts[self.count]), self.count
        end = at + len(flat)
        while end > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) + 1 > self.starts.size:
            self.starts, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.uses))
        self.flat[at:end] = flat
        self.starts[n + 1 : n + 1 + len(new)] = at + np.cumsum(lens)
        self.count += len(new)
        self.numbers.new = []

    def _forget(self):
        """Keeps the words used most often, a third of those that may be held."""
        n = self.count
        uses, lens = self.uses[:n], np.diff(self.starts[: n + 1])
        keep = np.zeros(n, bool)
        keep[np.argpartition(uses, n - self.most // 3)[n - self.most // 3 :]] = True
        keep &= uses > 1
        flat = self.flat[: int(self.starts[n])][np.repeat(keep, lens)]
        self.hold([w for w, k in zip(self.numbers, keep.tolist()) if k], flat, lens[keep])

    def ids(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if self.count > self.most:
            self._forget()
        find = self.numbers.__getitem__
        of = np.array([len(t) for t in texts], np.int64)
        w = np.fromiter((n for t in texts for n in map(find, t)), np.int64, int(of.sum()))
        self._learn()
        self.uses[: self.count] += np.bincount(w, minlength=self.count)
        starts = self.starts[w]
        lens = self.starts[w + 1] - starts
        ends = np.cumsum(lens)
        at = np.repeat(starts - (ends - lens), lens)
        at += np.arange(at.size)
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(of)])]
        return self.flat[at], np.diff(stops)


def listed(spelt: list[list[int]]) -> tuple[list[int], list[int]]:
    """What a spell() returns, from lists of ids."""
    return [i for x in spelt for i in x], [len(x) for x in spelt]


class Hashes:
    """Words (bytes) to 64-bit hashes, one text at a time."""

    def __init__(self, most: int = MOST_WORDS):
        self.most, self.known = most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            return np.array([known[w] for w in words], np.uint64)


def per_worker(key, make):
    """One object for each key and Python worker."""
    held = sys.modules.setdefault("_loomgrid_held", type(sys)("_loomgrid_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def ascii_words(body: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case: for bytes, Python's own split and lower do just that."""
    return body.lower().split()


def word_bpe(path: str):
    """encode(texts) -> (ids, counts) for a lower-casing BPE whose words end in </w>, as the tokenizers library encodes; for one Python worker."""
    import json
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def spell(words):
        """Words joined by blanks: the last token of each is marked as such."""
        got = library.encode_batch([" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in got])
        lens = np.diff(np.flatnonzero(last[ids]), prepend=-1)
        if lens.size != len(words):
            return listed([library.encode(w, add_special_tokens=False).ids for w in words])
        return ids, lens

    pieces = Pieces(spell)

    def encode(texts: list[str]):
        plain = [not NOT_PLAIN.search(x) for x in texts]
        ids, counts = pieces.ids([WORD_BPE.findall(x.lower()) if p else [] for x, p in zip(texts, plain)])
        return ids, counts, {i: library.encode(x, add_special_tokens=False).ids for i, (x, p) in enumerate(zip(texts, plain)) if not p}

    return encode


def byte_characters() -> dict[str, int]:
    """The byte that each character stands for in the token strings of byte-level vocabularies: printable Latin-1 for itself, the others numbered from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_vocabulary(path: str) -> tuple[list[bytes], dict[str, int], list[tuple[int, int]]]:
    """(bytes of each token by id, ids of the added tokens, merges as pairs of ids in order of rank) of a byte-level BPE file."""
    import json

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    to_byte, vocab = byte_characters(), file["model"]["vocab"]
    spelt = lambda t: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
    added = {x["content"]: x["id"] for x in file["added_tokens"]}
    tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in [*vocab.items(), *added.items()]:
        tokens[i] = spelt(t)
    merges = [x.split(" ") if isinstance(x, str) else x for x in file["model"]["merges"]]
    return tokens, added, [(vocab[a], vocab[b]) for a, b in merges]


def byte_bpe(path: str):
    """encode(text) -> numpy ids of a byte-level BPE, as the tokenizers library encodes; for one Python worker.

    Plain texts go through tiktoken over the same merges, which needs ids in the order of the ranks (checked here);
    all others through the tokenizers library itself."""
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    tokens, added, merges = byte_vocabulary(path)
    first = len(tokens) - len(added) - len(merges)
    ranked = all(tokens[first + k] == tokens[a] + tokens[b] for k, (a, b) in enumerate(merges))
    if not ranked:
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={tokens[i]: i for i in range(first + len(merges))}, special_tokens={})

    def encode(text: str):
        if NOT_PLAIN.search(text):
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(quick.encode_ordinary(text), np.uint32)

    return encode


def as_text(body: bytes) -> str:
    return body.decode("utf-8", "replace")
