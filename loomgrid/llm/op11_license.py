"""Licence scans: ordered signature rules over a document's words, gated by keywords; priority and containment settle overlaps.

A text's words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Joined by single spaces they
are what the rules' patterns run over, so punctuation and line breaks never matter. A rule runs only where one of its
gates is among the document's words: most documents run none, and the rest a few out of hundreds.

A detection is a span of words. In order of priority, then length, then place, then the rules' order, a detection is
suppressed if its span lies within one that was kept. Phrases of the base are counted whatever lies over them.

A document is handled by the task that reads it: nothing is shuffled, and work grows with the text. A null or empty text
has no words and no detections; ids may be null or repeat, each row gives one row. No rows: no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bodies, id_column, text_rows
from .op11_rules import CONFIDENCE, PRIORITY, Rule, rules

#: Lower-cases A-Z and makes a space of each ASCII byte that is no letter or digit.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that are divided into a list of words at once.
SLICE = 1 << 20
FOUND = "rule string, label string, form string, priority int, confidence double, first long, words int, kept boolean"


@lru_cache(None)
def scanner(given: tuple[Rule, ...] | None = None) -> Scanner:
    """One for each worker process."""
    return Scanner(list(given) if given else rules())


class Scanner:
    def __init__(self, of: list[Rule]):
        self.rules = [(r, PRIORITY[r.form]) for r in of]
        self.patterns: list = [None] * len(of)
        self.by_gate: dict[bytes, list[int]] = {}
        for k, r in enumerate(of):
            for g in r.gates:
                self.by_gate.setdefault(g.encode(), []).append(k)
        self.gates = frozenset(self.by_gate)

    def pattern(self, k: int):
        """Compiled where it is first needed."""
        if self.patterns[k] is None:
            self.patterns[k] = self.rules[k][0].compiled()
        return self.patterns[k]

    def scan(self, text: bytes, gated: bool = True) -> tuple[int, list[tuple]]:
        """(number of words, [(rule, first word, words, kept)] by first word)."""
        text = text.translate(WORDS)
        n, gates, parts, at = 0, set(), [], 0
        while at < len(text):  # a slice ends at a space
            end = text.find(b" ", at + SLICE)
            words = text[at : end if end >= 0 else len(text)].split()
            at = end if end >= 0 else len(text)
            n += len(words)
            gates |= self.gates.intersection(words)
            parts.append(b" ".join(words))
        if not gates and gated:
            return n, []
        line = b" " + b" ".join(p for p in parts if p) + b" "
        hits = []
        for k in sorted({k for g in gates for k in self.by_gate[g]}) if gated else range(len(self.rules)):
            for m in self.pattern(k).finditer(line):
                hits.append((m.start(), m.end(), k))
        if not hits:
            return n, []
        hits.sort()
        found, last, first = [], 0, 0
        for start, end, k in hits:
            first += line.count(b" ", last, start)
            last = start
            found.append((k, first, line.count(b" ", start, end)))
        kept = settled([(self.rules[k][1], a, a + w, k) for k, a, w in found])
        return n, [(self.rules[k][0], a, w, keep or self.rules[k][0].form == "base") for (k, a, w), keep in zip(found, kept)]


def settled(spans: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which of (priority, start, end, rule) stay: by falling priority, then length, then start and rule, each that doesn't lie within one that stayed.

    What stayed is held as its outermost spans, starts and ends both rising, so that one search tells."""
    out = [False] * len(spans)
    starts: list[int] = []
    ends: list[int] = []
    for i in sorted(range(len(spans)), key=lambda i: (-spans[i][0], spans[i][1] - spans[i][2], spans[i][1], spans[i][3])):
        _, a, b, _ = spans[i]
        at = bisect_right(starts, a)
        if at and ends[at - 1] >= b:
            continue
        out[i] = True
        low, high = bisect_left(starts, a), bisect_right(ends, b)  # those within this one
        starts[low:high], ends[low:high] = [a], [b]
    return out


def detections(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", of: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, found): each row's detections, kept or suppressed, by first word. of: other rules than the usual ones."""
    fields = ["rule", "label", "form", "priority", "confidence", "first", "words", "kept"]
    kinds = [pa.string()] * 3 + [pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.bool_()]
    entry = pa.struct(list(zip(fields, kinds)))

    def run(batches):
        own = scanner(of)
        for batch in batches:
            for ids, texts in bodies(batch):
                words, sizes, flat = [], [0], [[] for _ in fields]
                for body in texts:
                    n, found = own.scan(body)
                    words.append(n)
                    for r, first, length, keep in found:
                        for column, x in zip(flat, (r.name, r.label, r.form, PRIORITY[r.form], CONFIDENCE[r.form], first, length, keep)):
                            column.append(x)
                    sizes.append(len(flat[0]))
                inner = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(flat, kinds)], fields=list(entry))
                yield pa.RecordBatch.from_arrays([id_column(ids), pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)], ["doc_id", "n_words", "found"])

    return text_rows(docs, text, doc_id).mapInArrow(run, f"doc_id long, n_words long, found array<struct<{FOUND.replace(' ', ':').replace(',:', ', ')}>>")


def licensed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: the base phrases' number, outermost starts and labels, all labels that stay, and a score.

    The score is 1 - the product of (1 - confidence) over the labels, by each label's surest detection; 0 without any."""
    base = F.filter("found", lambda x: x["form"] == "base")
    stay = F.filter("found", lambda x: x["kept"])
    names = lambda xs: F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"])))
    starts = F.transform(base, lambda x: x["first"])
    sure = lambda label: F.array_max(F.transform(F.filter("stay", lambda x: x["label"] == label), lambda x: x["confidence"]))
    rows = detections(docs, text, doc_id).withColumns({"base": base, "stay": stay}).withColumns({"all": names(F.col("stay"))})
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(names(F.col("base")), ",").alias("base_labels"), F.array_join("all", ",").alias("labels"),
        (1 - F.aggregate("all", F.lit(1.0), lambda acc, label: acc * (1 - sure(label)))).alias("score"))
