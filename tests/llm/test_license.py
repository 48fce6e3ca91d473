"""Licence scans against plain code: base phrases word by word, every rule run without gates, suppression by comparing all pairs."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm.op11_license import Scanner, detections, licensed, settled
from loomgrid.llm.op11_rules import BASE, CONFIDENCE, PRIORITY, Rule, rules

RULES = rules()
SCANNER = Scanner(RULES)
PATTERNS = [re.compile(f" (?:{r.pattern})(?= )") for r in RULES]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """(doc's columns but its id), by all rules in turn."""
    w = words(text)
    line = " " + " ".join(w) + " "
    places = [(k, label) for phrase, label in BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    spans = []
    for k in range(len(RULES)):
        for m in PATTERNS[k].finditer(line):
            first = line[: m.start()].count(" ")
            spans.append((PRIORITY[RULES[k].form], first, first + len(m[0].split()), k))
    kept = [s for s in spans if not any(before(t, s) and t[1] <= s[1] and t[2] >= s[2] for t in spans)]
    labels = {label for _, label in places} | {RULES[s[3]].label for s in kept}
    score = 1.0
    for label in labels:
        score *= 1 - max([CONFIDENCE[RULES[s[3]].form] for s in kept if RULES[s[3]].label == label] + [CONFIDENCE["base"]] * any(x == label for _, x in places))
    return (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), pytest.approx(1 - score))


def before(t, s):
    return (-t[0], t[1] - t[2], t[1], t[3]) < (-s[0], s[1] - s[2], s[1], s[3])


def test_hundreds_of_rules_with_gates_and_names_of_their_own():
    assert len(RULES) > 500 and len({r.name for r in RULES}) == len(RULES) and all(r.gates for r in RULES)


def example(rng, tree):
    """A text that a pattern matches, from its parse tree."""
    out = ""
    for op, x in tree:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(x)
        elif kind == "IN":  # a list of characters, or one that isn't a space
            out += chr(rng.choice(x)[1]) if str(x[0][0]) == "LITERAL" else "0" if str(x[0][0]) == "RANGE" and chr(x[0][1][0]) == "0" else chr(x[0][1][0]) if str(x[0][0]) == "RANGE" else "q"
        elif kind == "BRANCH":
            out += example(rng, rng.choice(x[1]))
        elif kind == "SUBPATTERN":
            out += example(rng, x[3])
        elif kind == "MAX_REPEAT":
            low, high, inner = x
            out += "".join(example(rng, inner) for _ in range(rng.randint(low, min(high, low + 3))))
        else:
            raise ValueError(kind)
    return out


def test_every_rule_is_found_through_its_gates():
    """Examples made from each rule's own pattern: with gates the scan finds what it finds without."""
    rng = random.Random(1)
    for r in RULES:
        tree = re._parser.parse(r.pattern)
        for _ in range(4):
            text = f"Z {example(rng, tree)}, z".encode()
            found = SCANNER.scan(text)
            assert r.name in {x[0].name for x in found[1]} and found == SCANNER.scan(text, gated=False), text


@settings(max_examples=300, deadline=None, database=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12), st.integers(1, 6)), max_size=14))
def test_suppression_equals_all_pairs(spans):
    spans = [(p, a, a + n, k) for k, (p, a, n) in enumerate(spans)]
    assert settled(spans) == [not any(before(t, s) and t[1] <= s[1] and t[2] >= s[2] for t in spans) for s in spans]


TEXTS = {
    1: "This work is licensed under the GNU General Public License, version 3.", 2: "Released under the MIT License.", 3: "CC BY-NC 4.0\ncc by cc by, CC-BY-SA 4.0", 4: None, 5: "", 6: " .,\n",
    7: "// SPDX-License-Identifier: Apache-2.0\n" * 40 + "see http://www.apache.org/licenses/LICENSE-2.0", 8: "GNU General Public License", 9: "gnu general public licenses; xgnu general public license",
    10: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", 11: "Über alles: MIT LICENSE. İ mit licenseé mit  \t license",
    12: "the gnu lesser general public license version 2.1 or later, all rights reserved. under the terms of the gnu affero general public license v3", 13: "a licence to kill; the apache helicopter; by cc", 14: "mit license " * 3000,
}


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [w for t in TEXTS.values() for w in (t or "").split()[:40]] + ["license", "the", "2.0", "-", "gpl", "under"]
    texts = TEXTS | {100 + k: " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for k in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = sorted([(i, *brute(t)) for i, t in texts.items() if i != 14], key=repr)
    assert [r for r in rows_of(licensed(docs)) if r[0] != 14] == want
    (mit,) = licensed(docs.where("doc_id = 14")).collect()
    assert (mit["n_base"], mit["last_word"], mit["labels"]) == (3000, 5998, "mit")


def test_whole_table_equals_brute_force(spark, sf):
    from loomgrid.llm.queries import op11_license_scan

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows_of(op11_license_scan(spark, sf)) == sorted([(i, *brute(t)) for i, t in docs.items()], key=repr)


def test_words_are_counted_across_slices(monkeypatch):
    text = " ".join(f"w{k}" for k in range(3000)) + " Mit-License " + "é " * 500
    whole = SCANNER.scan(text.encode())
    monkeypatch.setattr("loomgrid.llm.op11_license.SLICE", 16)
    assert SCANNER.scan(text.encode()) == whole and whole[0] == 3502 and whole[1][0][1] == 3000


def test_edges(spark):
    docs = spark.createDataFrame([(None, "mit license", 1, "x"), (3, "mit license", 1, "x"), (3, "mit license", 1, "x"), (3, None, 2, None)], "doc_id long, text string, n_words int, found string")
    assert [tuple(r)[:3] for r in licensed(docs.coalesce(1)).collect()] == [(None, 2, 1), (3, 2, 1), (3, 2, 1), (3, 0, 0)]
    assert licensed(docs.where("false")).count() == 0
    own = (Rule("mine", "mine", "name", ("zz",), "zz top"),)
    assert detections(docs.withColumn("text", docs.text), of=own).selectExpr("size(found) as n").agg({"n": "sum"}).first()[0] == 0
