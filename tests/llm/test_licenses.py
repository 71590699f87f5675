import itertools
import re
import time
from re import _parser

from careflow.llm.license_rules import PROPRIETARY, rules
from careflow.llm.licenses import BASE, license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


RULES = [(re.compile(r["regex"]), r["label"], r["priority"], r["confidence"]) for r in rules()]


def brute(text):
    """Every rule on every text, without keywords; then the same suppression, pair by pair."""
    w = words(text)
    line = " ".join(w)
    base, found = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        base += [(k, k + len(p) - 1, label, 0) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    for regex, *rule in RULES:
        for m in regex.finditer(line):
            first = line[: m.start()].count(" ")
            found.add((first, first + m.group().count(" "), *rule))
    kept = [
        a for a in found
        if not any(
            b[0] <= a[0] and a[1] <= b[1] and (b[3] < a[3] or b[3] == a[3] and b[1] - b[0] > a[1] - a[0]) for b in [*found, *base]
        )
    ]
    if base or any(a[2] != PROPRIETARY for a in kept):
        kept = [a for a in kept if a[2] != PROPRIETARY]
    first = [b[0] for b in base]
    labels = sorted({b[2] for b in base} | {a[2] for a in kept})
    score = 1.0 if base else max((a[4] for a in kept), default=0.0)
    return (len(w), len(base), min(first, default=None), max(first, default=None), ",".join(sorted({b[2] for b in base})),
            ",".join(labels), score)


TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the 'License')", "CC-BY-NC 4.0", "cc by nc sa 4.0",
    "This is under the mit license under the MIT license, cc by nc cc by nc.", "SPDX-License-Identifier: GPL-3.0-or-later",
    "GNU General Public License v3 or later; also the GNU Lesser General Public License, version 2.1", "mit dem Hund", "permit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Copyright 2020 Some One. All rights reserved.", "Creative Commons Attribution-ShareAlike 4.0 International License", "the unlicense",
    "License: BSD-3-Clause", "dual licensed under the MIT licence or the new BSD license", "GPL", "MPL 2.0", None, "", " .,! ",
    "apache license version 2", "apache license version 20", "Ünder the mit license", "x under the mit license x " * 300,
]


#: The usual spellings, with the label of each.
SPELLINGS = {
    "GPLv3": "gpl-3", "GPLv2": "gpl-2", "GNU GPLv3": "gpl-3", "LGPLv3": "lgpl-3", "AGPLv3": "agpl-3", "licensed under Apache-2.0": "apache-2",
    "Released under MIT": "mit", "BSD-3-Clause": "bsd-3", "BSD 3-Clause License": "bsd-3", "LGPLv2.1": "lgpl-2.1", "Apache License v2": "apache-2",
    "licensed under the Apache2": "apache-2", "MPLv2": "mpl-2", "Licensed as ISC": "isc", "EPL-2.0": "epl-2", "GPLv2 or later": "gpl-2+",
    "Redistributions of source code must retain the above copyright notice. All rights reserved.": "bsd",
    "(c) Some One. All rights reserved.": "proprietary", "Released under MIT. Copyright Some One, all rights reserved": "mit",
}

#: A version that follows its keyword without a space.
JOINED = ["Released under GPL2", "GPL3 or later", "LGPL2.1", "LGPL3", "AGPL3", "Licensed under the MPL2.0", "GNU GPL2 only", "gpl23"]


def spellings(parsed):
    """All strings of a regex, with one letter for what [^ ] stands for."""
    ways = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            new = [chr(arg)]
        elif op in ("NOT_LITERAL", "ANY"):
            new = ["x"]
        elif op == "IN":
            chars = ["x" if str(o) == "NEGATE" else chr(a) if str(o) == "LITERAL" else chr(a[0]) for o, a in arg]
            new = ["x"] if "x" in chars[:1] else chars
        elif op == "SUBPATTERN":
            new = spellings(arg[-1])
        elif op == "BRANCH":
            new = [w for way in arg[1] for w in spellings(way)]
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            inner = spellings(inner)
            new = [w * n for w in inner for n in {low, min(high, low + 1)}]
        else:
            assert op == "ASSERT_NOT", op
            new = [""]
        ways = list(dict.fromkeys(a + b for a, b in itertools.product(ways, new)))
    return ways


def rows_of(df):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return [(r["doc_id"], tuple(r[n] for n in names)) for r in license_scan(df).collect()]


def test_hundreds_of_rules():
    assert len({r["regex"] for r in rules()}) == len(rules()) > 1500
    assert sum(r["kind"] in ("notice", "name") for r in rules()) > 250
    for r in rules():
        assert not re.search(r["regex"], "")


def test_every_spelling_has_a_keyword():
    leads = set()
    for r in rules():
        # names and identifiers in all spellings; how they are led in, in all spellings around one name
        if r["kind"] in ("notice", "name", "tag") or r["kind"] not in leads:
            texts = spellings(_parser.parse(r["regex"]))
            leads.add(r["kind"])
        else:
            texts = spellings(_parser.parse(r["regex"]))[:1]
        for text in texts:
            assert re.fullmatch(r["regex"], text)
            assert set(text.split(" ")) & set(r["keywords"]), (r["regex"], text)
            assert "licen" in text or not r["licen"]


def test_joined_versions(documents):
    found = dict(rows_of(documents(list(enumerate(JOINED)))))
    assert [found[k] for k in range(len(JOINED))] == [brute(t) for t in JOINED]
    assert [found[k][5] for k in (0, 2, 4, 5)] == ["gpl-2", "lgpl-2.1", "agpl-3", "mpl-2"]


def test_usual_spellings(documents):
    found = dict(rows_of(documents(list(enumerate(SPELLINGS)))))
    assert {t: found[k][5] for k, t in enumerate(SPELLINGS)} == SPELLINGS
    assert [found[k] for k in range(len(SPELLINGS))] == [brute(t) for t in SPELLINGS]


def test_nested_and_repeated_detections(documents):
    parts = ["licensed under the terms of the gnu gpl version 2 or any later version", "released under the mit license", "mit license",
             "under the apache license version 2 0", "cc by nc sa 4 0", "x y", "bsd", "new bsd license", "gpl"]
    texts = [" ".join(parts[(k * a + k // b) % len(parts)] for k in range(60)) for a, b in [(1, 7), (2, 3), (4, 5), (5, 2), (7, 11)]]
    found = dict(rows_of(documents(list(enumerate(texts)))))
    assert [found[k] for k in range(len(texts))] == [brute(t) for t in texts]


def test_time_in_proportion_to_the_matches_of_one_text(documents):
    took = []
    for n in (2_000, 20_000):
        docs = documents([(1, "released under the gpl 2 and mit license " * n)])
        begin = time.perf_counter()
        (row,) = license_scan(docs).collect()
        took.append(time.perf_counter() - begin)
        assert len(row["detections"]) == 2 * n
    assert took[1] < 15 * took[0] + 5


def test_same_as_every_rule_on_every_text(documents):
    docs = documents(list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[0])])
    found = rows_of(docs)
    assert len(found) == len(TEXTS) + 2
    for i, got in found:
        assert got == brute(TEXTS[i or 0]), TEXTS[i or 0]
    assert license_scan(docs.limit(0)).count() == 0


def test_labels_that_the_rules_add():
    found = {t: brute(t)[5] for t in TEXTS if t}
    assert found["SPDX-License-Identifier: GPL-3.0-or-later"] == "gpl-3+"
    assert found["Creative Commons Attribution-ShareAlike 4.0 International License"] == "cc-by-sa"
    assert found["License: BSD-3-Clause"] == "bsd-3"
    assert found["mit dem Hund"] == ""


def test_table(table):
    texts = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    found = rows_of(table("documents"))
    assert len(found) == len(texts)
    assert any(got[1] for _, got in found)
    for i, got in found:
        assert got == brute(texts[i])
