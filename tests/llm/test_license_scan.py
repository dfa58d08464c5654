"""License scans against a plain scan with Python's regular expressions."""

import random
import re

from judgelab.llm.license_rules import SPAN, signatures
from judgelab.llm.license_scan import by_anchor, license_scan

SCHEMA = "doc_id long, text string, found string, n_words string"
RULES = signatures()
TEXTS = [
    None, "", " \n", "no rights here", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "cc by cc by CC-BY 4.0 cc",
    "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 2 or (at your option) any later version",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Copyright (c) 2019 Some Body Ltd. All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "ÉCC BY and ccé by; gplv3; SPDX-License-Identifier: GPL-3.0-only",
    "Neither the name of the Regents nor the names of its contributors may be used to endorse or promote products", "general public license " * 40, "x " * 30000 + "all rights reserved " * 500,
    "Tous droits réservés. Alle Rechte vorbehalten.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "all all rights reserved rights reserved", "in the public domain",
]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    groups, found = by_anchor(RULES), []
    for i, w in enumerate(words):
        for no, r, pattern in groups.get(w, []):
            m = re.match(pattern, " ".join(words[i : i + SPAN]) + " ")
            if m:
                found.append((i, i + m[0].count(" "), r.priority, no, r.label, r.base))
    left = []
    for d in found:
        for e in found:
            same = e[:2] == d[:2]
            if e[0] <= d[0] and e[1] >= d[1] and ((e[2], -e[3]) > (d[2], -d[3]) if same else e[2] >= d[2]):
                break
        else:
            left.append(d)
    return len(words), [d[0] for d in found if d[5]], [d[:5] for d in left]


def test_scan_equals_brute_force(spark):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None), (None, TEXTS[5], None, None)]
    got = license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    texts = dict(enumerate(TEXTS)) | {None: TEXTS[5]}
    for r in got:
        n, base, left = brute(texts[r["doc_id"]])
        assert (r["n_words"], [d["start"] for d in r["base"]]) == (n, base)
        assert sorted((d["start"], d["stop"], d["priority"], d["no"], d["label"]) for d in r["found"]) == sorted(left), r["doc_id"]


def test_labels_of_common_notices(spark):
    got = {r["doc_id"]: {d["label"] for d in r["found"]} for r in license_scan(spark.createDataFrame([(k, t, "", "") for k, t in enumerate(TEXTS)], SCHEMA)).collect()}
    assert got[4] == {"cc-by-nc-4.0"} and got[7] == {"gpl-3.0"} and got[8] == {"gpl-2.0-or-later"} and got[9] == {"mit", "apache-2.0"}
    assert got[10] == {"copyright"} and got[11] == {"mit"} and got[13] == {"bsd-3-clause"} and got[17] == {"cc-by-nc-sa-4.0"} and got[3] == set()


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def sample(nodes, rng):
    """A string that a parsed pattern matches."""
    out = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = arg[rng.randrange(len(arg))]
            out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(rng.randint(*v)), "NEGATE": lambda v: "q"}[str(kind)](value) if str(arg[0][0]) != "NEGATE" else "q"
        elif name == "NOT_LITERAL":
            out += "q"
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name == "MAX_REPEAT":
            lo, hi, body = arg
            out += "".join(sample(body, rng) for _ in range(rng.randint(lo, min(int(hi), 8))))
        else:
            assert name == "AT", name
    return out


def test_signatures_fit_their_span_and_keyword():
    rng = random.Random(1)
    assert len(RULES) > 250
    for anchor, group in by_anchor(RULES).items():
        for _, r, pattern in group:
            for _ in range(60):
                text = sample(re._parser.parse(pattern), rng)
                assert re.match(pattern, text) and r.keyword in text and text.startswith(anchor + " ") and text.count(" ") <= SPAN, (r, text)
