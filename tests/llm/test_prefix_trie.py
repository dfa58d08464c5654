"""The prefix trie against brute force over dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from judgelab.llm import prefix_trie as m

SCHEMA = "conv_id long, turn long, role string, text string, c string, x string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((c, len(seq) == d))
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        tokens = (len(members) - 1) * len(k[-1][1].encode().split()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += tokens
            leaves[k[:d]] += k not in kids
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, e in members if e)))
        out.append((min(members)[0], len(k), min(nodes[k[:-1]])[0] if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, convs, deep=()):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.08:
            continue
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, ["user", "assistant", None][rng.integers(3)] if t > 1 else "user", ["a b", "c", "", None, "d  e f"][min(4, int(rng.integers(12)))], "clash", "clash"))
    for c, n in deep:
        rows += [(c, t, "user", f"t{t // 7} z" if t < n - 2 else f"end {c % 3}", "", "") for t in range(n)]
    return rows


@pytest.mark.parametrize("block", [4, 64])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(m, "PACK", 4)  # so that tails are ranked more than once
    rows = conversations(3, 120, [(200, 40), (201, 40), (202, 90), (203, 41), (205, 90)])
    rows += [(None, 1, "user", "lost", "", ""), (300, None, "user", "first", "", ""), (300, 0, "user", "second", "", ""), (300, 0, "assistant", "tie", "", ""), (300, 0, "assistant", "tie", "", ""), (-7, 1, "user", "below zero", "", ""), (-7, 2, "user", "a b", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = m.prefix_trie(*m.with_shared_heads(m.numbered_turns(df)), block_rows=block).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_a_third_of_all_conversations_alike(spark):
    rows = [(c, t, "user", f"same {t}", "", "") for c in range(0, 400) for t in range(4)] + conversations(5, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    found = m.prefix_trie(*m.with_shared_heads(m.numbered_turns(df)), block_rows=32).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.prefix_trie(*m.with_shared_heads(m.numbered_turns(empty))).collect() == []
    for rows in ([(1, 0, "user", "x y", "", "")], [(20, None, None, None, "", "")], [(c, 0, "user", "x", "", "") for c in (21, 22, 23)]):
        found = m.prefix_trie(*m.with_shared_heads(m.numbered_turns(spark.createDataFrame(rows, SCHEMA)))).collect()
        assert sorted(map(tuple, found), key=str) == brute(rows)


def test_nearest_smaller_and_range_minima():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 6, 200)
    before, after = m._both_sides(v)
    for k in range(200):
        assert before[k] == max((j for j in range(k) if v[j] < v[k]), default=-1)
        assert after[k] == min((j for j in range(k + 1, 200) if v[j] < v[k]), default=-1)
    low = m.RangeMin(v)
    lo = rng.integers(0, 199, 300)
    hi = lo + 1 + (rng.random(300) * (200 - lo - 1)).astype(int)
    assert low(lo, hi).tolist() == [v[a:b].min() for a, b in zip(lo, hi, strict=True)]
