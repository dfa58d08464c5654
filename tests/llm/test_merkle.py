"""The Merkle manifest against a recursion over lists."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from judgelab.llm import merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def digest(s):
    return sha256(s.encode()).hexdigest()


def tree(nodes):
    """The root, and for each node the siblings of its path, level by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for k, a in enumerate(at):
            run = now[a // 8 * 8 : a // 8 * 8 + 8]
            paths[k].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
            at[k] = a // 8
        now = [digest("".join(now[j : j + 8])) for j in range(0, len(now), 8)]
    return now[0], paths


def leaf(r, text):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        t = r[1]
        if r[0] is not None and t is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, t), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = tree([subs[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        for x, path in zip(sorted(groups[g]), subs[g][1], strict=True):
            fold = x[3]
            for before, after in path + up:
                fold = digest(before + fold + after)
            out.append((x[4], x[2], subs[g][0], root, digest("".join(b + a for b, a in path + up)), fold, fold == root))
    return sorted(out, key=str)


def run(spark, tmp, rows, **k):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    text = F.when(F.col("doc_id").isNotNull() & (m.crc_mod("doc_id", 3) == 0), F.translate("text", m._UPPER, m._LOWER)).otherwise(F.col("text"))
    fields = [F.col(c) for c in m.FIELDS]
    leaves = df.select("doc_id", "lang", "root", m.leaf_digest(fields).alias("leaf"), m.leaf_digest([*fields[:-1], text]).alias("tampered"))
    out = m.manifest(leaves, "lang", "doc_id", **k).withColumn("folded_root", m.folded("tampered"))
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", m.proof_digest(), "folded_root", F.col("folded_root") == F.col("root")).collect()), key=str)


def corpus():
    rows = [(k, f"Text {k} É", "en", "s", k, "clash") for k in range(700)]
    rows += [(k, None if k % 5 == 0 else "plain", f"l{k % 11}", None, None, None) for k in range(700, 790)]
    rows += [(k, "ABC", None, "s", 3, "x") for k in range(800, 809)] + [(900, "long " * 50000, "zz", "s", 1, "x")]
    return rows + [(None, "no id", "en", None, None, None)] * 2 + [rows[3]] * 30


@pytest.mark.parametrize("limit", [16, 100000])
def test_manifest_equals_brute_force(spark, tmp_path, limit):
    rows = corpus()
    assert run(spark, tmp_path, rows, range_leaves=limit) == brute(rows)


def test_one_leaf_one_group_and_none(spark, tmp_path):
    for rows in ([(1, "A", "en", None, None, None)], [(k, "x", "en", None, k, None) for k in range(9)], []):
        assert run(spark, tmp_path, rows) == (brute(rows) if rows else [])


def test_every_row_its_own_group(spark, tmp_path):
    rows = [(k, "T", f"g{k:03}", None, k, None) for k in range(200)]
    assert run(spark, tmp_path, rows, range_leaves=16) == brute(rows)
