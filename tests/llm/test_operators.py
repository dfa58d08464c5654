"""Operators against brute force on small tables, with nulls, blanks, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelab.llm import decontamination, lm, minhash, substring_dedup
from judgelab.llm import quality_classifier as quality
from judgelab.llm import toxicity as toxicity_module
from judgelab.llm.decontamination import decontaminate
from judgelab.llm.lm import language_model_scores
from judgelab.llm.minhash import near_duplicates
from judgelab.llm.mixing import mix
from judgelab.llm.quality_classifier import quality_scores, vectors
from judgelab.llm.quality_classifier import train as train_quality
from judgelab.llm.quality_rules import quality_rules
from judgelab.llm.sharding import shard
from judgelab.llm.substring_dedup import repeated_intervals, without_repeats
from judgelab.llm.toxicity import toxicity
from judgelab.llm.toxicity import train as train_toxicity
from judgelab.llm.url_filters import propagate, rounds_to, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(k, n, step=1):
    return [f"w{(k * 7919 + i * step * 104729) % 99991}" for i in range(n)]


def corpus():
    """Plain texts, copies, near copies, a repeated passage, very long and empty ones, repeated rows and a null id."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(5, 40)
    texts = [
        " ".join(base), " ".join(base), " ".join(near), " ".join(words(2, 90)), None, "", " \n\t ", "one two", "ONE Two",
        " ".join(words(3, 50) + passage + words(4, 20)), " ".join(words(6, 10) + passage + words(7, 60)), " ".join(words(8, 60) + words(8, 60)),
        " ".join(words(9, 4000)), "a b c d e", "the cat sat on the mat and the dog sat on the log by the door of the house",
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i != 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[0], (None, " ".join(words(10, 50)), None, "s0", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().split()


def lowered(t):
    return (t or "").encode().lower().split()


def test_near_duplicates_equal_brute_force(docs):
    rows = corpus()
    sets = []
    for _, t, *_ in rows:
        w = lowered(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    expected = Counter()
    for i, (d, *_rest) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        comp = min(ids) if ids and sets[i] else d
        expected[d, len(sets[i]), comp, d == comp] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == expected


def test_large_group_of_near_copies_is_one_component(spark):
    base = words(11, 100)
    rows = [(i, " ".join([*base[: i % 90], f"x{i}", *base[i % 90 + 1 :]])) for i in range(150)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_substring_dedup_equals_brute_force(docs):
    rows = corpus()
    count = Counter(tuple(w[i : i + 35]) for w in (split(t) for _, t, *_ in rows) for i in range(len(w) - 34))
    expected = Counter()
    for d, t, *_ in rows:
        w = split(t)
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in without_repeats(docs).collect()) == expected


def _windows_gone(rows):
    """Counter of (id, words, removed words, digest) by plain counts of windows."""
    count = Counter(tuple(w[i : i + 35]) for w in (split(t) for _, t in rows) for i in range(len(w) - 34))
    out = Counter()
    for d, t in rows:
        w = split(t)
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out[d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    return out


def test_substring_dedup_of_many_equal_rows_and_null_ids(spark):
    a, b = words(21, 80), words(22, 60)
    rows = [(1, " ".join(a)), (2, " ".join(b + a[:50])), *[(3, " ".join(a[10:70] + b))] * 300, *[(None, " ".join(b))] * 300]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in without_repeats(df).collect()) == _windows_gone(rows)
    assert max(len(r["gone"]) for r in repeated_intervals(df).collect()) <= 80


def test_substring_dedup_indexes_a_shared_passage_once(spark, monkeypatch):
    """A passage of more than a window amid unlike words: the largest shard doesn't grow with the documents that share it."""
    sizes = {}
    for n in (60, 240):
        rows = [(i, " ".join([*words(1000 + i, 20), *words(5, 60), *words(5000 + i, 20)])) for i in range(n)]
        largest = []
        real = substring_dedup.distinct_windows

        def spy(w, real=real, largest=largest):
            largest.append(real(w).groupBy("shard").count().agg({"count": "max"}).first()[0] or 0)
            return real(w)

        monkeypatch.setattr(substring_dedup, "distinct_windows", spy)
        assert Counter(tuple(r) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shard_words=1000).collect()) == _windows_gone(rows)
        monkeypatch.setattr(substring_dedup, "distinct_windows", real)
        sizes[n] = max(largest)
    assert 0 < sizes[240] <= 1.5 * sizes[60] + 40


def test_substring_dedup_splits_a_hot_anchor(spark):
    line = words(23, 20)
    rows = [(i, " ".join(words(100 + i, 40) + line + words(100 + i // 2, 40, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for shard_words in (200_000, 500):
        assert Counter(tuple(r) for r in without_repeats(df, shard_words=shard_words).collect()) == _windows_gone(rows)


def _verified(monkeypatch, df):
    """Rows of near_duplicates, and how many pairs were checked on full sets."""
    seen = []

    def record(x, name, write=minhash.materialise):
        out = write(x, name)
        if name == "likely":
            seen.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialise", record)
    return near_duplicates(df).collect(), sum(seen)


def test_near_duplicates_of_many_equal_rows_and_null_ids(spark, monkeypatch):
    base = words(31, 80)
    near = [*base[:40], "other", *base[41:]]
    rows = [*[(i, " ".join(base)) for i in range(500)], *[(1000 + i, " ".join(near)) for i in range(500)], *[(None, f"lone {i} " + " ".join(words(40 + i, 30))) for i in range(250)], *[(None, f"Lone {i} " + " ".join(words(40 + i, 30))) for i in range(250)]]
    out, pairs = _verified(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert pairs == 1
    assert Counter((r["component_id"], r["kept"]) for r in out) == {(0, True): 1, (0, False): 999, (None, True): 500}


def test_quality_rules_count_as_brute_force(docs):
    out = {(r["doc_id"], r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["word_chars"], r["base_failed"]) for r in quality_rules(docs).collect()}
    expected = set()
    for d, t, *_ in corpus():
        w = split(t)
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        expected.add((d, len(w), len(again), len(lines) - len(set(lines)), sum(len(x.decode()) for x in w), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    assert out == expected


def test_quality_rules_symbols_and_lines(spark):
    text = "a#b\nx | y\n\nx | y\n  \nz"
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_symbols"], r["n_dup_lines"], r["kept"]) == (3, 1, False)


def test_language_model_base_and_normalisation(docs):
    rows = corpus()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = Counter()
    for d, t, *_ in rows:
        if not held(d):
            count.update([*lowered(t), None])
    n, v = sum(count.values()), len(count)
    for r in language_model_scores(docs).collect():
        t = next(x[1] for x in rows if x[0] == r["doc_id"])
        w = [*lowered(t), None]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def test_language_model_learns_a_pattern(spark):
    rows = [(i, " ".join(f"a{(i + k) % 7} b{(i + k) % 7}" for k in range(60))) for i in range(80)]
    out = language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").groupBy().sum("base_score", "score").first()
    assert out[1] > out[0]


def test_language_model_gradients_take_every_position(spark, docs):
    train = docs.selectExpr("CAST(coalesce(text, '') AS BINARY) AS text")
    v, _, _ = lm.train(train)
    stats = lm.statistics(train, spark.sparkContext.broadcast(v))
    assert sum(sum(r["ns"]) for r in stats.collect()) == v.total == sum(len(lowered(t)) + 1 for _, t, *_ in corpus())
    fitted = lm.fit_classes(stats)
    gap, seen = lm._sum_gaps(stats, fitted)
    start, _ = lm._sum_gaps(stats, lm.fit_classes(stats, rounds=0))
    assert seen[: lm.ROWS1].sum() == v.total and np.abs(gap).sum() < np.abs(start).sum()


def _word_shares(rows, held):
    """Shares of (u, v, w) and their normaliser from plain counts, where no word is rare: two levels of discounted counts."""
    first, second = Counter(), Counter()
    kinds = ({}, {})
    for d, t in rows:
        if not held(d):
            w = ["<s>", "<s>", *t.split(), None]
            for u, v, x in zip(w, w[1:], w[2:]):
                first[v, x] += 1
                second[u, v, x] += 1
    for (v, x), n in first.items():
        kinds[0].setdefault(v, {})[x] = n
    for (u, v, x), n in second.items():
        kinds[1].setdefault((u, v), {})[x] = n
    return kinds


def test_language_model_scores_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{k}" for k in r.zipf(1.5, 40) % 30)) for i in range(60)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    v, weights, _ = lm.train(df.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 1").selectExpr("CAST(text AS BINARY) AS text"))
    hashes = lambda t: lm.tokens(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))
    by_word = {x: v.find(hashes(x)[0])[0] for _, t in rows for x in t.split()}
    by_word[None] = v.find(hashes("t1")[0])[1]
    known = {w: i for w, i in by_word.items() if i >= 0}
    kinds = _word_shares(rows, held)
    got = {x["doc_id"]: x["score"] for x in language_model_scores(df).collect()}
    compared = 0

    def level(counts, c, w, below):
        mine = {x: n for x, n in counts.items() if v.outcome[known[x]] == c}
        total = sum(mine.values())
        return below if not total else (max(mine.get(w, 0) - lm.DISCOUNT, 0) + lm.DISCOUNT * len(mine) * below) / total

    for d, t in rows:
        if all(x in known for x in t.split()):
            buf = np.frombuffer(t.encode(), dtype=np.uint8)
            p = lm.positions(*lm.tokens(buf, np.array([0, len(buf)])), v)
            score = 0.0
            for i, (one, two, c) in enumerate(zip(p.one, p.two, p.outcome)):
                x = weights.bias + sum(weights.classes[k] for k in lm.class_rows(np.array([one]), np.array([two]))[:, 0])
                score += (x[c] - np.log(np.exp(x).sum())) / np.log(10)
                u, prev, w = ["<s>", "<s>", *t.split(), None][i : i + 3]
                share = level(kinds[0].get(prev, {}), c, w, v.share[known[w]])
                score += math.log10(level(kinds[1].get((u, prev), {}), c, w, share))
            assert got[d] == pytest.approx(score, rel=1e-5)
            compared += 1
    assert compared > 40
    for c in set(v.outcome):
        members = [w for w, i in known.items() if v.outcome[i] == c]
        low = {w: level(kinds[0].get("t1", {}), c, w, v.share[known[w]]) for w in members}
        assert sum(level(kinds[1].get(("t2", "t1"), {}), c, w, low[w]) for w in members) == pytest.approx(1.0)


def test_language_model_scores_do_not_depend_on_partitions(spark):
    """With contexts split from few occurrences on, and rows dealt out in different ways and orders."""
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in r.zipf(1.6, 60) % 50)) for i in range(120)]
    a, b = ({x["doc_id"]: x["score"] for x in language_model_scores(spark.createDataFrame(d, "doc_id long, text string").repartition(n), split=40).collect()} for d, n in ((rows, 1), (rows[::-1], 6)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 * abs(a[k]) for k in a)


def test_language_model_scores_do_not_depend_on_the_split(spark, monkeypatch):
    """Contexts, their commonest pairs and those before rare words in parts, beside whole ones."""
    monkeypatch.setattr(lm, "HEAD_WORDS", 64)
    r = np.random.default_rng(7)
    rows = [(i, " ".join(["a", "b"] * (i % 3) + [f"w{k}" for k in r.zipf(1.6, 60) % 300])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, cut = ({x["doc_id"]: x["score"] for x in language_model_scores(df, split=n).collect()} for n in (1 << 30, 20))
    assert cut == pytest.approx(whole, rel=1e-5)
    v, _, _, hot = lm._train(df.selectExpr("CAST(text AS BINARY) AS text"), 20)
    assert len(hot.key) > 5 and len(hot.pair) > 5 and (hot.pair_parts > 1).all() and set(hot.pair_of) <= set(hot.key)
    skipped = lm._context_key(v.hash[:, None], np.array(False), np.arange(lm.OUTCOMES))
    assert np.isin(skipped, hot.key).any()


def test_language_model_splits_hot_contexts_and_tells_copies_apart(spark):
    r = np.random.default_rng(6)
    texts = [" ".join(f"q{k}" for k in r.integers(0, 400, 60)) for _ in range(300)]
    rows = [(i, texts[i % 250]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    twice = lambda i: sum(zlib.crc32(str(j).encode()) % 5 != 1 for j, t in rows if t == rows[i][1]) == 2
    out = {x["doc_id"]: x["score"] for x in language_model_scores(df).collect()}
    high = sorted(out, key=out.get)[-sum(map(twice, out)) :]
    assert sum(map(twice, high)) >= 0.9 * len(high)
    v, _, _ = lm.train(df.selectExpr("CAST(text AS BINARY) AS text"))
    h, rare, first = lm.tokens(np.tile(np.frombuffer(b"q1 q2 ", dtype=np.uint8), 50), np.arange(0, 306, 6))
    p = lm.positions(h, rare, first, v)
    whole, cut = (lm.grams(h, first, p, np.zeros(50, dtype=bool), v, lm.document_keys(h, first, list(range(50))), split) for split in (1 << 30, 5))
    assert len(set(whole.key)) < len(set(cut.key))


def test_mixing_keeps_every_document_and_meets_the_limits(docs):
    out = mix(docs, target_entropy=1.0, max_repetition=3.0).collect()
    tokens = {}
    for d, t, _, s, _ in corpus():
        tokens.setdefault(s, []).append(len(split(t)) + 1)
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["__tokens"]
    assert {r["doc_id"] for r in out} == {d for d, *_ in corpus()}
    for s, t in tokens.items():
        assert taken[s] <= 3.0 * sum(t) + max(t) and taken[s] >= sum(t)
    weights = {r["source"]: r["__weight"] for r in out}
    assert sum(weights.values()) == pytest.approx(1.0)


def test_mixing_takes_passes_as_planned_by_brute_force(spark):
    """Weights by a plain search for the exponent; every whole pass has every row once, the partial one stays within a row of its budget."""
    rows = [(i // 2, f"{'x ' * (i % 7)}{i % 3}", "abc"[min(2, i % 9)]) for i in range(900)] + [(7, "twice", "b")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__b", F.lit("clash"))
    out = mix(df, target_entropy=0.98, max_repetition=5.0, block_rows=8).collect()
    total = Counter()
    for _, t, s in rows:
        total[s] += len(split(t)) + 1
    share = {s: n / sum(total.values()) for s, n in total.items()}
    at = lambda a: {s: x**a / sum(y**a for y in share.values()) for s, x in share.items()}
    h = lambda w: -sum(x * math.log(x) for x in w.values()) / math.log(3)
    w = at(max(k / 4096 for k in range(4097) if h(at(k / 4096)) >= 0.98))
    budget = sum(total.values()) / min(w[s] / share[s] for s in w)
    by_pass = {}
    for r in out:
        assert r["__weight"] == pytest.approx(w[r["source"]], abs=1e-3)
        by_pass.setdefault((r["source"], r["__epoch"]), Counter())[r["doc_id"], r["text"]] += 1
    for s in total:
        whole = Counter((d, t) for d, t, x in rows if x == s)
        passes = [by_pass[k] for k in sorted(by_pass) if k[0] == s]
        assert all(p == whole for p in passes[:-1]) and all(n <= whole[k] for k, n in passes[-1].items())
        taken = sum(n * (len(split(k[1])) + 1) for p in passes for k, n in p.items())
        assert abs(taken - w[s] * budget) <= 8 + 0.002 * budget


def test_mixing_meets_a_target_entropy_and_budget(spark):
    rows = [(i, "x " * 10, "big" if i % 10 else "small") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df, target_entropy=0.9, max_repetition=10.0, budget_tokens=11_000)
    w = [r["w"] for r in out.groupBy("source").agg({"__weight": "max"}).toDF("source", "w").collect()]
    assert -sum(x * math.log(x) for x in w) / math.log(2) == pytest.approx(0.9, abs=1e-4)
    assert out.agg({"__tokens": "sum"}).first()[0] == pytest.approx(11_000, abs=44)
    assert out.groupBy("doc_id", "__epoch").count().filter("count > 1").isEmpty()


def test_shards_are_near_equal_with_gapless_slots(spark, docs):
    rows = [(i, "same text" if i % 3 == 0 else "t" * (i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shard(df).collect()
    size = Counter()
    slots = {}
    for r in out:
        assert r["size"] == len(r["text"]) + 8 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(size.values()) / 24
    assert set(size) == set(range(24)) and all(abs(x - mean) <= 58 for x in size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    small = shard(docs).collect()
    assert len(small) == len(corpus()) and {r["shard"] for r in small} <= set(range(24))


@pytest.mark.parametrize("same_id", [True, False])
def test_sharding_splits_a_key_with_half_of_all_rows(spark, same_id):
    alike = spark.range(4000).selectExpr("5L AS doc_id" if same_id else "id AS doc_id", "'' AS text")
    df = alike.unionByName(spark.range(4000).selectExpr("id + 10000 AS doc_id", "concat('t', id) AS text")).repartition(4)
    out = shard(df, ranges_per_shard=4).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 24
    assert len(out) == 8000 and all(abs(x - mean) <= 13 for x in size.values())


def test_sharding_subdivides_identical_rows(spark):
    df = spark.range(2000).selectExpr("5L AS doc_id", "'same' AS text")
    out = shard(df, ranges_per_shard=4).groupBy("shard").count().collect()
    assert {r["count"] for r in out} <= {83, 84} and len(out) == 24


ITEM = "A train leaves the station at 10 km with Anna aboard and needs 25 minutes to reach the old harbour near Berlin before 9 tonight."


def leaking_items(rows, classes):
    """doc_id -> ids of all items that leak into it, members of each class included."""
    members = {}
    for r in classes.collect():
        members.setdefault(r["class_id"], []).append(r["item_id"])
    assert all(len(members[x["item_id"]]) == x["n_items"] for r in rows for x in r["leaks"])
    return {r["doc_id"]: sorted(i for x in r["leaks"] for i in members[x["item_id"]]) for r in rows}


def test_decontamination_pairs_documents_with_classes(spark):
    """Items and documents of one template: as many leaks as documents, and every item is among the members."""
    fill = lambda k: ITEM.replace("10", str(100 + k)).replace("25", str(3000 + 7 * k))
    items = spark.createDataFrame([(k, fill(k)) for k in range(500)] + [(900, ITEM.replace("25", "10"))], "item_id long, text string")
    docs = spark.createDataFrame([(k, fill(5000 + k)) for k in range(500)] + [(k, fill(1)) for k in range(500, 520)], "doc_id long, text string")
    out = decontaminate(docs, items).collect()
    assert sum(len(r["leaks"]) for r in out) <= 2 * len(out) and all(r["contaminated"] for r in out)
    got = leaking_items(out, decontamination.item_classes(items))
    assert all(set(range(500)) <= set(v) for v in got.values())


def test_decontamination_judges_repeated_rows_and_null_ids_one_by_one(spark):
    rows = [(1, ITEM), (1, ITEM), (None, ITEM), (None, "clean words of no item at all"), (None, None)]
    items = spark.createDataFrame([(7, ITEM), (None, "clean words of no item at all")], "item_id long, text string")
    out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in out) == [("1", True), ("1", True), ("None", False), ("None", False), ("None", True)]


def test_decontamination_catches_copies_and_changed_slots_only(spark):
    changed = ITEM.replace("10", "77").replace("Anna", "Peter").replace("25", "30").replace("Berlin", "Hamburg")
    mixed = "A train leaves the station quickly. " + " ".join(words(3, 60))
    rows = [(1, "Intro words first. " + ITEM + " And more."), (2, changed), (3, mixed), (4, None), (5, ""), (6, ITEM)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ITEM), (10, "tiny item")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(df, bench).collect()}
    assert [d for d in sorted(got) if got[d]["contaminated"]] == [1, 2, 6]
    assert leaking_items(got.values(), decontamination.item_classes(bench))[1] == [7, 9]
    none = decontaminate(df, bench.limit(0)).collect()
    assert not any(r["contaminated"] for r in none)


def test_decontamination_asks_for_consistent_slots(spark):
    item = "take 4 apples then give 4 pears then buy 4 plums then sell 4 figs then eat 4 nuts"
    other = "take 1 apples then give 2 pears then buy 3 plums then sell 5 figs then eat 6 nuts"
    df = spark.createDataFrame([(1, other), (2, item.replace("4", "9"))], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True}


def test_toxicity_learns_from_labels(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = words(i % 50, 30)
        rows.append((i, " ".join([*w[:10], "you", "vile", "slug" if i % 12 else "sl4g", *w[10:]]) if bad else " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity(docs, train_toxicity(docs, labels)).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert sum(out[i]["predicted"] == int(i % 6 == 0) for i in range(600)) >= 590
    assert out[1000]["score"] == out[1001]["score"]
    nothing = toxicity(docs, train_toxicity(docs, labels.limit(0))).collect()
    assert {r["score"] for r in nothing} == {0.0}


def test_toxicity_sample_is_bounded_when_an_id_repeats(spark, monkeypatch):
    rows = [(i % 20, f"text {i} " + " ".join(words(i, 10))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(toxicity_module, "materialise", lambda x, name, write=toxicity_module.materialise: seen.append(write(x, name)) or seen[-1])
    train_toxicity(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))
    assert seen[0].count() == seen[0].select("id").distinct().count() <= 20


def test_quality_classifier_separates_junk(spark):
    good = [(i, " ".join(w + " the of" if k % 4 == 0 else w for k, w in enumerate(words(i, 80))).replace("w", "wa").replace("1", "n").replace("2", "m").replace("3", "o")) for i in range(200)]
    junk = [(1000 + i, "&&& ### $$$ " * 30) for i in range(20)] + [(2000 + i, "spam " * 80) for i in range(20)]
    df = spark.createDataFrame([*good, *junk, (3000, None)], "doc_id long, text string")
    found = vectors(df)
    out = {r["doc_id"]: r["kept"] for r in quality_scores(found, train_quality(found)).collect()}
    again = vectors(df.repartition(7, "text"))
    model, other = train_quality(found), train_quality(again)
    assert np.allclose(model.weights, other.weights, atol=1e-3) and np.allclose(model.posterior, other.posterior)
    assert sum(out[i] for i, _ in good) >= 195 and sum(out[i] for i, _ in junk) <= 2 and len(out) == 241


def test_expectation_maximisation_equals_brute_force():
    """The same estimates document by document, with plain loops over votes."""
    r = np.random.default_rng(8)
    labellers = len(quality.LABELLERS)
    good = r.random(3000) < 0.7
    v = np.where(r.random((3000, labellers)) < 0.3, 0, np.where(r.random((3000, labellers)) < 0.85, np.where(good, 2, 1)[:, None], np.where(good, 1, 2)[:, None]))
    kinds, counts = np.unique(quality.pattern(v), return_counts=True)
    posterior, chance = quality.expectation_maximisation(kinds, counts, rounds=12)
    p = [(sum(x == 2) + 1) / (sum(x == 2) + 3 * sum(x == 1) + 2) for x in v]
    for _ in range(12):
        prior = {0: (sum(1 - q for q in p) + 1) / 3002, 1: (sum(p) + 1) / 3002}
        table = {}
        for k in range(labellers):
            for c in (0, 1):
                n = {x: 0.5 + quality.PRIOR * ((0.5, 0.5), (0.005, 0.995))[c][x - 1] for x in (1, 2)}
                for q, row in zip(p, v):
                    if row[k]:
                        n[row[k]] += q if c else 1 - q
                table[k, c] = {x: n[x] / (n[1] + n[2]) for x in n}
        like = [[prior[c] * math.prod(table[k, c][row[k]] for k in range(labellers) if row[k]) for c in (0, 1)] for row in v]
        p = [b / (a + b) for a, b in like]
    assert np.allclose(posterior[np.searchsorted(kinds, quality.pattern(v))], p, atol=1e-9)
    assert ((np.array(p) > 0.5) == good).mean() > 0.97 and all(chance[k, 1, 2] > chance[k, 0, 2] for k in range(labellers))


def test_decontamination_finds_what_all_pairs_find(spark):
    """Every document against every item, without seeds, filter or join."""
    r = np.random.default_rng(9)
    vocabulary = [*(f"word{k}" for k in range(40)), "Anna", "Berlin", "12", "7", "km", "minutes"]
    line = lambda n: " ".join(vocabulary[k] for k in r.integers(0, len(vocabulary), n))
    items = [(i, line(int(n))) for i, n in enumerate(r.integers(1, 25, 60))]
    rows = []
    for i in range(150):
        k = items[int(r.integers(0, 60))][1].split()
        for _ in range(int(r.integers(0, 3))):
            k[int(r.integers(0, len(k)))] = vocabulary[int(r.integers(0, len(vocabulary)))]
        rows.append((i, f"{line(20)} {' '.join(k)} {line(10)}"))
    rows += [(500, None), (501, rows[3][1])]
    part = (75, 100)
    expected = set()
    for d, t in rows:
        if t:
            buf = np.frombuffer(t.encode(), dtype=np.uint8)
            seen = decontamination.templates(buf, np.array([0, len(buf)]))
            expected |= {(d, i) for i, x in items if decontamination.share_of(decontamination.item_of(x.encode()), seen, part)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()
    assert {(d, i) for d, v in leaking_items(out, decontamination.item_classes(bench)).items() for i in v} == expected and len(out) == len(rows) and len(expected) > 20


def test_spread_goes_on_to_the_tolerance(spark):
    """Two hosts in a ring and a third beside them, one seed: as far from the limit as the tolerance says, with the shipped number of rounds."""
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 3)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in propagate(edges, seeds, tolerance=1e-3).collect()}
    index, down = ["a", "b", "c"], np.array([[0, 1, 0], [0.25, 0, 0.75], [1, 0, 0]])  # c has no links: back to the seed
    up = np.array([[0, 1, 0], [1, 0, 0], [0, 1, 0]])  # against the links, by each host's incoming weight
    want = []
    for m, s in ((down, [1, 0, 0]), (up, [0, 0, 1])):
        want.append(np.linalg.solve(np.eye(3) - 0.85 * m.T, 0.15 * np.array(s)))
    for k, h in enumerate(index):
        assert abs(got[h][0] - want[0][k]) < 1e-3 / 0.15 and abs(got[h][1] - want[1][k]) < 1e-3 / 0.15
    assert 4 * 0.85 ** (rounds_to(1e-6, 0.85) - 1) <= 1e-6 < 4 * 0.85 ** (rounds_to(1e-6, 0.85) - 3)


def test_url_rules_and_spread(spark):
    page = lambda i, u, h="": (i, u, h)
    rows = [
        page(1, "http://A.Example.NET/en/x?q"), page(2, "http://b.net/"), page(3, "https://x.org/fr/1"), page(4, None), page(5, "no scheme"), page(6, "http://example.com/de/1"), page(7, "http://b.net"),
        page(8, "http://bad.com/1", "<a href='http://b.net/'><a href=\"//c.net/z\">"), page(9, "http://fine.com/1", "<a href='http://x.org/fr/1'>"), page(10, "http://notnet/"), page(11, "http://c.net/q"), page(1, "http://A.Example.NET/en/x?q"),
    ]
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/", "block") and got[3]["verdict"] == "allow"
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("", "", None, "allow")
    assert got[6]["rule"] == "example.com/de/" and got[7]["rule"] is None and got[7]["path"] == ""
    assert got[8]["verdict"] == "block" and got[9]["verdict"] == "allow" and got[10]["rule"] is None


def test_page_rank_equals_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3)]
    seeds = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 1.0), "d": (0.0, 0.0)}
    got = {r["host"]: r for r in propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, trust double, distrust double"), rounds=30).collect()}
    for col, flip in (("trust", False), ("distrust", True)):
        es = [(v, u, n) if flip else (u, v, n) for u, v, n in edges]
        s = {k: v[1 if flip else 0] for k, v in seeds.items()}
        out = Counter()
        for u, _, n in es:
            out[u] += n
        r = dict(s)
        for _ in range(30):
            t = Counter()
            for u, v, n in es:
                t[v] += r[u] * n / out[u]
            held = sum(t.values())
            r = {k: (1 - 0.85 * held) * s[k] + 0.85 * t[k] for k in s}
        for k in s:
            assert got[k][col] == pytest.approx(r[k], abs=1e-5)


def test_empty_tables(spark, empty):
    assert near_duplicates(empty).isEmpty() and without_repeats(empty).isEmpty() and quality_rules(empty).isEmpty() and language_model_scores(empty).isEmpty()
    assert mix(empty).isEmpty() and shard(empty).isEmpty() and quality_scores(vectors(empty), train_quality(vectors(empty))).isEmpty()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(empty, train_toxicity(empty, labels)).isEmpty()
    assert decontaminate(empty, spark.createDataFrame([], "item_id long, text string")).isEmpty()
    assert url_filter(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
