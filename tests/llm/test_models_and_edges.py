"""Trained models and the pipeline against plain versions; columns that clash, null ids and repeated rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from judgelab.llm import decontamination, minhash, toxicity
from judgelab.llm import quality_classifier as quality
from judgelab.llm.common import words_of
from judgelab.llm.license_scan import license_scan
from judgelab.llm.minhash import near_duplicates
from judgelab.llm.mixing import mix
from judgelab.llm.quality_rules import quality_rules
from judgelab.llm.sharding import shard
from judgelab.llm.substring_dedup import without_repeats
from judgelab.llm.url_filters import url_filter

SF = "/root/testdata/sf0.001"


def test_boosting_equals_a_plain_version():
    """Splits tried one by one, sums in loops, trees walked row by row."""
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(150, 4)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * r.normal(size=150) > 0.4).astype(float)
    model = toxicity.boost(x, y, trees=3, depth=2, n_bins=8)
    share = (y.sum() + 0.5) / (len(y) + 1)
    margin = [math.log(share / (1 - share))] * len(y)
    bins = [[sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)] for row in x.tolist()]

    def best(rows, g, h):
        top = (1e-6, None)
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for f in range(4):
            for c in range(8):
                left = [i for i in rows if bins[i][f] <= c]
                a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                if b >= 0.5 and H - b >= 0.5:
                    gain = a * a / (b + 2) + (G - a) ** 2 / (H - b + 2) - G * G / (H + 2)
                    if gain > top[0] + 1e-9:
                        top = (gain, (f, c))
        return top[1]

    for _ in range(3):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [max(a * (1 - a), 1e-9) for a in p]
        groups = [list(range(len(y)))]
        for _ in range(2):
            nxt = []
            for rows in groups:
                s = best(rows, g, h)
                nxt += [[i for i in rows if s is None or bins[i][s[0]] <= s[1]], [i for i in rows if s is not None and bins[i][s[0]] > s[1]]]
            groups = nxt
        for rows in groups:
            step = 0.2 * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 2)
            for i in rows:
                margin[i] += step
    assert np.allclose(model.margin(x), margin)


def test_calibration_equals_the_minimax_formula():
    r = np.random.default_rng(1)
    m, y = np.sort(r.normal(size=60)), r.integers(0, 2, 60).astype(float)
    xs, share = toxicity.isotonic(m, y)
    mean = lambda a, b: y[a : b + 1].mean()
    want = [max(min(mean(a, b) for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]
    assert (np.diff(xs) > 0).all() and np.allclose(sorted(set(np.round(want, 9))), np.round(share, 9))


def test_quality_scorer_equals_a_plain_version(spark):
    """Gradients summed row by row over dictionaries; repeated rows count each time."""
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 60, int(r.integers(3, 80)))) for _ in range(60)]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(0, texts[0], "", "")] * 5 + [(None, texts[1], "", ""), (99, None, "", "")]
    found = quality.vectors(spark.createDataFrame(rows, "doc_id long, text string, score string, kept string").repartition(4))
    model = quality.train(found, rounds=4)
    data = found.collect()
    at = {int(k): float(p) for k, p in zip(model.known, model.posterior, strict=True)}
    w, first, second = {}, {}, {}
    for t in range(1, 5):
        g = {}
        for d in data:
            m = w.get(-1, 0.0) + sum(v * w.get(i, 0.0) for i, v in zip(d["i"], d["v"], strict=True))
            e = at[d["pattern"]] - 1 / (1 + math.exp(-m))
            for i, v in [*zip(d["i"], d["v"], strict=True), (-1, 1.0)]:
                g[i] = g.get(i, 0.0) + e * v / len(data)
        for i in set(g) | set(first):
            first[i], second[i] = 0.9 * first.get(i, 0.0) + 0.1 * g.get(i, 0.0), 0.99 * second.get(i, 0.0) + 0.01 * g.get(i, 0.0) ** 2
            w[i] = w.get(i, 0.0) + quality.RATE * (first[i] / (1 - 0.9**t)) / (math.sqrt(second[i] / (1 - 0.99**t)) + 1e-6)
    assert len(data) == len(rows)
    got = quality.quality_scores(found, model).collect()
    want = sorted(1 / (1 + math.exp(-w[-1] - sum(v * w[i] for i, v in zip(d["i"], d["v"], strict=True)))) for d in data)
    assert sorted(x["score"] for x in got) == pytest.approx(want, abs=2e-3) and sum(x["doc_id"] == 0 for x in got) == 6


def test_pipeline_equals_brute_force(spark):
    """Every stage's decisions, each made over all pairs or document by document, on all documents of the smallest scale."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = toxicity.train(docs, labels)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]

    def encoded(t):
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        return raw, np.array([0, len(raw)])

    clean = [(d, t) for d, t in rows if model.score(toxicity.features(*encoded(t), model.lexicon))[0] < 0.5]
    sets = [{x.tobytes() for x in minhash.shingles(words_of(*encoded(t), lower=True).hash)} for _, t in clean]
    root = list(range(len(clean)))
    for i in range(len(clean)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    least = {}
    for k, (d, _) in enumerate(clean):
        least[root[k]] = min(least.get(root[k], d), d)
    single = [(d, t) for k, (d, t) in enumerate(clean) if d == least[root[k]]]
    items = [decontamination.item_of(r["text"].encode()) for r in bench.collect() if r["text"]]
    kept = set()
    for d, t in single:
        seen = decontamination.templates(*encoded(t))
        if not any(decontamination.share_of(i, seen, (75, 100)) for i in items):
            kept.add(d)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == kept and len(rows) > len(clean) > len(single) > len(kept)
    size, count = {}, {}
    for r in out:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        count[r["shard"]] = count.get(r["shard"], 0) + 1
    mean, largest = sum(size.values()) / 24, max(r["size"] for r in out)
    assert all(abs(s - mean) <= largest for s in size.values())
    assert all(sorted(r["slot"] for r in out if r["shard"] == k) == list(range(n)) for k, n in count.items())


def test_columns_that_clash_are_replaced_or_not_read(spark):
    """Each operator with columns named like its results, all of another type, beside the same rows without them."""
    texts = [" ".join(f"w{(k * 7 + i) % 90}" for i in range(60)) for k in range(12)] + [None, "", "all rights reserved"]
    made = ("n_words", "n_removed", "kept_sha256", "n_shingles", "component_id", "kept", "score", "predicted", "shard", "slot", "size", "law", "text_crc32", "grown_shard", "labels", "base", "found", "leaks", "contaminated", "gone", "key", "id", "__src")
    plain = spark.createDataFrame([(k if k else None, t, "en", f"s{k % 2}", 1) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    clash = plain.select("*", *[F.lit("clash").alias(c) for c in made])
    model = toxicity.Model(toxicity.Lexicon(np.empty(0, dtype=np.uint64), np.empty(0)), None, (np.empty(0), np.empty(0)), 0.25)
    runs = {
        "op3": lambda d: without_repeats(d), "op4": lambda d: near_duplicates(d), "op7": lambda d: quality_rules(d).select("doc_id", "n_words", "kept"), "op8": lambda d: toxicity.toxicity(d, model).select("doc_id", "score", "predicted"),
        "op9": lambda d: shard(d).select("doc_id", "size", "shard", "slot"), "op13": lambda d: license_scan(d).select("doc_id", "n_words", F.col("found.label").alias("l")), "op1": lambda d: mix(d).select("doc_id", "text"),
    }
    for name, run in runs.items():
        assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(clash).collect())), name
    pages = spark.createDataFrame([(None, "http://a.net/x", '<a href="http://b.org/fr/">'), (2, "http://b.org/fr/1", None), (None, None, ""), (2, "http://b.org/fr/1", None)], "page_id long, url string, html string")
    more = pages.select("*", *[F.lit("clash").alias(c) for c in ("host", "path", "rule", "verdict", "trust", "rule_allows")])
    got = sorted(map(str, url_filter(pages).collect()))
    assert got == sorted(map(str, url_filter(more).collect())) and len(got) == 4
