"""Features that hold at any size: resampling, permutations, depth, long chains, splits, claims, digests, filters, model calls."""

import json
import math
import threading
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelab.functions.jsonx import flatten, schema_violations
from judgelab.functions.text import cosine, hash_embedding, hash_similarity
from judgelab.operators import calibration, datasets, judges, seams, stats, suite
from judgelab.sources import jsonl, model
from judgelab.sources.snapshots import SnapshotStore


def test_bootstrap_draws_near_equal_deltas_apart(spark):
    values = [0.1 + k * 1e-9 for k in range(2000)] + [0.5 + k * 1e-9 for k in range(2000)]
    r = stats.bootstrap_ci(spark.createDataFrame([(v,) for v in values], "d double"), "d").first()
    half = 1.96 * 0.2 / math.sqrt(4000)
    assert r["ci_low"] == pytest.approx(0.3 - half, abs=0.1 * half) and r["ci_high"] == pytest.approx(0.3 + half, abs=0.1 * half)


def test_bootstrap_equals_resampling_value_by_value(spark):
    """Draws of each value one by one, whatever the partitioning; counts with the exact law and beyond it."""
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.normal(size=40)] + [0.25] * 9 + [-1.5] * 50 + [0.0, -0.0]
    counts = {}
    for v in values:
        counts[v + 0.0] = counts.get(v + 0.0, 0) + 1
    import hashlib

    t, s = np.zeros(300), np.zeros(300)
    for v, c in counts.items():
        h = hashlib.md5(f"7|all|{np.float64(v).view(np.int64)}".encode()).hexdigest()
        times = stats.poisson_times((int(h[:8], 16), int(h[8:16], 16)), c, 300)
        t, s = t + times, s + times * v
    df = spark.createDataFrame([(v,) for v in values], "d double")
    for parts in (1, 7):
        r = stats.bootstrap_ci(df.repartition(parts), "d", n_resamples=300, seed=7).first()
        assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(s / t, [0.025, 0.975])))
    for c in (1, 9, 50):
        drawn = np.concatenate([stats.poisson_times((k, 3 * k + 1), c, 500) for k in range(40)])
        assert drawn.mean() == pytest.approx(c, rel=0.03) and drawn.var() == pytest.approx(c, rel=0.05)


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_permutations_are_pairings_of_two_orders(spark, block_rows):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=40), rng.normal(size=40)
    pts = spark.createDataFrame([(str(k), float(x[k]), float(y[k]), 1) for k in range(40)], "i string, x double, y double, one int").repartition(3)
    got = {(r["o"], r["lag"]): r["t"] for r in calibration.permuted_products(pts, 40, 23, 5, lags=6, block_rows=block_rows).collect()}
    assert set(got) == {(k // 6, k % 6) for k in range(23)}
    import hashlib

    for (o, lag), t in got.items():
        place = lambda side, o=o: sorted(range(40), key=lambda k: (int(hashlib.md5(f"5|{side}|{o}|{k}".encode()).hexdigest()[:8], 16), str(k)))
        xs, ys = place("x"), place("y")
        assert t == pytest.approx(sum(x[xs[k]] * y[ys[(k + lag) % 40]] for k in range(40)))


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_permutations_are_drawn_one_by_one(spark, bucket_rows):
    import hashlib

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=40), rng.normal(size=40)
    pts = spark.createDataFrame([(str(k), float(x[k]), float(y[k]), 1) for k in range(40)], "i string, x double, y double, one int").repartition(3)
    got = {r["p"]: r["t"] for r in calibration.shuffled_products(pts, 40, 23, 5, bucket_rows).collect()}
    ids = sorted(range(40), key=str)
    for p in range(1, 24):
        order = sorted(range(40), key=lambda k: (int(hashlib.md5(f"5|{p}|{k}".encode()).hexdigest()[:8], 16), str(k)))
        assert got.pop(p - 1) == pytest.approx(sum(x[ids[k]] * y[order[k]] for k in range(40)))
    assert not got


def test_permutation_p_value_agrees_with_shuffling(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    y = 0.2 * x + rng.normal(size=80)
    slope = lambda a, b: ((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum()
    seen = abs(slope(x, y))
    p = np.mean([abs(slope(x, rng.permutation(y))) >= seen for _ in range(4000)])
    df = spark.createDataFrame([(str(k), float(x[k]), float(y[k])) for k in range(80)], "i string, x double, y double")
    assert calibration.verbosity_permutation(df, "i", "y", "x").first()["p_value"] == pytest.approx(p, abs=0.04)


def test_flatten_a_deep_text_among_shallow_ones(spark):
    deep = 1
    for k in range(200):
        deep = {"d": deep} if k % 3 else [deep, k]
    df = spark.createDataFrame([(0, json.dumps(deep))] + [(k, json.dumps({"a": k, "l": [1, 2]})) for k in range(1, 30)], "id long, j string")
    flat = flatten(df, ["id"], "j")
    assert len(flat._jdf.queryExecution().optimizedPlan().toString()) < 3000
    got = {}
    for r in flat.collect():
        got.setdefault(r["id"], {})[r["path"]] = r["value"]
    assert all(got[k] == {"a": str(k), "l[0]": "1", "l[1]": "2", "l#len": "2"} for k in range(1, 30))

    def walk(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            if path:
                yield path + "#len", str(len(v))
            for k, x in enumerate(v[:3]):
                yield from walk(x, f"{path}[{k}]")
        else:
            yield path, json.dumps(v)

    assert got[0] == dict(walk(deep, ""))


def test_a_chain_of_many_ranges(spark):
    n = 240
    rows = [("long", i, f"s{i}", json.dumps({"a": i - (i % 5 == 0), "b": 1}), json.dumps({"a": i + 1, "b": 1})) for i in range(n)] + [("short", i, "s", "{}", "{}") for i in range(3)] + [("one", 0, "s", "{}", "{}")]
    steps = spark.createDataFrame(rows, "chain_id string, step_idx int, name string, input string, output string").repartition(5)
    ranged, whole = seams.handoffs(steps, limit=20), seams.handoffs(steps)
    assert sorted(ranged.collect()) == sorted(whole.collect()) and ranged.count() == n - 1 + 2
    assert {r["seam"] for r in ranged.filter("chain_id = 'long' AND fidelity < 1").collect()} == {i for i in range(1, n) if i % 5 == 0}
    ranks = {(r["chain_id"], r["seam"]): r["rank"] for r in seams.blame(ranged, limit=20).collect()}
    want = sorted((i for i in range(1, n)), key=lambda i: (-(0.5 if i % 5 == 0 else 0.0) * (n - i), i))
    assert [ranks["long", i] for i in want] == list(range(1, n))


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    lines = [f'{{"item_id": "{k}", "prompt": "{"x" * (k % 50)}"}}' if k % 7 else "" for k in range(1, 400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines[:90]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = jsonl.numbered_lines(spark, str(tmp_path))
        assert df.select(F.spark_partition_id()).distinct().count() > 3
        got = df.collect()
        plan = df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "wholetext" not in plan and len(got) == sum(map(bool, lines)) + sum(map(bool, lines[:90]))
    assert all(json.loads(r["line"])["item_id"] == str(r["line_no"]) for r in got)


def test_baselines_of_every_form(spark, tmp_path):
    forms = {"object": '{"a": "x", "b": {"k": 1}}', "wrapped": '{\n "outputs": {"a": "x", "b": {"k": 1}}}', "list": '[{"name": "a", "value": "x"}, {"name": "b", "output": {"k": 1}}]', "lines": '{"name": "a", "value": "old"}\n{"name": "b", "output": {"k": 1}}\n{"name": "a", "value": "x"}\n'}
    for k, v in forms.items():
        (tmp_path / k).write_text(v)
        assert {r["name"]: r["value"] for r in jsonl.load_baseline(spark, str(tmp_path / k)).collect()} == {"a": "x", "b": '{"k":1}'}, k
    (tmp_path / "none").write_text("\n")
    with pytest.raises(ValueError, match="no baseline"):
        jsonl.load_baseline(spark, str(tmp_path / "none"))


def test_queue_file_has_all_columns(spark, tmp_path):
    labels = spark.createDataFrame([("a", "p, q", 'say "x"', None, 4.0, 1.0), ("b", "p", "r", "s", 4.0, None)], "item_id string, prompt string, response_a string, response_b string, judge_score double, human_score double")
    jsonl.labelling_queue(calibration.next_round(labels, 5), str(tmp_path / "q"))
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "q")).collect()
    assert rows[0].asDict() == {"item_id": "b", "priority": "0.7", "judge_score": "4.0", "disagreement": "0.0", "has_human_label": "false", "human_score": None, "prompt": "p", "response_a": "r", "response_b": "s"}
    assert (rows[1]["response_a"], rows[1]["has_human_label"], rows[1]["human_score"], rows[1]["prompt"]) == ('say "x"', "true", "1.0", "p, q")


def test_appends_at_once_get_runs_of_their_own(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    row = lambda s, i="i": spark.createDataFrame([("v", i, "c", s)], "model_version string, item_id string, capability string, score double")
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda k: store.append(row(float(k))), range(4))) == [1, 2, 3, 4]
    assert store.load_all().select("run_seq").distinct().count() == 4 and store.latest("v").count() == 1 and store.problems().isEmpty()
    store.append(row(None).unionByName(row(1.0)).unionByName(row(2.0, None)))
    assert {(r["problem"], r["n"], r["run_seq"]) for r in store.problems().collect()} == {("no item_id", 1, 5), ("no score", 1, 5), ("repeated item_id", 1, 5)}


def test_digest_is_a_tree_of_bounded_nodes(spark, monkeypatch):
    rows = [(str(k), f"t{k % 700}") for k in range(900)] + [("same", "x")] * 300
    df = spark.createDataFrame(rows, "i string, t string")
    digests = set()
    for leaf in (64, 4):
        monkeypatch.setattr(datasets, "LEAF", leaf)
        a, b = (datasets.dataset_digest(d, "i", ["i", "t"]).first() for d in (df.repartition(1), df.repartition(9)))
        assert a == b and a["n_items"] == 1200
        digests.add(a["sha256"])
        assert datasets.dataset_digest(df.limit(1199), "i", ["i", "t"]).first()["sha256"] != a["sha256"]
    monkeypatch.undo()
    assert len(digests) == 2 and datasets.digest_digits(64) == 0 and datasets.digest_digits(65) == 1 and datasets.digest_digits(10**10) == 7
    assert datasets.dataset_digest(df.limit(0), "i", ["i", "t"]).first()["n_items"] == 0


def test_gram_filter_keeps_all_and_little_else(spark):
    grams = spark.range(5000).select(F.concat(F.lit("gram "), "id").alias("gram"))
    may_be = datasets.gram_filter(grams, 5000)
    assert grams.filter(~may_be(F.col("gram"))).isEmpty()
    others = spark.range(200000).select(F.concat(F.lit("other "), "id").alias("gram"))
    assert others.filter(may_be(F.col("gram"))).count() < 400


def test_similarity_in_a_row_equals_that_of_vectors(spark):
    rows = [("1", "the cat sat", "the cat ran off"), ("2", "", "x"), ("3", None, "x"), ("4", "same words", "same words"), ("5", "!!", "??")]
    df = spark.createDataFrame(rows, "i string, a string, b string")
    want = {r["i"]: r["similarity"] for r in cosine(hash_embedding(df, "i", "a"), hash_embedding(df, "i", "b"), "i").collect()}
    assert {r["i"]: r["s"] for r in df.select("i", hash_similarity("a", "b").alias("s")).collect()} == {i: pytest.approx(want.get(i, 0.0), abs=2e-6) for i, *_ in rows}


def test_checks_under_schemas_by_name(spark):
    number, text = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 3}}}, {"type": "string", "minLength": 4}
    out = spark.createDataFrame([("a", '{"n": 4}', 10.0), ("b", '{"n": 2}', 10.0), ("c", '"abcd"', None), ("d", "plain words", 99.0)], "name string, value string, latency_ms double")
    specs = spark.createDataFrame([("a", json.dumps(number), None, 20.0, None), ("b", json.dumps(number), None, 5.0, None), ("c", json.dumps(text), '"abce"', 5.0, 0.99)], "name string, schema string, reference string, budget_ms double, min_similarity double")
    failed = {}
    for r in suite.run_checks_by_name(out, specs).filter("NOT passed").collect():
        failed.setdefault(r["name"], set()).add(r["check"])
    assert failed == {"b": {"schema_conformity", "latency_budget"}, "c": {"similarity", "latency_budget"}}
    one = out.withColumn("reference", F.lit(None).cast("string"))
    same = spark.createDataFrame([(n, json.dumps(number), None, 20.0, None) for n in "abcd"], specs.schema)
    assert sorted(suite.run_checks_by_name(out, same).collect()) == sorted(suite.run_checks(one, number, 20.0).collect())
    assert schema_violations([{"a": 1}, 2], {"type": "array", "items": {"type": "object"}}) == ["$[]: expected type object"]


class Server(BaseHTTPRequestHandler):
    seen: dict = {}
    lock = threading.Lock()

    def do_POST(self):
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
        with self.lock:
            k = self.seen[prompt] = self.seen.get(prompt, 0) + 1
        status = 400 if prompt == "bad" else 503 if k <= 2 and prompt != "dead" else 500 if prompt == "dead" else 200
        body = json.dumps({"choices": [{"message": {"content": f"said {prompt}"}}]}).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_model_calls_are_retried_and_kept(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        chat = model.ChatServer(f"http://127.0.0.1:{server.server_port}", "m")
        items = spark.createDataFrame([(k, f"p{k % 20}") for k in range(40)] + [(90, "bad"), (91, "dead"), (92, None)], "id long, ask string")
        policy = model.Policy(retries=2, backoff=0.01)
        got = {r["id"]: r["payload"] for r in judges.model_judge(items, chat, "ask", store=str(tmp_path / "kept"), policy=policy).collect()}
        assert got == {k: f"said p{k % 20}" for k in range(40)} | {90: None, 91: None, 92: None}
        assert Server.seen == {f"p{k}": 3 for k in range(20)} | {"bad": 1, "dead": 3}
        more = items.unionByName(spark.createDataFrame([(100, "new")], items.schema))
        again = {r["id"]: r["payload"] for r in judges.model_judge(more, chat, "ask", store=str(tmp_path / "kept"), policy=policy).collect()}
        assert again[3] == "said p3" and again[100] == "said new" and all(Server.seen[f"p{k}"] == 3 for k in range(20))  # a second run asks only what is missing
    finally:
        server.shutdown()


def test_pauses_double():
    slept, calls = [], []

    def call(p):
        calls.append(p)
        raise model.ModelError("busy", True)

    assert model.patient(call, model.Policy(3, 0.5), slept.append)("p") == (None, "ModelError: busy")
    assert slept == [0.5, 1.0, 2.0] and len(calls) == 4


def test_scores_of_degraded_texts_from_one_pass(spark):
    from judgelab.functions.text import degrade_each, degraded_f1_each, f1_each

    texts = [None, "", " ", "  a  b ", "!!", "a", "\u0130stanbul \u03a3\u0391\u03a3 x\x01y \x01 z", "don't_stop 3\u00bd \u216b", "q\nw e\tr", " " * 50]
    texts += [" ".join(f"w{k}\u00e9,{k % 5}" for k in range(n)) for n in (1, 2, 3, 40, 900)]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for qualities in ([0.75, 0.7], [0.0, 1.0, 0.01, 0.5, 2.0, -1.0]):
        text = F.col("text")
        for r in df.select(degraded_f1_each(text, qualities).alias("a"), f1_each(degrade_each(text, qualities), text).alias("b")).collect():
            assert r["a"] == r["b"] and len(r["a"]) == len(qualities)


def test_verdicts_are_parsed_and_clauses_chosen_once(spark):
    """The plans hold each costly step once a row, and few topics still make as many tasks as there are cores."""
    from judgelab.operators import generator

    df = spark.createDataFrame([("a", '{"scores": [{"name": "relevance", "score": 9}, {"name": "clarity", "score": null}]}')], "id string, p string")
    out = judges.rubric_payload(df, "p")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("JsonToStructs") + plan.count("jsontostructs") == 1
    assert out.first()["error"] == "no score for completeness, clarity, format"
    topics = spark.createDataFrame([(i, f"t{i}", "c", ["k"], "b") for i in range(50)], "ordinal int, topic string, capability string, keywords array<string>, blurb string").coalesce(1)
    assert generator.generate(topics, ["x"]).rdd.getNumPartitions() >= 4
