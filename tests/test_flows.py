import json
import os

import pytest
from pyspark.sql import functions as F

from judgelab.functions.jsonx import flatten
from judgelab.operators import datasets, regression, seams, stats, suite
from judgelab.sources import datasets as store
from judgelab.sources import jsonl
from judgelab.sources.snapshots import SnapshotStore


def snap(spark, scores, version="v", caps=None):
    rows = [(version, f"item-{i:03d}", caps(i) if caps else "general", float(s)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "model_version string, item_id string, capability string, score double")


def test_planted_regression_fails_the_gate(spark):
    caps = lambda i: "reasoning" if i < 10 else "safety"
    base, cand = snap(spark, [4.0] * 10 + [3.0] * 10, caps=caps), snap(spark, [3.7] * 10 + [2.7] * 10, caps=caps)
    g = regression.run_gate(base, cand)
    assert (g.passed, g.exit_code, g.verdict) == (False, 1, "regressed")
    assert json.loads(g.alert)["failing"] == ["reasoning", "safety"] and json.loads(g.alert)["wilcoxon_p"] < 0.05


def test_improvement_noise_and_disjoint(spark):
    assert regression.run_gate(snap(spark, [3.0] * 20), snap(spark, [3.4] * 20)).verdict == "improved"
    noisy = [3 + ((i * 7) % 11) / 10 for i in range(40)]
    assert regression.run_gate(snap(spark, noisy), snap(spark, noisy[::-1])).verdict == "no_change"
    with pytest.raises(ValueError):
        regression.run_gate(snap(spark, [1.0]), snap(spark, [1.0]).limit(0))


def test_missing_items_and_single_slice(spark):
    base, cand = snap(spark, [1.0, 2, 3]), snap(spark, [1.0, 2])
    assert [tuple(r) for r in regression.missing_items(base, cand).collect()] == [("item-002", "candidate")]
    one = regression.drift_slices(regression.paired_deltas(snap(spark, [5.0]), snap(spark, [1.0]))).first()
    assert one["ci_low"] is None and one["verdict"] == "no_change"


def test_mock_adapter_falls_through_empty_answers(spark):
    items = spark.createDataFrame([("1", "p1"), ("2", "p2"), ("3", "p3")], "item_id string, prompt string")
    answers = spark.createDataFrame([("1", "by id"), ("p2", "by prompt"), ("3", "")], "k string, a string")
    got = {r["item_id"]: r["response"] for r in regression.mock_adapter(answers, "default")(items).collect()}
    assert got == {"1": "by id", "2": "by prompt", "3": "default"}


def test_snapshot_store(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "runs"))
    assert s.load_all() is None
    s.append(snap(spark, [1.0, 2.0], "v1"))
    s.append(snap(spark, [3.0], "v1"))
    s.append(snap(spark, [9.0], "v2"))
    assert [r["score"] for r in s.latest("v1").collect()] == [3.0] and s.load_all().count() == 4


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": null}, "l": [1, "x", true, 4], "e": [], "o": {}}')], "id long, j string")
    got = {r["path"]: (r["type"], r["value"]) for r in flatten(df, ["id"], "j").collect()}
    assert got == {"a.b": ("number", "1"), "a.c": ("null", "null"), "l[0]": ("number", "1"), "l[1]": ("str", '"x"'), "l[2]": ("bool", "true"), "l#len": ("number", "4"), "e#len": ("number", "0")}


def test_flatten_any_depth(spark):
    j = json.dumps({"a": {"b": [{"c": {"d": {"e": {"f": [[1, "} ]"]]}}}}]}})
    got = {r["path"]: r["value"] for r in flatten(spark.createDataFrame([(1, j), (2, "no json {{{"), (3, None)], "id long, j string"), ["id"], "j").collect()}
    assert got == {"a.b#len": "1", "a.b[0].c.d.e.f#len": "1", "a.b[0].c.d.e.f[0]#len": "2", "a.b[0].c.d.e.f[0][0]": "1", "a.b[0].c.d.e.f[0][1]": '"} ]"'}


def test_summaries(spark):
    base, cand = snap(spark, [4.0, 3.0, 5.0]), snap(spark, [3.0, 2.0, 4.0])
    m = regression.metrics_summary(base).first()
    assert (m["n_items"], m["mean_score"], m["capability_means"], len(m["snapshot_sha256"])) == (3, 4.0, {"general": 4.0}, 64)
    d = regression.paired_deltas(base, cand)
    text = regression.drift_summary(regression.drift_total(d), stats.wilcoxon(d, "delta"), regression.drift_slices(d), regression.missing_items(base, cand)).first()[0]
    assert text.split("\n") == ["regressed over 3 shared items (0 on one side only)", "loss: mean 1.0000, 95% between 1.0000 and 1.0000, tolerated 0.05", "sign balance: 1.000, asked for 0.1", "signed ranks: 6.0 (p 0.2500)", "worse in: general"]


def chain(spark, *pairs):
    """Steps from (input, output) pairs."""
    rows = [("c", i, f"s{i}", json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "chain_id string, step_idx int, name string, input string, output string")


@pytest.mark.parametrize(
    ("before", "after", "fidelity"),
    [
        ({"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 2}, 2 / 3), ({"a": 1}, {"a": 2}, 0.0), ({"a": 1}, {"a": "1"}, 0.0), ({"a": 1}, {"a": 1, "b": 2}, 1.0),
        ({"a": "x"}, {"b": "x"}, 1.0), ({}, {"a": 1}, 1.0), ({"l": [1]}, {"l": [1, 2]}, 1.0), ({"l": [1, 2]}, {"l": [1]}, 1 / 3), ({"a": ""}, {"b": ""}, 0.0), ({"a": True}, {"b": 1}, 1.0),
    ],
)
def test_seam_fidelity(spark, before, after, fidelity):
    r = seams.handoffs(chain(spark, ({}, before), (after, {}))).first()
    assert r["fidelity"] == pytest.approx(fidelity, abs=1e-6)


def test_chain_audit_and_blame(spark):
    f = lambda n: {f"f{i}": f"v{i}" for i in range(n)}
    steps = chain(spark, ({}, f(5)), (f(4), f(4)), (f(2), f(2)), (f(1), f(1)), (f(1), f(1)), ({}, {}))
    s = seams.handoffs(steps)
    assert [r["fidelity"] for r in s.orderBy("seam").collect()] == [0.8, 0.5, 0.5, 1.0, 0.0]
    a = seams.chain_audit(s).first()
    assert (a["chain_fidelity"], a["fidelity_halflife"]) == (0.0, 5)
    worst = seams.blame(s).filter("rank = 1").first()
    assert (worst["seam"], worst["severity"]) == (2, 2.0)


def test_suite(spark):
    rows = [("good", '```json\n{"k": 20}\n```', 100.0, None), ("slow", '{"k": 20}', 9000.0, None), ("bad", "not json", 1.0, None), ("blank", "  ", None, None), ("off", '{"k": 30}', 1.0, "entirely different words")]
    out = spark.createDataFrame(rows, "name string, value string, latency_ms double, reference string")
    checks = suite.run_checks(out, {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}, budget_ms=500.0)
    failed = {}
    for r in checks.filter("NOT passed").orderBy("name", "check_no").collect():
        failed.setdefault(r["name"], []).append(r["check"])
    assert failed == {"slow": ["latency_budget"], "bad": ["schema_conformity", "json_valid", "required_fields"], "blank": ["schema_conformity", "content_bounds", "json_valid", "required_fields", "latency_budget"], "off": ["similarity"]}
    verdict = {r["name"]: r["verdict"] for r in suite.verdicts(checks).collect()}
    assert verdict == {"good": "PASS", "slow": "FAIL", "bad": "FAIL", "blank": "FAIL", "off": "ESCALATE"}


def test_no_regression(spark):
    base = spark.createDataFrame([("a", "same words here"), ("b", '{"x": 1, "y": 2}'), ("c", "gone")], "name string, value string")
    now = spark.createDataFrame([("a", "same words here"), ("b", '{"y": 2, "x": 3}'), ("d", "extra")], "name string, value string")
    assert {r["name"]: r["problem"] for r in suite.no_regression(base, now).collect()} == {"b": "changed", "c": "missing"}


def test_grid_and_validation(spark):
    topics = spark.createDataFrame([(0, "T One", "c"), (1, "T two", "c")], "ordinal int, topic string, capability string")
    g = datasets.grid(topics, ["p", "q"], ("easy", "hard")).orderBy("cell").collect()
    assert len(g) == 8 and {r["edge_case"] for r in g} == set(datasets.EDGE_CASES) and g[0]["item_id"] == "T One__p__easy__empty_input__0"
    items = spark.createDataFrame([("a", "p", "r", "typical"), ("a", "p", "r", "typical"), ("", "p", " ", "typical"), ("b", "", "r", "empty_input"), ("c", "", "r", "typical")], "item_id string, prompt string, reference string, edge_case string")
    assert sorted(r["problem"] for r in datasets.validate(items).collect()) == ["duplicate item_id", "empty item_id", "empty prompt", "empty reference"]


def test_decontamination_by_line(spark):
    items = spark.createDataFrame([(1, "see the quick brown fox run"), (2, "over the lazy dog today")], "id long, t string")
    corpus = spark.createDataFrame([("the quick brown fox jumps\nover the lazy",)], "t string")
    got = {r["id"]: (r["n_hits"], r["contaminated"]) for r in datasets.flag_contaminated(items, corpus, "id", "t", "t", 4).collect()}
    assert got == {1: (1, True), 2: (0, False)}
    assert [r["id"] for r in datasets.drop_contaminated(items, corpus, "id", "t", "t", 4).collect()] == [2]


def test_label_lines(spark, tmp_path):
    p = tmp_path / "labels.jsonl"
    p.write_text('{"item_id": "a", "judge_score": 1.5}\n\n{"judge_score": 2}\nnot json\n')
    with pytest.raises(ValueError, match="line 3: missing item_id; line 4: not JSON"):
        jsonl.load_labels(spark, str(p))
    p.write_text('{"item_id": "a", "judge_score": 1.5}\n')
    assert jsonl.load_labels(spark, str(p)).first()["judge_score"] == 1.5


def test_traces_and_outputs(spark, tmp_path):
    shapes = {"list": '[{"name": "a", "output": {"x": 1}}, {"step": "b"}, {}]', "steps": '{"steps": [{"name": "a"}]}', "lines": '{"name": "a"}\n{"name": "b"}\n'}
    for k, v in shapes.items():
        (tmp_path / f"{k}.json").write_text(v)
    rows = jsonl.load_traces(spark, str(tmp_path)).collect()
    names = {}
    for r in sorted(rows, key=lambda r: r["step_idx"]):
        names.setdefault(os.path.basename(r["chain_id"]), []).append(r["name"])
    assert names == {"list.json": ["a", "b", "step-2"], "steps.json": ["a"], "lines.json": ["a", "b"]}
    (tmp_path / "list.json").write_text('[\n  {"name": "a"},\n  {"name": "b"}\n]\n')
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "t.json").write_text("\n".join(f'{{"name": "n{i}"}}' for i in range(30)))
    for folder, want in ((str(tmp_path / "list.json"), ["a", "b"]), (str(tmp_path / "long"), [f"n{i}" for i in range(30)])):
        assert [(r["step_idx"], r["name"]) for r in jsonl.load_traces(spark, folder).orderBy("step_idx").collect()] == list(enumerate(want))
    (tmp_path / "outs").mkdir()
    (tmp_path / "outs" / "o.jsonl").write_text('{"name": "n", "value": "old"}\n{"value": {"k": 1}, "latency_ms": 5}\n{"name": "n", "output": "new"}\n')
    got = {r["name"]: (r["value"], r["latency_ms"]) for r in jsonl.load_outputs(spark, str(tmp_path / "outs")).collect()}
    assert got == {"n": ("new", None), "output-2": ('{"k":1}', 5.0)}


def test_dataset_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("i1", "p", "r", "c", "t", "u", "easy", "typical", {"a": "b"})], jsonl.ITEM)
    store.save(items, str(tmp_path), "v1", "first")
    again, manifest = store.load(spark, str(tmp_path), "v1")
    assert again.first()["meta"] == {"a": "b"} and manifest["n_items"] == 1 and manifest["coverage"] == {"t|u|easy": 1}
    with pytest.raises(store.DatasetValidationError):
        store.save(items.unionByName(items), str(tmp_path), "v2")


def test_streaming_means(spark, tmp_path):
    from judgelab.streaming.gate import windowed_means

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "c", 1.0), ("2024-01-01 00:20:00", "c", 3.0), ("2024-01-01 02:00:00", "c", 5.0)], "t string, capability string, score double").select(F.to_timestamp("t").alias("ts"), "capability", "score")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_means(stream).writeStream.format("memory").queryName("means").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["n"], r["mean_score"]) for r in spark.table("means").orderBy("window_start").collect()][:1] == [(2, 2.0)]


def test_seams_in_a_row_equal_seams_field_by_field(spark):
    """Nested, deep, list, boolean, empty, null and unreadable texts, and two fields of one path, counted by both ways."""
    texts = [
        '{"a": 1, "b": true, "c": "", "d": null, "e": {"f": [1, 2, 3, 4], "g": {}}}', '{"a": 1.0, "b": 1, "e": {"f": [1, 2, 3, 4, 5]}, "x": "y"}', '{"a": "1", "e.f": 2, "e": {"f": 2}}', '{"k": {"l": {"m": {"n": {"o": [1, {"p": "y"}]}}}}, "z": true}',
        '{"k": {"l": {"m": {"n": {"o": [1, {"p": "n"}, 3]}}}}, "z": 1}', "[1, [2, null], {}]", "[]", "7", "null", '""', "no json {{{", None, '{"b": false, "q": 0, "u": "a.b", "e": {"f": [1]}}', '{"other": 0, "b": "false", "list": []}',
    ]
    rows = [(f"{i}-{j}", k, "s", a, b) for i, x in enumerate(texts) for j, y in enumerate(texts) for k, (a, b) in enumerate(((None, x), (y, None)))]
    steps = spark.createDataFrame(rows, "chain_id string, step_idx int, name string, input string, output string")
    in_rows, field_by_field = seams.handoffs(steps), seams.handoffs(steps, row_fields=-1)
    assert sorted(in_rows.collect()) == sorted(field_by_field.collect()) and in_rows.count() == len(texts) ** 2
    inside = seams._row_counts(seams.seam_pairs(steps), seams.ROW_FIELDS)
    assert inside.filter("kept IS NULL").count() == len(texts) ** 2 - 11**2
