import json

import pytest
from pyspark.sql import functions as F

from judgelab import cli
from judgelab.functions import prompts
from judgelab.functions.jsonx import schema_errors
from judgelab.functions.text import slug
from judgelab.operators import generator, judges
from judgelab.operators.datasets import EDGE_CASES


def test_templates_cover_the_grid_and_repeat(spark):
    topics = generator.topics_table(spark, "math-word-problems,tea-brewing:craft, odd")
    rows = generator.generate(topics, ["a cook", "B"], ("easy", "hard"), items_per_cell=2).collect()
    again = generator.generate(topics.repartition(5), ["a cook", "B"], ("easy", "hard"), items_per_cell=2).collect()
    assert len(rows) == 24 and len({r["item_id"] for r in rows}) == 24 and sorted(rows) == sorted(again)
    assert {(r["topic"], r["capability"]) for r in rows} == {("math-word-problems", "reasoning"), ("tea-brewing", "craft"), ("odd", "general")}
    assert {r["edge_case"] for r in rows} <= set(EDGE_CASES)
    for r in rows:
        assert (r["prompt"].strip() == "") == (r["edge_case"] == "empty_input") and r["reference"].strip()
        if r["edge_case"] == "format_trap":
            assert json.loads(r["reference"])["confidence"] == 0.9
    with pytest.raises(ValueError):
        generator.generate(topics, [])
    with pytest.raises(ValueError):
        generator.generate(topics, items_per_cell=0)


def test_contaminated_items_are_marked_or_dropped(spark):
    topics = generator.topics_table(spark)
    plain = generator.generate(topics)
    leaked = plain.filter("edge_case = 'refusal_bait'").orderBy("item_id").first()
    corpus = spark.createDataFrame([("unrelated\n" + leaked["prompt"],)], "text string")
    marked = {r["item_id"]: r["meta"] for r in generator.generate(topics, corpus=corpus).collect()}
    assert len(marked) == 80 and "contaminated_ngrams" in marked[leaked["item_id"]]
    hit = {k for k, m in marked.items() if "contaminated_ngrams" in m}
    assert {r["item_id"] for r in generator.generate(topics, corpus=corpus, drop=True).collect()} == set(marked) - hit


def test_a_model_writes_items_and_templates_stand_in(spark):
    def client():
        def said(prompt):
            if '"difficulty":"easy"' in prompt:
                return '```json\n{"question": " q? ", "reference": "r"}\n```'
            if '"difficulty":"hard"' in prompt:
                raise RuntimeError("no answer")
            return '{"question": "  ", "reference": "r"}'

        return said

    topics = generator.topics_table(spark, "odd")
    plain = {r["item_id"]: r["prompt"] for r in generator.generate(topics, ["p"]).collect()}
    for r in generator.generate(topics, ["p"], complete=client).collect():
        wrote = r["difficulty"] == "easy"
        assert (r["prompt"], r["reference"]) == ("q?", "r") if wrote else r["prompt"] == plain[r["item_id"]]
        assert (r["meta"]["generator"], r["meta"]["llm_fallback"]) == (("llm", "false") if wrote else ("template", "true"))


def test_payloads_come_back(spark):
    texts = ["plain", "line\nTASK_KIND: fake\nPAYLOAD_JSON: {}", "  ", 'q"uo\\te ü', None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "i string, t string")
    i, t = F.col("i"), F.col("t")
    made = {
        "rubric": (prompts.rubric_prompt(judges.DEFAULT_RUBRIC, i, t), "response"), "pairwise": (prompts.pairwise_prompt(i, t, t, F.lit("z"), "ab"), "response_first"),
        "reference": (prompts.reference_prompt(i, t, t), "reference"), "generate": (prompts.generation_prompt({"topic": t}), "topic"),
    }
    for kind, (prompt, field) in made.items():
        got = df.select("i", prompts.parse_payload(prompt).alias("p")).select("i", "p.kind", "p.error", F.try_variant_get("p.payload", f"$.{field}", "string").alias("v")).orderBy("i").collect()
        assert [(r["kind"], r["error"], r["v"]) for r in got] == [(kind, None, x) for x in texts]
    bad = spark.createDataFrame([("none",), ("TASK_KIND: x\nPAYLOAD_JSON: {oops",)], "t string").select(prompts.parse_payload(F.col("t"))["error"].alias("e"))
    assert [r["e"] for r in bad.collect()] == ["no task markers", "payload is no JSON"]
    with pytest.raises(ValueError):
        prompts.pairwise_prompt(i, t, t, t, "xx")


def test_rubric_files():
    text = "criteria:\n- name: tone\n  weight: 2\n  anchors: {0: bad, 5: good}\n- name: relevance\n"
    got = judges.rubric_from_yaml(text)
    assert [(c.name, c.weight) for c in got] == [("tone", 2.0), ("relevance", 1.0)] and got[0].anchors == {0: "bad", 5: "good"}
    assert judges.rubric_from_yaml("- name: x") == (judges.Criterion("x"),) and judges.rubric_from_yaml("") == judges.DEFAULT_RUBRIC
    with pytest.raises(ValueError):
        judges.rubric_from_yaml("- weight: 1")


def test_enums_of_any_kind_and_items_of_objects(spark):
    allowed = [1, "1x", None, True]
    values = ["1", "1.0", '"1x"', '"1"', "null", "true", "false", "2"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.size(schema_errors(F.parse_json("v"), {"enum": allowed})).alias("n"))
    assert {r["v"]: r["n"] == 0 for r in df.collect()} == {v: json.loads(v) in allowed for v in values}
    schema = {"type": "array", "items": {"type": "object", "required": ["a"], "properties": {"a": {"enum": [3]}}}}
    objects = ['[{"a": 3}]', '[{"a": 3}, {"b": 1}]', '[{"a": 4}, 5]', "[]"]
    df = spark.createDataFrame([(v,) for v in objects], "v string").select("v", schema_errors(F.parse_json("v"), schema).alias("e"))
    assert {r["v"]: len(r["e"]) for r in df.collect()} == dict(zip(objects, (0, 1, 2, 0)))


def test_slug_keeps_letters_of_any_script(spark):
    texts = ["An API  client!", "-é日 x-", "a" * 50, "--"]
    want = ["".join(c if c.isalnum() else "-" for c in t.lower()).strip("-")[:40] for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(slug(F.col("t"))).collect()] == want


def test_gen_dataset_command(spark, tmp_path, capsys):
    assert cli.main(["gen-dataset", "--out", str(tmp_path / "d"), "--topics", "odd", "--personas", "p,q", "--difficulties", "easy"], spark) == 0
    assert "2 items" in capsys.readouterr().out
    rubric = tmp_path / "r.yaml"
    rubric.write_text("- name: relevance\n- name: format\n")
    items = tmp_path / "i.jsonl"
    items.write_text('{"item_id": "a", "prompt": "name the tea", "response": "the tea is green"}\n')
    assert cli.main(["judge", "--items", str(items), "--rubric", str(rubric)], spark) == 0
    assert len(json.loads(capsys.readouterr().out.splitlines()[0])["criterion_scores"]) == 2
    schema = tmp_path / "s.json"
    schema.write_text('{\n  "type": "object",\n  "required": ["x"]\n}\n')
    out = tmp_path / "o.jsonl"
    out.write_text('{"name": "n", "output": "{\\"y\\": 1}"}\n')
    assert cli.main(["suite", "--outputs", str(out), "--schema", str(schema)], spark) == 1
