import pytest
from pyspark.sql import functions as F

from judgelab.functions.text import degrade, f1_overlap, ngrams, tokens
from judgelab.operators import judges


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("It's Über-café 2x!",), (None,)], "t string").select(tokens("t").alias("t"), ngrams(tokens("t"), 2).alias("g"), ngrams(tokens("t"), 9).alias("n")).collect()
    assert df[0]["t"] == ["it's", "über", "café", "2x"] and df[0]["g"] == ["it's über", "über café", "café 2x"] and df[0]["n"] == []
    assert df[1]["t"] == [] and df[1]["g"] == []


def test_f1_counts_repeats(spark):
    df = spark.createDataFrame([(1, "a a b", "a b b"), (2, "x", "y"), (3, "", "y")], "id long, l string, r string")
    assert {r["id"]: round(r["f1"], 6) for r in f1_overlap(df, "id", "l", "r").collect()} == {1: 0.666667, 2: 0.0, 3: 0.0}


def test_degrade(spark):
    import hashlib

    text = " ".join(f"word{i}" for i in range(50)) + "  double"
    kept = [w for i, w in enumerate(text.split(" ")) if int.from_bytes(hashlib.sha256(f"{text[:32]}|{i}".encode()).digest()[:4], "big") / 2**32 < 0.7]
    r = spark.createDataFrame([(text,)], "t string").select(degrade(F.col("t"), 0.7).alias("a"), degrade(F.col("t"), 1.0).alias("b"), degrade(F.col("t"), 0.0).alias("c")).first()
    assert r["a"] == " ".join(kept) and r["b"] == text and r["c"] == "word0"


def items(spark, *rows):
    return spark.createDataFrame(rows, "item_id string, prompt string, response string, reference string")


def test_heuristic_judge(spark):
    df = items(spark, ("blank", "Explain gravity", "  ", ""), ("short", "Explain gravity", "ok then", ""), ("good", "Explain gravity to pupils", "Gravity pulls pupils down. We explain it.\n\nMore.", ""), ("json", "Reply in JSON", '{"a": 1}', ""), ("broken", "Reply in JSON", "{a", ""), ("list", "Give a bullet list", "- one\n- two", ""))
    got = {r["item_id"]: {c["name"]: c["score"] for c in r["criterion_scores"]} | {"overall": r["overall"]} for r in judges.heuristic_judge(df).collect()}
    assert set(got["blank"].values()) == {0.0}
    assert got["short"]["relevance"] == 1.0 and got["short"]["format"] == 3.0
    assert got["good"]["relevance"] == 5.0 and got["good"]["clarity"] == 3.0
    assert (got["json"]["format"], got["broken"]["format"], got["list"]["format"]) == (5.0, 3.0, 5.0)


def test_weights_and_payloads(spark):
    rubric = (judges.Criterion("x", weight=2.0), judges.Criterion("y", weight=1.0))
    df = spark.createDataFrame([(1, '{"scores": [{"name": "x", "score": 4}, {"name": "y", "score": 2}]}'), (2, '{"scores": [{"name": "x", "score": 9}]}'), (3, "no json")], "id long, p string")
    got = {r["id"]: r for r in judges.rubric_payload(df, "p", rubric).collect()}
    assert got[1]["overall"] == pytest.approx(3.3333) and got[1]["error"] is None
    assert "y" in got[2]["error"] and got[3]["error"]


def test_pairwise_orders_cancel_bias(spark):
    pairs = spark.createDataFrame([("1", "long text", "short"), ("2", "same", "same")], "item_id string, response_a string, response_b string")
    got = {r["item_id"]: (r["score_a"], r["winner"], r["position_bias"]) for r in judges.pairwise_judge(pairs).collect()}
    assert got == {"1": (1.0, "a", False), "2": (0.5, "tie", False)}
    rigged = judges.pairwise_judge(pairs, lambda a, b: F.lit("first"))
    assert all((r["score_a"], r["winner"], r["position_bias"]) == (0.5, "tie", True) for r in rigged.collect())
    assert judges.position_bias_rate(rigged).first()[0] == 1.0 and judges.position_bias_rate(rigged.limit(0)).first()[0] == 0.0


def test_ensemble_and_consistency(spark):
    scores = spark.createDataFrame([("i", "a", 4.0), ("i", "b", 2.0)], "item_id string, judge string, overall double")
    r = judges.ensemble(scores, {"a": 3.0, "b": 1.0}).first()
    assert (r["overall"], r["disagreement"], r["flagged"]) == (3.5, 2.0, True)
    samples = spark.createDataFrame([("p", float(s)) for s in (4, 4, 4, 2, 4)] + [("q", 2.0), ("q", 3.0)], "item_id string, score double")
    got = {r["item_id"]: r for r in judges.self_consistency(samples).collect()}
    assert got["p"]["majority_score"] == 4 and got["p"]["variance"] == pytest.approx(0.64) and got["q"]["majority_score"] == 2


def test_model_judge_survives_failures(spark):
    def client():
        def call(text):
            if "bad" in text:
                raise RuntimeError("down")
            return text.upper()

        return call

    df = spark.createDataFrame([("ok",), ("bad",)], "p string")
    assert {r["p"]: r["payload"] for r in judges.model_judge(df, client, "p").collect()} == {"ok": "OK", "bad": None}
