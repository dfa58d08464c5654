import json

from judgelab.cli import main
from judgelab.sources.snapshots import SnapshotStore


def test_calibrate(spark, tmp_path, capsys):
    rows = [(1, 1), (2, 1.5), (3, 2), (4, 2.5), (5, 3), (2.5, 2), (3.5, 3), (4.5, 4)]
    p = tmp_path / "labels.jsonl"
    p.write_text("\n".join(json.dumps({"item_id": f"i{k}", "judge_score": j, "human_score": h, "response_a": "w " * k, "prompt": "p"}) for k, (j, h) in enumerate(rows)))
    assert main(["calibrate", "--labels", str(p)], spark) == 0
    assert '"n": 8' in capsys.readouterr().out
    p.write_text("not json\n")
    assert main(["calibrate", "--labels", str(p)], spark) == 2


def test_regress(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    for v, score in (("v1", 4.0), ("v2", 3.0)):
        store.append(spark.range(20).selectExpr(f"'{v}' AS model_version", "CAST(id AS STRING) AS item_id", "'c' AS capability", f"{score}D AS score"))
    args = ["regress", "--store", str(tmp_path / "s"), "--baseline", "v1", "--candidate"]
    assert main([*args, "v2"], spark) == 0 and main([*args, "v2", "--gate"], spark) == 1 and main([*args, "v9", "--gate"], spark) == 2


def test_audit_and_suite(spark, tmp_path):
    t = tmp_path / "t.json"
    t.write_text('[{"output": {"a": 1}}, {"input": {}}]')
    assert main(["audit", "--trace", str(t)], spark) == 0 and main(["audit", "--trace", str(t), "--min-fidelity", "0.5"], spark) == 1
    o = tmp_path / "o.jsonl"
    o.write_text('{"name": "n", "value": "fine"}\n')
    assert main(["suite", "--outputs", str(o)], spark) == 0 and main(["suite", "--outputs", str(o), "--budget", "5"], spark) == 1
