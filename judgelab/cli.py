"""Command line: small reports over files.  Exit codes: 0 done, 1 a gate failed, 2 bad input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.operators import calibration, datasets, generator, isotonic, judges, regression, seams, stats, suite
from judgelab.sources import datasets as store
from judgelab.sources import jsonl
from judgelab.sources.snapshots import SnapshotStore


def _show(df: DataFrame, n: int = 50) -> None:
    for r in df.limit(n).collect():
        print(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True))


def judge(spark: SparkSession, a: argparse.Namespace) -> int:
    items = spark.read.schema("item_id string, prompt string, response string, reference string").json(a.items)
    criteria = judges.rubric_from_yaml(spark.read.text(a.rubric, wholetext=True).first()[0]) if a.rubric else judges.DEFAULT_RUBRIC
    out = judges.heuristic_judge(items, criteria).select("item_id", "overall", "criterion_scores")
    if a.out:
        out.write.mode("overwrite").json(a.out)
    else:
        _show(out)
    return 0


def pair(spark: SparkSession, a: argparse.Namespace) -> int:
    pairs = spark.read.schema("item_id string, response_a string, response_b string").json(a.pairs)
    results = judges.pairwise_judge(pairs)
    _show(results)
    print(f"position bias rate {judges.position_bias_rate(results).first()[0]:.3f}")
    return 0


def calibrate(spark: SparkSession, a: argparse.Namespace) -> int:
    labels = jsonl.load_labels(spark, a.labels)
    families = labels.withColumns({c: F.col("meta")[k] for k, c in (("judge_family", "judge_family"), ("response_a_family", "a_family"), ("response_b_family", "b_family"))})
    pairs = labels.filter("response_a IS NOT NULL AND response_b IS NOT NULL")
    found = calibration.calibration_report(families, "line_no", judges.pairwise_judge(pairs)).first().asDict()
    advice = found.pop("advice")
    print("# Calibration\n")
    print(json.dumps(found, sort_keys=True))
    for line in advice:
        print(f"- {line}")
    print("\nNext to label:")
    _show(calibration.next_round(labels, 5).select("item_id", F.round("priority", 4).alias("priority")))
    return 0


def regress(spark: SparkSession, a: argparse.Namespace) -> int:
    runs = SnapshotStore(spark, a.store)
    base, cand = runs.latest(a.baseline), runs.latest(a.candidate)
    if base.isEmpty() or cand.isEmpty():
        raise ValueError("no snapshot of one of the versions")
    result = regression.run_gate(base, cand, a.threshold, a.min_effect)
    print(result.report_markdown)
    return result.exit_code if a.gate else 0


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    found = seams.handoffs(jsonl.load_traces(spark, a.trace)).cache()
    chains = seams.chain_audit(found)
    _show(chains)
    _show(seams.blame(found).filter("rank <= 3"))
    return int(a.min_fidelity is not None and not chains.filter(F.col("chain_fidelity") < a.min_fidelity).isEmpty())


def run_suite(spark: SparkSession, a: argparse.Namespace) -> int:
    schema = json.loads(spark.read.text(a.schema, wholetext=True).first()[0]) if a.schema else None
    outputs = jsonl.load_outputs(spark, a.outputs).withColumn("reference", F.lit(None).cast("string"))
    checks = suite.run_checks(outputs, schema, a.budget)
    failed = checks.filter("NOT passed").orderBy("name", "check_no")
    _show(failed)
    return int(not failed.isEmpty())


def gen_dataset(spark: SparkSession, a: argparse.Namespace) -> int:
    corpus = spark.read.text(a.corpus).withColumnRenamed("value", "text") if a.corpus else None
    listed = lambda v: v.split(",") if v else None
    items = generator.generate(generator.topics_table(spark, a.topics), listed(a.personas), tuple(listed(a.difficulties) or datasets.DIFFICULTIES), items_per_cell=a.items_per_cell, seed=a.seed, corpus=corpus, n=a.n, drop=a.on_contamination == "drop")
    store.save(items, a.out, a.version, f"seed={a.seed}, decontamination_n={a.n}")
    print(f"{items.count()} items in {a.out}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="judgelab")
    sub = p.add_subparsers(required=True)

    def command(name, f, *required):
        c = sub.add_parser(name)
        c.set_defaults(run=f)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        return c

    j = command("judge", judge, "items")
    j.add_argument("--out")
    j.add_argument("--rubric")
    command("pair", pair, "pairs")
    command("calibrate", calibrate, "labels")
    r = command("regress", regress, "store", "baseline", "candidate")
    r.add_argument("--threshold", type=float, default=0.05)
    r.add_argument("--min-effect", type=float, default=0.1)
    r.add_argument("--gate", action="store_true")
    command("audit", audit, "trace").add_argument("--min-fidelity", type=float)
    g = command("gen-dataset", gen_dataset, "out")
    for name in ("topics", "personas", "difficulties", "corpus"):
        g.add_argument(f"--{name}")
    for name, default in (("items-per-cell", 1), ("seed", 42), ("n", 8)):
        g.add_argument(f"--{name}", type=int, default=default)
    g.add_argument("--on-contamination", choices=("flag", "drop"), default="flag")
    g.add_argument("--version", default="v1")
    s = command("suite", run_suite, "outputs")
    s.add_argument("--schema")
    s.add_argument("--budget", type=float)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("judgelab").getOrCreate()
    try:
        return a.run(spark, a)
    except (ValueError, FileNotFoundError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
