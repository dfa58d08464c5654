"""Every query of the catalogue: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.functions import prompts
from judgelab.functions.jsonx import flatten
from judgelab.functions.tables import step_path, written
from judgelab.functions.text import content_tokens, degrade, f1_overlap, hash_similarity, keyword_coverage, normalize, tokens
from judgelab.operators import calibration, datasets, generator, isotonic, judges, regression, seams, stats, suite
from judgelab.plans import inputs
from judgelab.plans.inputs import read
from judgelab.sources import datasets as versions
from judgelab.sources import jsonl
from judgelab.sources.snapshots import SnapshotStore, latest_run


def tokens_per_doc(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", tokens("text").alias("t"), content_tokens("text").alias("c"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size("c").alias("n_content"), F.size(F.array_distinct("t")).alias("n_distinct"))


def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(normalize("text")).alias("digest"))


def keyword_coverage_qa(spark, d):
    return inputs.qa(spark, d).select("item_id", F.round(keyword_coverage(content_tokens("prompt"), tokens("response")), 6).alias("coverage"))


def token_f1(spark, d):
    return f1_overlap(inputs.qa(spark, d), "item_id", "prompt", "response").select("item_id", F.round("f1", 6).alias("f1"))


def decontaminate_flag(spark, d):
    found = datasets.flag_contaminated(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "text", "text")
    return found.select("item_id", "n_hits", "contaminated")


def decontaminate_drop(spark, d):
    return datasets.drop_contaminated(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "text", "text").select("item_id")


def hit_sample(spark, d):
    return datasets.flag_contaminated(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "text", "text").select("item_id", "sample")


def format_score(spark, d):
    e = inputs.suite_outputs(spark, d).select("name", "value", F.when(F.col("name").cast("long") % 3 == 0, "reply in json").when(F.col("name").cast("long") % 3 == 1, "give a list").otherwise("reply").alias("prompt"))
    return e.select("name", judges.format_score(F.col("prompt"), F.col("value")).alias("score"))


def heuristic_judge(spark, d):
    return judges.heuristic_judge(inputs.qa(spark, d)).select("item_id", F.element_at("criterion_scores", 1)["score"].alias("relevance"), F.element_at("criterion_scores", 3)["score"].alias("clarity"), F.round("overall", 3).alias("overall"))


def reference_judge(spark, d):
    return judges.reference_judge(inputs.qa(spark, d).withColumnRenamed("prompt", "reference")).select("item_id", "overall")


def degrade_replay(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(degrade(F.col("text"), 0.7)).alias("digest"))


def golden_run(spark, d):
    return inputs.snapshot(spark, d, 0.7, "v2").select("item_id", "capability", "score")


def capability_means(spark, d):
    m = regression.capability_means(inputs.snapshot(spark, d, 0.7, "v2"))
    return m.select("capability", "n", F.round("mean_score", 6).alias("mean_score"))


def _runs(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_type").alias("model_version"), (F.col("user_id") % 7).alias("run_seq"), F.col("event_id").cast("string").alias("item_id"), F.col("value").alias("score"))


def snapshot_latest(spark, d):
    return latest_run(_runs(spark, d)).groupBy("model_version", "run_seq").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def paired_deltas(spark, d):
    return inputs.deltas(spark, d).select("item_id", "capability", F.round("delta", 5).alias("delta"))


def missing_items(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"))
    return regression.missing_items(docs.filter("CAST(item_id AS LONG) % 5 <> 0"), docs.filter("CAST(item_id AS LONG) % 7 <> 0"))


def paired_effect(spark, d):
    return inputs.deltas(spark, d).agg(F.round(stats.paired_effect("delta"), 6).alias("effect"))


def cliffs_delta(spark, d):
    both = inputs.snapshots(spark, d, {"x": 0.75, "y": 0.7})
    return stats.cliffs_delta(both, "model_version", "score").select(F.round("cliffs_delta", 6).alias("cliffs_delta"))


def wilcoxon_stat(spark, d):
    w = stats.wilcoxon(inputs.deltas(spark, d), "delta")
    return w.select("n", F.round("w_plus", 1).alias("w_plus"), F.round("variance", 2).alias("variance"), F.round("z", 4).alias("z"))


def wilcoxon_exact(spark, d):
    groups = read(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("sample"), (F.col("value") - 50).alias("delta"))
    return stats.wilcoxon(groups, "delta", ["sample"]).select("sample", "n", F.round("w_plus", 1).alias("w_plus"), F.round("p_value", 6).alias("p_value"), "method")


def wilcoxon_p_normal(spark, d):
    t = stats.wilcoxon(inputs.deltas(spark, d), "delta")
    return t.select("n", F.round("w_plus", 1).alias("statistic"), F.round("p_value", 6).alias("p_value"), "method")


def bootstrap_ci(spark, d):
    ci = stats.bootstrap_ci(inputs.deltas(spark, d), "delta", seed=12345)
    return ci.select("n", F.round("mean", 5).alias("mean"), F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"))


def drift_slices(spark, d):
    s = regression.drift_slices(inputs.deltas(spark, d))
    return s.select("capability", "n", F.round("mean_delta", 5).alias("mean_delta"), F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"), F.round("effect_size", 5).alias("effect_size"), "verdict")


def gate_decision(spark, d):
    s = regression.drift_total(inputs.deltas(spark, d))
    return s.select("n", F.round("mean_delta", 5).alias("mean_delta"), "verdict", (F.col("verdict") != "regressed").alias("passed"))


def drift_summary(spark, d):
    deltas = inputs.deltas(spark, d)
    return regression.drift_summary(regression.drift_total(deltas), stats.wilcoxon(deltas, "delta"), regression.drift_slices(deltas), missing_items(spark, d))


def metrics_summary(spark, d):
    m = regression.metrics_summary(inputs.snapshot(spark, d, 0.7, "v2"))
    return m.select("n_items", "mean_score", F.to_json("capability_means").alias("capability_means"), F.length("snapshot_sha256").alias("digest_length"))


def kappa(spark, d):
    return stats.cohen_kappa(_levels(spark, d), "judge", "human").select(F.round("kappa", 6).alias("kappa"))


def _levels(spark, d):
    return inputs.judged_labels(spark, d).select(F.rint("judge_score").cast("int").alias("judge"), F.rint("human_score").cast("int").alias("human"))


def qwk(spark, d):
    return stats.quadratic_weighted_kappa(_levels(spark, d), "judge", "human").select(F.round("qwk", 6).alias("qwk"))


def spearman(spark, d):
    return stats.spearman(inputs.judged_labels(spark, d), "judge_score", "human_score").select(F.round("spearman", 6).alias("spearman"))


def midranks(spark, d):
    return stats.midranks(inputs.judged_labels(spark, d), "judge_score")


def agreement_summary(spark, d):
    s = stats.agreement_summary(inputs.judged_labels(spark, d), "judge_score", "human_score")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("spearman", "mae", "within_1", "kappa")])


def pav_fit(spark, d):
    pts = inputs.judged_labels(spark, d)
    return isotonic.fit(pts, "judge_score", "human_score", "doc_id").select(F.round("x_start", 6).alias("x_start"), F.round("x_end", 6).alias("x_end"), F.round("value", 6).alias("value"), F.round("weight", 3).alias("weight"))


def pav_predict(spark, d):
    pts = inputs.judged_labels(spark, d)
    blocks = isotonic.fit(pts, "judge_score", "human_score", "doc_id")
    return isotonic.predict(pts.select("doc_id", "judge_score"), "judge_score", blocks).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


def verbosity_ols(spark, d):
    s = calibration.verbosity_ols(inputs.judged_labels(spark, d), "judge_score", "n_tokens")
    return s.select("n", F.round(F.col("slope") * 1000, 5).alias("slope_per_1000"), F.round("intercept", 5).alias("intercept"), F.round("r", 5).alias("r"))


def verbosity_permutation(spark, d):
    s = calibration.verbosity_permutation(inputs.judged_labels(spark, d), "item_id", "human_score", "n_tokens")
    return s.select("n", F.round("p_value", 6).alias("p_value"), "significant")


def _families(spark, d):
    return read(spark, d, "labels").select(F.element_at(F.array(F.lit("f0"), F.lit("f1"), F.lit("f2")), (F.col("doc_id") % 3 + 1).cast("int")).alias("judge_family"), F.concat(F.lit("f"), (F.col("doc_id") % 2).cast("string")).alias("a_family"), F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("b_family"), F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, "b").otherwise("tie").alias("preferred"))


def self_preference(spark, d):
    return calibration.self_preference(_families(spark, d)).select("n_comparable", "n_flagged", F.round("rate", 6).alias("rate"))


def bias_summary(spark, d):
    labels = inputs.judged_labels(spark, d).join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    family = lambda n: F.concat(F.lit("f"), (F.col("doc_id") % n).cast("string"))
    preferred = F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, "b").otherwise("tie")
    items = labels.select("item_id", F.lit("a prompt").alias("prompt"), F.when(F.col("doc_id") % 6 != 0, F.col("text")).alias("response_a"), "judge_score", family(3).alias("judge_family"), family(2).alias("a_family"), family(5).alias("b_family"), preferred.alias("preferred"))
    s = calibration.summarize_bias(items, pairwise_debias(spark, d))
    return s.select(F.round("position_bias_rate", 6).alias("position_bias_rate"), F.round(F.col("verbosity_slope") * 1000, 5).alias("slope_per_1000"), F.round("verbosity_r", 5).alias("r"), "n_comparable", "n_flagged", F.round("rate", 6).alias("rate"), F.round("verbosity_p", 6).alias("p_value"), "significant")


def active_queue(spark, d):
    labels = inputs.judged_labels(spark, d).withColumn("human_score", F.when(F.col("doc_id") % 3 != 0, F.col("human_score")))
    return calibration.next_round(labels, 10).select("item_id", F.round("priority", 6).alias("priority"))


def _pairs(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    a, b = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("response_b"))
    return a.join(b, "doc_id").select(F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("response_a"), "response_b")


def pairwise_debias(spark, d):
    return judges.pairwise_judge(_pairs(spark, d))


def position_bias_rate(spark, d):
    first = judges.pairwise_judge(_pairs(spark, d), lambda a, b: F.when(F.length(a) > 2 * F.length(b), "first").when(F.length(b) > 2 * F.length(a), "second").otherwise("first"))
    return judges.position_bias_rate(first).select(F.round("position_bias_rate", 6).alias("position_bias_rate"))


def ensemble(spark, d):
    items = inputs.qa(spark, d)
    long = judges.heuristic_judge(items).select("item_id", F.lit("heuristic").alias("judge"), "overall").unionByName(judges.reference_judge(items.withColumnRenamed("prompt", "reference")).select("item_id", F.lit("reference").alias("judge"), "overall"))
    return judges.ensemble(long, {"heuristic": 3.0, "reference": 1.0}).select("item_id", F.round("overall", 2).alias("overall"), F.round("disagreement", 2).alias("disagreement"), "flagged")


def self_consistency(spark, d):
    samples = read(spark, d, "events").select(F.col("user_id").cast("string").alias("item_id"), (F.floor(F.col("value")) % 11 / 2).alias("score"))
    return judges.self_consistency(samples).select("item_id", "majority_score", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"), F.round("confidence", 4).alias("confidence"))


def flatten_fields(spark, d):
    return flatten(read(spark, d, "events").select("event_id", "props"), ["event_id"], "props")


def handoff_diff(spark, d):
    return seams.handoffs(inputs.chains(spark, d)).select("chain_id", "seam", "kept", "recovered", "dropped", "mutated", "type_changed", "added", F.round("fidelity", 5).alias("fidelity"))


def chain_fidelity(spark, d):
    return seams.chain_audit(seams.handoffs(inputs.chains(spark, d))).select("chain_id", "n_seams", F.round("chain_fidelity", 4).alias("chain_fidelity"), "fidelity_halflife")


def blame(spark, d):
    return seams.blame(seams.handoffs(inputs.chains(spark, d))).select("chain_id", "rank", "seam", "downstream_steps", F.round("severity", 4).alias("severity"))


def hash_embed_similarity(spark, d):
    q = inputs.qa(spark, d)
    return q.select("item_id", hash_similarity("prompt", "response").alias("similarity"))


SUITE_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}


def suite_checks(spark, d):
    return suite.run_checks(inputs.suite_outputs(spark, d), SUITE_SCHEMA, budget_ms=90.0, min_similarity=0.9)


#: Another schema for some of the names.
STRICT_SCHEMA = {"type": "object", "required": ["k", "z"], "maxLength": 9, "properties": {"k": {"enum": [1, "1"]}}}


def suite_by_name(spark, d):
    """Outputs under the schema, budget and least similarity of their own name."""
    outputs, n = inputs.suite_outputs(spark, d), F.col("name").cast("long")
    schema = F.when(n % 3 == 0, json.dumps(SUITE_SCHEMA)).when(n % 3 == 1, json.dumps(STRICT_SCHEMA))
    specs = outputs.filter(n % 11 != 0).select("name", schema.alias("schema"), "reference", F.when(n % 2 == 0, 90.0).alias("budget_ms"), F.when(n % 4 == 0, 0.9).alias("min_similarity"))
    return suite.run_checks_by_name(outputs, specs)


def suite_verdict(spark, d):
    return suite.verdicts(suite_checks(spark, d))


def _grid(spark, d):
    topics = read(spark, d, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("topic"), F.lit("general").alias("capability"))
    return datasets.grid(topics, ["novice", "expert user"], items_per_cell=2)


def grid_cells(spark, d):
    return _grid(spark, d).select("item_id", "topic", "persona", "difficulty", "edge_case", "cell", "k")


def coverage(spark, d):
    return datasets.coverage(_grid(spark, d))


def generate_items(spark, d):
    topics = read(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("topic"), F.col("p_brand").alias("capability"), F.split("p_name", " ").alias("keywords"), F.col("p_name").alias("blurb"))
    return generator.generate(topics, ["novice", "expert user"]).select("item_id", "prompt", "reference", "capability", F.col("meta")["cell"].alias("cell"))


def prompt_payload(spark, d):
    """Pairwise prompts of answers, read back."""
    qa = inputs.qa(spark, d)
    said = prompts.parse_payload(prompts.pairwise_prompt(F.col("item_id"), F.col("prompt"), F.col("response"), F.col("prompt"), "ba"))
    got = qa.select("item_id", said.alias("p"))
    field = lambda k: F.try_variant_get(F.col("p.payload"), f"$.{k}", "string")
    return got.select("item_id", F.col("p.kind").alias("kind"), field("order").alias("order"), F.md5(field("response_first")).alias("first"), F.md5(field("response_second")).alias("second"), F.col("p.error").alias("error"))


def validate_items(spark, d):
    items = read(spark, d, "conversations").select(F.when(F.col("turn") == 0, "").otherwise(F.col("conv_id").cast("string")).alias("item_id"), F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("prompt"), F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("text")).alias("reference"), F.lit("typical").alias("edge_case"))
    return datasets.validate(items).groupBy("problem").agg(F.count("*").alias("n"))


def manifest_sha(spark, d):
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), F.md5("text").alias("t"))
    return datasets.dataset_digest(items, "item_id", ["item_id", "t"])


def label_lines(spark, d):
    """Labels written as JSON lines and loaded again, with how many lines there are and how many numbers within files."""
    folder = step_path(spark)
    rows = inputs.judged_labels(spark, d).select("item_id", F.lit("a prompt").alias("prompt"), "judge_score", "human_score")
    jsonl.to_jsonl(rows.repartition(3), folder)
    return jsonl.load_labels(spark, folder).select("item_id", "judge_score", "human_score")


def snapshot_runs(spark, d):
    """Two runs of a version appended to a store; the rows of its latest."""
    store = SnapshotStore(spark, step_path(spark))
    both = written(inputs.snapshots(spark, d, {"first": 0.75, "second": 0.7}))
    for run in ("first", "second"):
        store.append(both.filter(F.col("model_version") == run).withColumn("model_version", F.lit("v")))
    return store.latest("v").select("item_id", "run_seq", "score")


def dataset_version(spark, d):
    """Benchmark items saved as a version and loaded again."""
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), F.lit("ask").alias("prompt"), F.col("text").alias("reference"), F.lit("c").alias("capability"), F.lit("t").alias("topic"), F.lit("p").alias("persona"), F.lit("easy").alias("difficulty"), F.lit("typical").alias("edge_case"), F.create_map(F.lit("n"), F.length("text").cast("string")).alias("meta"))
    folder = step_path(spark)
    versions.save(items, folder, "v1")
    loaded, manifest = versions.load(spark, folder, "v1")
    return loaded.select("item_id", F.md5("reference").alias("digest"), F.col("meta")["n"].alias("n"), F.lit(manifest["n_items"]).cast("long").alias("n_items"))


def no_regression(spark, d):
    """Baseline outputs against outputs of which some are missing, changed or only spelt otherwise."""
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), "event_id", "props")
    said = F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit(" "))).when(F.col("event_id") % 4 == 1, F.lit('{"k": -1}')).when(F.col("event_id") % 4 == 2, F.lit("words")).otherwise(F.col("props"))
    return suite.no_regression(e.select("name", F.when(F.col("event_id") % 8 == 2, F.lit("words")).otherwise(F.col("props")).alias("value")), e.filter("event_id % 13 <> 0").select("name", said.alias("value")))


def label_priority(spark, d):
    """Priorities of all labels, with the judges' disagreement where there is one."""
    labels = inputs.judged_labels(spark, d).withColumn("human_score", F.when(F.col("doc_id") % 3 != 0, F.col("human_score")))
    apart = labels.filter("doc_id % 2 = 0").select("item_id", (F.col("doc_id") % 7).cast("double").alias("disagreement"))
    return calibration.priority(labels, apart).select("item_id", F.round("priority", 6).alias("priority"))


def mock_answers(spark, d):
    """Answers by id, then by prompt, then the default; an empty answer is none."""
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("prompt"), "text")
    n = F.col("item_id").cast("long")
    by_id = items.filter(n % 3 == 0).select("item_id", F.when(n % 2 == 0, F.md5("text")).otherwise("").alias("a"))
    by_prompt = items.filter(n % 5 < 2).select("prompt", F.upper(F.md5("text")).alias("a"))
    return regression.mock_adapter(by_id.union(by_prompt), "none")(items).select("item_id", "response")


def calibration_report(spark, d):
    labels = inputs.judged_labels(spark, d).join(read(spark, d, "documents").select("doc_id", F.col("text").alias("response_a")), "doc_id").withColumn("prompt", F.lit("a prompt"))
    families = {c: F.concat(F.lit("f"), (F.col("doc_id") % n).cast("string")) for c, n in (("judge_family", 3), ("a_family", 2), ("b_family", 5))}
    labels = labels.withColumns(families | {"preferred": F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, "b").otherwise("tie")})
    r = calibration.calibration_report(labels, "doc_id", pairwise_debias(spark, d))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("spearman", "mae", "within_1", "kappa", "position_bias_rate", "verbosity_p", "self_preference_rate")], "n_blocks", "verbosity_significant", F.size("advice").alias("n_advice"))


def step_fidelity(spark, d):
    steps = inputs.chains(spark, d)
    return seams.step_fidelity(steps, seams.handoffs(steps)).select("chain_id", "step_no", "name", F.round("fidelity", 5).alias("fidelity"))


def rubric_scores(spark, d):
    """A model's verdicts as JSON, some of them short of a score or out of range."""
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("item_id"), F.col("event_id").alias("n"), "value")
    one = lambda name, score: F.struct(F.lit(name).alias("name"), score.alias("score"))
    scores = F.array(one("relevance", F.col("value") / 15 - 1), one("completeness", (F.col("n") % 6).cast("double")), one("clarity", F.lit(4.0)), F.when(F.col("n") % 9 != 0, one("format", F.lit(2.5))))
    payload = F.when(F.col("n") % 17 != 0, F.to_json(F.struct(F.array_compact(scores).alias("scores")))).otherwise("no json")
    return judges.rubric_payload(e.select("item_id", payload.alias("p")), "p").select("item_id", "error", F.round("overall", 4).alias("overall"))


def checks_summary(spark, d):
    """Of each check: how many outputs failed it, may be looked into further, and passed."""
    c = suite_checks(spark, d)
    return c.groupBy("check").agg(F.count_if(~F.col("passed")).alias("n_failed"), F.count_if("escalate").alias("n_escalated"), F.count_if("passed").alias("n_passed"))


QUERIES = {f.__name__: f for f in (tokens_per_doc, normalize_text, keyword_coverage_qa, token_f1, decontaminate_flag, decontaminate_drop, hit_sample, format_score, heuristic_judge, reference_judge, degrade_replay, golden_run, capability_means, snapshot_latest, paired_deltas, missing_items, paired_effect, cliffs_delta, wilcoxon_stat, wilcoxon_exact, wilcoxon_p_normal, bootstrap_ci, drift_slices, gate_decision, drift_summary, metrics_summary, kappa, qwk, spearman, midranks, agreement_summary, pav_fit, pav_predict, verbosity_ols, verbosity_permutation, self_preference, bias_summary, active_queue, pairwise_debias, position_bias_rate, ensemble, self_consistency, flatten_fields, handoff_diff, chain_fidelity, blame, hash_embed_similarity, suite_checks, suite_by_name, suite_verdict, grid_cells, coverage, generate_items, prompt_payload, validate_items, manifest_sha, label_lines, snapshot_runs, dataset_version, no_regression, label_priority, mock_answers, calibration_report, step_fidelity, rubric_scores, checks_summary)}
