"""Row-scoring judges and how their scores combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelab.functions.text import content_tokens, f1_column, f1_each, is_blank, keyword_coverage, tokens
from judgelab.sources.model import Policy, ask

#: A judge takes items (item_id, prompt, response, reference) and adds ``overall``.
Judge = Callable[[DataFrame], DataFrame]


class JudgeParseError(ValueError):
    """A model's verdict doesn't have the agreed form."""


@dataclass(frozen=True)
class Criterion:
    name: str
    description: str = ""
    weight: float = 1.0
    anchors: dict[int, str] = field(default_factory=dict, hash=False)


DEFAULT_RUBRIC = (
    Criterion("relevance", "Answers what was asked for."),
    Criterion("completeness", "Holds the main points of a good answer."),
    Criterion("clarity", "Easy to read and to follow."),
    Criterion("format", "Has the output format that was asked for."),
)


def rubric_from_yaml(text: str) -> tuple[Criterion, ...]:
    """Criteria of a rubric file: a list, or one under ``criteria``; the default rubric where there are none."""
    import yaml  # only rubric files need it

    said = yaml.safe_load(text)
    entries = (said.get("criteria") if isinstance(said, dict) else said) or []
    if any("name" not in e for e in entries):
        raise ValueError("a criterion needs a name")
    return tuple(Criterion(str(e["name"]), str(e.get("description", "")), float(e.get("weight", 1.0)), {int(k): str(v) for k, v in (e.get("anchors") or {}).items()}) for e in entries) or DEFAULT_RUBRIC


def format_score(prompt: Column, response: Column) -> Column:
    """5 where a requested JSON or list format is met, 3 for broken JSON or no request, 1 otherwise."""
    asked = F.lower(prompt)
    body = F.btrim(response, F.lit(" \t\n\x0b\x0c\r"))
    json_like = body.startswith("{") | body.startswith("[")
    json_score = F.when(json_like & F.try_parse_json(body).isNotNull(), 5.0).when(json_like, 3.0).otherwise(1.0)
    listed = response.rlike(r"(?dm)^\s*([-*•]|\d+[.)])\s")
    wants_list = asked.contains("bullet") | asked.contains("list") | asked.contains("numbered") | asked.contains("steps")
    return F.when(asked.contains("json"), json_score).when(wants_list, F.when(listed, 5.0).otherwise(1.0)).otherwise(3.0)


def _clarity(response: Column, words: Column) -> Column:
    ends = F.length(response) - F.length(F.translate(response, ".!?\n", ""))
    mean = F.size(words) / F.greatest(ends, F.lit(1))
    marked = response.contains("\n-") | response.contains("\n*") | response.contains("\n1.") | response.contains("\n#") | response.contains("\n\n")
    return 3.0 + F.when(marked, 1.0).otherwise(0.0) - F.when((mean > 40) | (mean < 3), 1.0).otherwise(0.0)


def criterion_score(c: Criterion, prompt: Column, response: Column, reference: Column) -> Column:
    """Score of one criterion; which signal it is follows from the criterion's name."""
    name, words = c.name.lower(), tokens(response)
    if "format" in name:
        return F.when(is_blank(response), 0.0).otherwise(format_score(prompt, response))
    if "clarit" in name:
        return F.when(is_blank(response), 0.0).otherwise(F.round(_clarity(response, words), 2))
    if "relevan" in name:
        raw = 5 * keyword_coverage(content_tokens(prompt), words)
    elif "complete" in name:
        ratio = F.least(F.lit(1.0), F.size(words) / F.greatest(F.size(tokens(prompt)), F.lit(1)))
        raw = 5 * F.when(F.coalesce(reference, F.lit("")) != "", keyword_coverage(content_tokens(reference), words)).otherwise(ratio)
    else:
        raw = 5 * keyword_coverage(content_tokens(F.lit(c.description)), words)
    return F.when(is_blank(response), 0.0).when(F.size(words) < 3, 1.0).otherwise(F.round(raw, 2))


def evidence(c: Criterion, prompt: Column, response: Column, reference: Column) -> Column:
    name, words = c.name.lower(), tokens(response)
    length = F.format_string("response length %d tokens", F.size(words))
    if "relevan" in name:
        return F.format_string("prompt-keyword coverage %.2f", keyword_coverage(content_tokens(prompt), words))
    if "complete" in name:
        return F.when(F.coalesce(reference, F.lit("")) != "", F.format_string("reference-keyword coverage %.2f", keyword_coverage(content_tokens(reference), words))).otherwise(length)
    return length


def weighted_overall(scores: dict[str, Column], criteria: tuple[Criterion, ...]) -> Column:
    """Weighted mean; the plain mean where weights sum to nothing."""
    total = sum(c.weight for c in criteria)
    weighted = [scores[c.name] * (c.weight / total if total > 0 else 1.0 / len(criteria)) for c in criteria]
    return sum(weighted[1:], weighted[0])


def heuristic_judge(items: DataFrame, criteria: tuple[Criterion, ...] = DEFAULT_RUBRIC) -> DataFrame:
    """``items`` with criterion_scores array<struct<name, score, evidence>> and overall: one projection, no shuffle."""
    prompt, response = F.col("prompt"), F.coalesce("response", F.lit(""))
    reference = F.col("reference") if "reference" in items.columns else F.lit("")
    scored = items.withColumns({f"__{c.name}": criterion_score(c, prompt, response, reference) for c in criteria})
    parts = F.array(*[F.struct(F.lit(c.name).alias("name"), F.col(f"__{c.name}").alias("score"), evidence(c, prompt, response, reference).alias("evidence")) for c in criteria])
    overall = F.round(weighted_overall({c.name: F.col(f"__{c.name}") for c in criteria}, criteria), 4)
    return scored.withColumn("criterion_scores", parts).withColumn("overall", overall).drop(*[f"__{c.name}" for c in criteria])


def reference_judge(items: DataFrame) -> DataFrame:
    """``items`` with overall, five times the F1 of response and reference words: one projection, no shuffle."""
    return items.withColumn("overall", F.round(5 * f1_column("response", "reference"), 4))


def reference_scores(responses: Column, reference: Column) -> Column:
    """The same score for each of several responses to one reference."""
    return f1_score(f1_each(responses, reference))


def f1_score(f1s: Column) -> Column:
    """Scores of 0 to 5 from an array of F1."""
    return F.transform(f1s, lambda f: F.round(5 * f, 4))


def rubric_payload(df: DataFrame, payload: str, criteria: tuple[Criterion, ...] = DEFAULT_RUBRIC) -> DataFrame:
    """Scores of a model's JSON verdicts ``{"scores": [{"name", "score"}]}``: clamped to 0..5; ``error`` where one is missing or no number."""
    # Each is read more than once afterwards, and so a column of its own.
    parsed = F.coalesce(F.from_json(F.col(payload), "scores array<struct<name string, score double>>")["scores"], F.array().cast("array<struct<name:string,score:double>>"))
    rows = df.withColumn("__scores", parsed)
    rows = rows.withColumns({"__found": F.map_from_entries(F.filter("__scores", lambda s: s["name"].isNotNull()))})
    rows = rows.withColumns({f"__{c.name}": F.try_element_at("__found", F.lit(c.name)) for c in criteria})
    score = {c.name: F.when(F.col(f"__{c.name}").isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col(f"__{c.name}"))), 4)) for c in criteria}  # of nulls, the bounds alone would count
    missing = F.array_compact(F.array(*[F.when(F.col(f"__{c.name}").isNull(), F.lit(c.name)) for c in criteria]))  # not named, or without a score
    out = rows.withColumns({"__missing": missing, "overall": F.round(weighted_overall(score, criteria), 4)})
    out = out.withColumn("error", F.when(F.size("__missing") > 0, F.concat(F.lit("no score for "), F.array_join("__missing", ", "))))
    return out.select(*[c for c in df.columns if c not in ("error", "overall")], "error", "overall")


# What a model may call the first text, the second text and a tie.
FIRST, SECOND, TIE = ("a", "response_a", "first"), ("b", "response_b", "second"), ("tie", "equal", "draw", "same")


def longer_wins(first: Column, second: Column) -> Column:
    """The offline model's verdict: the longer text as presented."""
    return F.when(F.length(first) > F.length(second), "first").when(F.length(first) < F.length(second), "second").otherwise("tie")


def presentation_winner(raw: Column) -> Column:
    """first, second or tie from a verdict text; null if it is none of the known ones."""
    said = F.lower(F.trim(raw))
    return F.when(said.isin(*FIRST), "first").when(said.isin(*SECOND), "second").when(said.isin(*TIE), "tie")


def pairwise_judge(pairs: DataFrame, verdict: Callable[[Column, Column], Column] = longer_wins) -> DataFrame:
    """item_id, score_a, winner, position_bias from both presentation orders of (response_a, response_b)."""
    orders = pairs.select("item_id", "response_a", "response_b", F.explode(F.array(F.lit("ab"), F.lit("ba"))).alias("order"))
    ab = F.col("order") == "ab"
    said = verdict(F.when(ab, F.col("response_a")).otherwise(F.col("response_b")), F.when(ab, F.col("response_b")).otherwise(F.col("response_a")))
    for_a = F.when(said == "tie", 0.5).when((said == "first") == ab, 1.0).otherwise(0.0)
    both = orders.select("item_id", for_a.alias("s")).groupBy("item_id").agg(F.avg("s").alias("m"), ((F.min("s") == 0) & (F.max("s") == 1)).alias("position_bias"))
    return both.select("item_id", F.round("m", 4).alias("score_a"), F.when(F.col("m") > 0.5, "a").when(F.col("m") < 0.5, "b").otherwise("tie").alias("winner"), "position_bias")


def position_bias_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.avg(F.col("position_bias").cast("double")), F.lit(0.0)).alias("position_bias_rate"))


def ensemble(scores: DataFrame, weights: dict[str, float], threshold: float = 1.5) -> DataFrame:
    """item_id, overall, disagreement, flagged from long rows (item_id, judge, overall); the spread counts before rounding."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    total = F.sum(F.try_element_at(w, F.col("judge")))
    mean = F.when(total > 0, F.sum(F.try_element_at(w, F.col("judge")) * F.col("overall")) / F.nullif(total, F.lit(0.0))).otherwise(F.avg("overall"))
    spread = F.max("overall") - F.min("overall")
    return scores.groupBy("item_id").agg(F.round(mean, 4).alias("overall"), F.round(spread, 4).alias("disagreement"), (spread > threshold).alias("flagged"))


def self_consistency(samples: DataFrame) -> DataFrame:
    """item_id, majority_score, mean, variance, confidence from rows (item_id, score); a tied vote goes to the lower score."""
    votes = samples.groupBy("item_id", F.floor(F.col("score") + 0.5).cast("int").alias("v")).agg(F.count("*").alias("n"))
    top = votes.groupBy("item_id").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("majority_score"))
    spread = samples.groupBy("item_id").agg(F.avg("score").alias("mean"), F.var_pop("score").alias("variance"))
    return top.join(spread, "item_id").select("item_id", "majority_score", "mean", "variance", F.round(1 / (1 + F.col("variance")), 4).alias("confidence"))


def model_judge(items: DataFrame, complete: Callable[[], Callable[[str], str]], prompt: str, out: str = "payload", store: str | None = None, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Adds a model's completion of ``prompt``; calls that fail for good become null.

    Equal prompts are asked once.  ``complete()`` makes a partition's client;
    retries, concurrency and the store of answers are those of
    :func:`judgelab.sources.model.ask`.
    """
    asked = items.select(F.col(prompt).alias("prompt")).filter("prompt IS NOT NULL").distinct()
    said = ask(asked, complete, store, policy).select(F.col("prompt").alias("__p"), F.col("answer").alias(out))
    return items.drop(out).join(said, F.col(prompt) == F.col("__p"), "left").drop("__p")


def latest_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key in ``order``."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
