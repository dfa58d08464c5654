"""DuckDB SQL that computes the same results from the same tables.

Written from the operators' definitions, not from the Spark plans.
"""

from __future__ import annotations

import re

from judgelab.functions.text import STOP_WORDS
from judgelab.operators import generator


def _tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_'']+')"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _content(x: str) -> str:
    return f"list_filter({_tok(x)}, lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t))"


def _grams(words: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({words}) - {n - 1}, 0) + 1), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


def _digest(rows: str, levels: int = 6) -> str:
    """CTEs ending in ``dg`` (n_items, sha256): leaves by the first hex digits, then parents a digit shorter; ``rows`` has h."""
    parts = [f"dr AS (SELECT h, count(*) AS n FROM ({rows}) GROUP BY 1)", "dk AS (SELECT greatest(0, ceil(log(greatest(count(*), 1) / 64.0::DOUBLE) / log(16.0::DOUBLE)))::INT AS digits, sum(n)::BIGINT AS total FROM dr)"]
    parts.append("d0 AS (SELECT left(h, digits) AS p, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS h FROM dr, dk GROUP BY 1)")
    for k in range(levels):
        parts.append(f"d{k + 1} AS (SELECT left(p, greatest(length(p) - 1, 0)) AS p, CASE WHEN max(length(p)) = 0 THEN max(h) ELSE sha256(string_agg(h, chr(10) ORDER BY p)) END AS h FROM (SELECT p, h FROM d{k}) GROUP BY left(p, greatest(length(p) - 1, 0)))")
    return ", ".join([*parts, f"dg AS (SELECT total AS n_items, h AS sha256 FROM dk, d{levels})"])


_QA = """qa AS (SELECT conv_id || '-' || turn AS item_id, prompt, text AS response FROM (
  SELECT *, lag(text) OVER w AS prompt, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant' AND before = 'user')"""

_LABELS = f"""lj AS (SELECT l.doc_id::VARCHAR AS item_id, l.doc_id, len({_tok('d.text')}) AS n_tokens,
  least(5.0::DOUBLE, floor(sqrt(len({_tok('d.text')})::DOUBLE) / 2) / 2) AS judge_score, 5.0::DOUBLE * quality AS human_score
  FROM labels l JOIN documents d USING (doc_id))"""


def _degraded(text: str, q: float) -> str:
    kept = f"list_filter(string_split({text}, ' '), lambda w, i: ('0x' || substr(sha256(substr({text}, 1, 32) || '|' || (i - 1)::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE < {q})"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE string_split({text}, ' ')[1] END"


def _f1(name: str, source: str, left: str, right: str) -> str:
    """CTEs ending in ``name`` (item_id, f1)."""
    return f"""{name}_a AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest({_tok(left)}) AS t FROM {source}) GROUP BY ALL),
{name}_b AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest({_tok(right)}) AS t FROM {source}) GROUP BY ALL),
{name}_o AS (SELECT item_id, sum(least(a.n, b.n)) AS o FROM {name}_a a JOIN {name}_b b USING (item_id, t) GROUP BY 1),
{name}_s AS (SELECT item_id, sum(n) AS n FROM (SELECT item_id, n FROM {name}_a UNION ALL SELECT item_id, n FROM {name}_b) GROUP BY 1),
{name} AS (SELECT s.item_id, coalesce(2.0::DOUBLE * o / n, 0) AS f1 FROM {source} s LEFT JOIN {name}_o USING (item_id) LEFT JOIN {name}_s USING (item_id))"""


def _snap(name: str, q: float) -> str:
    """CTEs ending in ``name`` (item_id, capability, score)."""
    return f"""{name}_d AS (SELECT doc_id::VARCHAR AS item_id, lang AS capability, text AS reference, {_degraded('text', q)} AS response FROM documents),
{_f1(name + '_f', name + '_d', 'response', 'reference')},
{name} AS (SELECT d.item_id, d.capability, round(5 * f1, 4) AS score FROM {name}_d d JOIN {name}_f USING (item_id))"""


_DELTAS = f"""{_snap('s1', 0.75)}, {_snap('s2', 0.7)},
deltas AS (SELECT item_id, s1.capability, s1.score - s2.score AS delta FROM s1 JOIN s2 USING (item_id))"""

_HITS = f"""mine AS (SELECT DISTINCT item_id, unnest({_grams(_tok('text'), 8)}) AS gram FROM benchmark),
theirs AS (SELECT DISTINCT unnest({_grams('w', 8)}) AS gram FROM (SELECT {_tok('line')} AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))),
hits AS (SELECT item_id, gram FROM mine SEMI JOIN theirs USING (gram))"""

_HEURISTIC = f"""judged AS (SELECT item_id,
  CASE WHEN response IS NULL OR trim(response) = '' THEN 0.0::DOUBLE WHEN len(r) < 3 THEN 1.0::DOUBLE ELSE round(CASE WHEN len(k) = 0 THEN 0 ELSE 5.0::DOUBLE * len(list_filter(k, lambda x: list_contains(r, x))) / len(k) END, 2) END AS relevance,
  CASE WHEN trim(response) = '' THEN 0.0::DOUBLE WHEN len(r) < 3 THEN 1.0::DOUBLE ELSE round(5.0::DOUBLE * least(1.0::DOUBLE, len(r)::DOUBLE / greatest(len(p), 1)), 2) END AS completeness,
  CASE WHEN trim(response) = '' THEN 0.0::DOUBLE ELSE 3.0::DOUBLE + (contains(response, chr(10) || '-') OR contains(response, chr(10) || '*') OR contains(response, chr(10) || '1.') OR contains(response, chr(10) || '#') OR contains(response, chr(10) || chr(10)))::INT
    - (len(r)::DOUBLE / greatest(ends, 1) > 40 OR len(r)::DOUBLE / greatest(ends, 1) < 3)::INT END AS clarity,
  CASE WHEN trim(response) = '' THEN 0.0::DOUBLE WHEN contains(lower(prompt), 'json') THEN CASE WHEN trim(response)[1] IN ('{{', '[') THEN CASE WHEN json_valid(trim(response)) THEN 5.0 ELSE 3.0 END ELSE 1.0 END
    WHEN regexp_matches(lower(prompt), 'bullet|list|numbered|steps') THEN CASE WHEN regexp_matches(response, '(?m)^\\s*([-*•]|\\d+[.)])\\s') THEN 5.0 ELSE 1.0 END ELSE 3.0 END::DOUBLE AS format
  FROM (SELECT *, {_tok('response')} AS r, {_tok('prompt')} AS p, {_content('prompt')} AS k, length(response) - length(translate(response, '.!?' || chr(10), '')) AS ends FROM qa)),
heuristic AS (SELECT item_id, relevance, clarity, round(relevance * 0.25 + completeness * 0.25 + clarity * 0.25 + format * 0.25, 4) AS overall FROM judged)"""

_RANKS = """ranked AS (SELECT *, avg(rn) OVER (PARTITION BY judge_score) AS rj, avg(rm) OVER (PARTITION BY human_score) AS rh FROM (
  SELECT *, row_number() OVER (ORDER BY judge_score) AS rn, row_number() OVER (ORDER BY human_score) AS rm FROM lj))"""



def _permutation(source: str, x: str, y: str) -> str:
    """CTEs ending in ``pt`` (n, p): 999 pairings of two random orders, lag by lag."""
    place = lambda side: f"row_number() OVER (PARTITION BY o ORDER BY ('0x' || substr(md5('0|{side}|' || o || '|' || item_id), 1, 8))::UBIGINT, item_id) - 1 AS k{side}"
    return f"""pm AS (SELECT count(*) AS n, least(125, count(*)) AS lags, avg({x}::DOUBLE) AS mx, avg({y}::DOUBLE) AS my FROM {source}),
pc AS (SELECT item_id, {x} - mx AS x, {y} - my AS y, n, lags FROM {source}, pm),
pe AS (SELECT *, {place('x')}, {place('y')} FROM (SELECT *, unnest(range((999 + lags - 1) // lags)) AS o FROM pc)),
pl AS (SELECT a.o, a.lag, sum(a.x * b.y) / (SELECT sum(x * x) FROM pc) AS s FROM (SELECT *, unnest(range(lags)) AS lag FROM pe) a JOIN pe b ON b.o = a.o AND b.ky = (a.kx + a.lag) % a.n WHERE a.o * a.lags + a.lag < 999 GROUP BY ALL),
po AS (SELECT count(*) AS n, sum(x * y) / sum(x * x) AS s FROM pc),
pt AS (SELECT po.n, (count(*) FILTER (abs(pl.s) >= abs(po.s) - 1e-12 * greatest(1, abs(po.s))) + 1) / 1000.0::DOUBLE AS p FROM pl, po GROUP BY po.n)"""


_SPEARMAN = "CASE WHEN count(*) < 2 OR var_pop(rj) = 0 OR var_pop(rh) = 0 THEN 0 ELSE corr(rj, rh) END"

_KAPPA = """po AS (SELECT avg((j = h)::INT::DOUBLE) AS po, count(*)::DOUBLE AS n FROM lv),
pe AS (SELECT sum(a.n * b.n)::DOUBLE AS s FROM (SELECT j AS v, count(*) AS n FROM lv GROUP BY 1) a JOIN (SELECT h AS v, count(*) AS n FROM lv GROUP BY 1) b USING (v)),
kp AS (SELECT CASE WHEN coalesce(s, 0) / n / n = 1 THEN (po = 1)::INT::DOUBLE ELSE (po - coalesce(s, 0) / n / n) / (1 - coalesce(s, 0) / n / n) END AS kappa FROM po, pe)"""

_LEVELS = "lv AS (SELECT round_even(judge_score, 0)::INT AS j, round_even(human_score, 0)::INT AS h FROM lj)"


def _fmix(name: str, x: str) -> str:
    """Columns ending in ``name``: 32-bit finaliser of x."""
    return f"({x})::UBIGINT AS {name}0, (xor({name}0, {name}0 >> 16) * 2246822507) & 4294967295 AS {name}1, (xor({name}1, {name}1 >> 13) * 3266489909) & 4294967295 AS {name}2, xor({name}2, {name}2 >> 16) AS {name}"


def _bootstrap(source: str, n: int, seed: int) -> str:
    """CTEs ending in ``ci`` (g, n, mean, ci_low, ci_high) from ``source`` (g, d)."""
    half = lambda at: f"('0x' || substr(md5('{seed}|' || g || '|' || d::BIT::BIGINT), {at}, 8))::UBIGINT"
    step = "r::UBIGINT * 2654435769"
    return f"""bc AS (SELECT g, d, count(*)::DOUBLE AS c FROM (SELECT g, d::DOUBLE + 0.0::DOUBLE AS d FROM {source}) GROUP BY ALL),
bh AS (SELECT *, {half(1)} AS h, {half(9)} AS l FROM bc),
bu AS (SELECT g, d, c, r, {_fmix("p", f"({step} + h) & 4294967295")}, {_fmix("q", "xor(p, l)")}, {_fmix("v", f"({step} + l) & 4294967295")}, {_fmix("w", "xor(v, h)")}, (q::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u1, (w::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u2 FROM bh, range({n}) t(r)),
ck AS (SELECT c, k, exp(k * ln(c) - c - lgamma(k + 1)) AS p FROM (SELECT c, unnest(range((4 * c + 17)::BIGINT)) AS k FROM (SELECT DISTINCT c FROM bc WHERE c <= 32))),
cl AS (SELECT c, list(s ORDER BY k) AS steps FROM (SELECT c, k, sum(p) OVER (PARTITION BY c ORDER BY k) AS s FROM ck) GROUP BY c),
bt AS (SELECT g, r, d, CASE WHEN c <= 32 THEN len(list_filter(steps, lambda x: x <= u1))::DOUBLE ELSE greatest(0.0::DOUBLE, round_even(power(sqrt(c - 0.25::DOUBLE) + sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) / 2, 2), 0)) END AS times FROM bu LEFT JOIN cl USING (c)),
bm AS (SELECT g, r, sum(times * d) / sum(times) AS m FROM bt GROUP BY ALL HAVING sum(times) > 0),
bq AS (SELECT g, quantile_cont(m, (1 - 0.95::DOUBLE) / 2) AS ci_low, quantile_cont(m, 1 - (1 - 0.95::DOUBLE) / 2) AS ci_high FROM bm GROUP BY 1),
bn AS (SELECT g, count(*) AS n, avg(d) AS mean, avg(sign(d)::DOUBLE) AS effect FROM {source} GROUP BY 1),
ci AS (SELECT * FROM bn LEFT JOIN bq USING (g))"""


def _verdict(lo: str, hi: str) -> str:
    return f"CASE WHEN {lo} > 0.05 AND abs(effect) >= 0.1 THEN 'regressed' WHEN {hi} < -0.05 AND abs(effect) >= 0.1 THEN 'improved' ELSE 'no_change' END"


_PAIRS = "pairs AS (SELECT a.doc_id::VARCHAR AS item_id, a.text AS response_a, b.text AS response_b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)"

_CHAINS = """ev AS (SELECT user_id AS chain_id, event_id AS id, event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS k, row_number() OVER w AS idx,
  lag(event_type) OVER w AS kind0, lag(json_extract_string(props, '$.k')::BIGINT) OVER w AS k0, lag(event_id) OVER w AS id0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sm AS (SELECT chain_id, idx - 1 AS seam, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 1 ELSE 2 END AS mode, kind0, k0, id0 FROM ev WHERE idx > 1),
ho AS (SELECT chain_id, seam,
  CASE mode WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 1 END AS kept,
  CASE mode WHEN 1 THEN 1 WHEN 2 THEN (id0 IN (k0 + 1, 1))::INT ELSE 0 END AS recovered,
  CASE mode WHEN 2 THEN 1 - (id0 IN (k0 + 1, 1))::INT ELSE 0 END AS dropped,
  (mode = 2)::INT AS mutated, (mode = 1)::INT AS type_changed, (mode > 0)::INT AS added FROM sm),
hf AS (SELECT *, round((kept + recovered)::DOUBLE / (kept + recovered + dropped + mutated + type_changed), 6) AS fidelity FROM ho)"""


def _embed(name: str, source: str, column: str) -> str:
    words = _tok(column)
    return f"""{name}_f AS (SELECT item_id, unnest(list_concat({words}, {_grams(words, 2)})) AS f FROM {source}),
{name}_c AS (SELECT item_id, ('0x' || right(sha1(f), 7))::UBIGINT % 256 AS bucket, count(*)::DOUBLE AS n FROM {name}_f GROUP BY ALL),
{name} AS (SELECT item_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS weight FROM {name}_c)"""


_OUTPUTS = """outs AS (SELECT event_id::VARCHAR AS item_id, event_id, CASE event_id % 10 WHEN 0 THEN substr(props, 1, 4) WHEN 1 THEN '  ' ELSE props END AS value,
  CASE WHEN event_id % 7 <> 0 THEN value END AS latency, CASE WHEN event_id % 5 = 0 THEN '{"k": ' || (event_id % 100) || '}' END AS reference FROM events)"""

_SUITE = f"""{_OUTPUTS}, refs AS (SELECT * FROM outs WHERE reference IS NOT NULL), {_embed('ea', 'refs', 'value')}, {_embed('eb', 'refs', 'reference')},
near AS (SELECT item_id, round(sum(a.weight * b.weight), 6) AS similarity FROM ea a JOIN eb b USING (item_id, bucket) GROUP BY 1),
base AS (SELECT o.*, coalesce(similarity, 0) AS similarity, json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value ELSE '0' END) = 'OBJECT' AS ok,
  CASE WHEN json_valid(value) THEN json_extract_string(value, '$.k')::DOUBLE END AS k FROM outs o LEFT JOIN near USING (item_id)),
suite AS (SELECT item_id AS name, unnest([
  {{'check_no': 0, 'check': 'schema_conformity', 'passed': coalesce(ok AND k >= 10 AND k = floor(k), false), 'severity': 'error', 'e': true}},
  {{'check_no': 1, 'check': 'content_bounds', 'passed': trim(value) <> '', 'severity': 'error', 'e': false}},
  {{'check_no': 2, 'check': 'json_valid', 'passed': coalesce(json_valid(value), false), 'severity': 'error', 'e': true}},
  {{'check_no': 3, 'check': 'similarity', 'passed': reference IS NULL OR similarity >= 0.9, 'severity': 'error', 'e': true}},
  {{'check_no': 4, 'check': 'required_fields', 'passed': coalesce(ok AND k IS NOT NULL, false), 'severity': 'error', 'e': false}},
  {{'check_no': 5, 'check': 'latency_budget', 'passed': coalesce(latency <= 90, false), 'severity': 'warning', 'e': false}}], recursive := true) FROM base),
checks AS (SELECT name, check_no::INT AS check_no, "check", passed, severity, e AND NOT passed AS escalate FROM suite)"""

_BY_NAME = _SUITE.replace("suite AS (SELECT item_id", """spec AS (SELECT *, CASE WHEN event_id % 11 <> 0 THEN event_id % 3 ELSE 2 END AS s, CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN 90 END AS budget, CASE WHEN event_id % 4 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS least FROM base),
named AS (SELECT item_id AS name, unnest([
  {'check_no': 0, 'check': 'schema_conformity', 'passed': CASE s WHEN 0 THEN coalesce(ok AND k >= 10 AND k = floor(k), false) ELSE s = 2 END, 'severity': 'error', 'e': true},
  {'check_no': 1, 'check': 'content_bounds', 'passed': trim(value) <> '' AND (s <> 1 OR length(value) <= 9), 'severity': 'error', 'e': false},
  {'check_no': 2, 'check': 'json_valid', 'passed': s = 2 OR coalesce(json_valid(value), false), 'severity': 'error', 'e': true},
  {'check_no': 3, 'check': 'similarity', 'passed': reference IS NULL OR event_id % 11 = 0 OR similarity >= least, 'severity': 'error', 'e': true},
  {'check_no': 4, 'check': 'required_fields', 'passed': CASE s WHEN 0 THEN coalesce(ok AND k IS NOT NULL, false) ELSE s = 2 END, 'severity': 'error', 'e': false},
  {'check_no': 5, 'check': 'latency_budget', 'passed': budget IS NULL OR coalesce(latency <= budget, false), 'severity': 'warning', 'e': false}], recursive := true) FROM spec),
suite AS (SELECT item_id""")

_EDGES = "['empty_input', 'unicode_stress', 'prompt_injection', 'refusal_bait', 'ambiguity', 'format_trap']"
_GRID = f"""cells AS (SELECT n_name AS topic, p.persona, q.difficulty, n_nationkey * 8 + p.i * 4 + q.i AS cell, k FROM nation,
  (VALUES (0, 'novice'), (1, 'expert user')) p(i, persona), (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard'), (3, 'adversarial')) q(i, difficulty), range(2) t(k)),
grid AS (SELECT *, {_EDGES}[(((cell * 2 + k) * 2 + k) % 6 + 1)::INT] AS edge_case FROM cells)"""

#: Two-sided tail of the standard normal law at z, from a series with positive terms.
_TWO_SIDED = "least(1.0::DOUBLE, CASE WHEN z > 8 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * (SELECT sum(exp(k * ln(2.0) + (2 * k + 1) * ln(greatest(z, 1e-300) / sqrt(2.0)) + k * ln(2.0) + lgamma(k + 1.0) - lgamma(2 * k + 2.0))) FROM range(150) q(k)) END)"

_SIGNED = """u AS (SELECT delta AS d FROM deltas WHERE delta <> 0), rr AS (SELECT d, abs(d) AS m, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM u),
ss AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w FROM rr), tt AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM rr GROUP BY m)),
zz AS (SELECT n, w, abs(w - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ss, tt)"""

_SLICES = "cj AS (SELECT g, n, mean, effect, CASE WHEN n >= 2 THEN ci_low END AS lo, CASE WHEN n >= 2 THEN ci_high END AS hi FROM ci)"

def _generated() -> str:
    """Clauses of the generator's bank, put together by CASE and list positions."""

    def text(x: str) -> str:
        parts = [y if k % 2 else "'" + y.replace("'", "''") + "'" for k, y in enumerate(re.split(r"[{}]", x)) if y]
        return " || ".join(parts) or "''"

    def pick(bank, at: int, part: str) -> str:
        return f"[{', '.join(text(getattr(c, part)) for c in bank)}][(('0x' || substr(h, {at}, 8))::UBIGINT % {len(bank)} + 1)::INT]"

    def case(bank, by: str, part: str) -> str:
        return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN {text(getattr(c, part))}" for k, c in bank.items()) + " END"

    def said(part: str) -> str:
        return f"concat_ws(' ', {pick(generator.TASKS, 1, part)}, {pick(generator.AUDIENCES, 9, part)}, {case(generator.DEPTHS, 'difficulty', part)}, {case(generator.TWISTS, 'edge', part)})"

    return f"""WITH cells AS (SELECT 'part-' || p_partkey AS name, p_brand AS capability, p_name AS topic, replace(p_name, ' ', ', ') AS points, p.persona, p.dashed, q.difficulty, p_partkey * 8 + p.i * 4 + q.i AS n FROM part,
  (VALUES (0, 'novice', 'novice'), (1, 'expert user', 'expert-user')) p(i, persona, dashed), (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard'), (3, 'adversarial')) q(i, difficulty)),
drawn AS (SELECT *, {_EDGES}[(n % 6 + 1)::INT] AS edge, md5('42|' || n || '|0') AS h FROM cells)
SELECT name || '__' || dashed || '__' || difficulty || '__' || edge || '__0' AS item_id, name || '|' || persona || '|' || difficulty AS cell, capability,
  CASE edge WHEN 'empty_input' THEN {text(generator.BLANK.ask)} WHEN 'ambiguity' THEN {text(generator.VAGUE.ask)} ELSE {said('ask')} END AS prompt,
  CASE edge WHEN 'empty_input' THEN {text(generator.BLANK.expect)} WHEN 'ambiguity' THEN {text(generator.VAGUE.expect)} WHEN 'format_trap' THEN '{{"answer":"' || points || ' of ' || topic || '","confidence":0.9}}' ELSE {said('expect')} END AS reference FROM drawn"""


ORACLES: dict[str, str] = {
    "tokens_per_doc": f"SELECT doc_id, len({_tok('text')})::INT AS n_tokens, len({_content('text')})::INT AS n_content, len(list_distinct({_tok('text')}))::INT AS n_distinct FROM documents",
    "normalize_text": r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS digest FROM documents",
    "keyword_coverage_qa": f"WITH {_QA} SELECT item_id, round(CASE WHEN len(k) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(k, lambda x: list_contains(r, x)))::DOUBLE / len(k) END, 6) AS coverage FROM (SELECT item_id, {_content('prompt')} AS k, {_tok('response')} AS r FROM qa)",
    "token_f1": f"WITH {_QA}, {_f1('f', 'qa', 'prompt', 'response')} SELECT item_id, round(f1, 6) AS f1 FROM f",
    "decontaminate_flag": f"WITH {_HITS} SELECT item_id, count(gram) AS n_hits, count(gram) > 0 AS contaminated FROM benchmark LEFT JOIN hits USING (item_id) GROUP BY 1",
    "decontaminate_drop": f"WITH {_HITS} SELECT item_id FROM benchmark ANTI JOIN hits USING (item_id)",
    "hit_sample": f"WITH {_HITS} SELECT item_id, coalesce(array_to_string(list_sort(list(DISTINCT gram) FILTER (gram IS NOT NULL))[1:5], '; '), '') AS sample FROM benchmark LEFT JOIN hits USING (item_id) GROUP BY 1",
    "format_score": f"WITH {_OUTPUTS} SELECT item_id AS name, (CASE event_id % 3 WHEN 0 THEN CASE WHEN trim(value)[1] IN ('{{', '[') THEN CASE WHEN json_valid(value) THEN 5.0 ELSE 3.0 END ELSE 1.0 END WHEN 1 THEN CASE WHEN regexp_matches(value, '(?m)^\\s*([-*•]|\\d+[.)])\\s') THEN 5.0 ELSE 1.0 END ELSE 3.0 END)::DOUBLE AS score FROM outs",
    "heuristic_judge": f"WITH {_QA}, {_HEURISTIC} SELECT item_id, relevance, clarity, round(overall, 3) AS overall FROM heuristic",
    "reference_judge": f"WITH {_QA}, {_f1('f', 'qa', 'response', 'prompt')} SELECT item_id, round(5 * f1, 4) AS overall FROM f",
    "degrade_replay": f"SELECT doc_id, md5({_degraded('text', 0.7)}) AS digest FROM documents",
    "golden_run": f"WITH {_snap('s', 0.7)} SELECT item_id, capability, score FROM s",
    "capability_means": f"WITH {_snap('s', 0.7)} SELECT capability, count(*) AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY 1",
    "snapshot_latest": "SELECT model_version, run_seq, count(*) AS n, round(avg(score), 4) AS mean_score FROM (SELECT event_type AS model_version, user_id % 7 AS run_seq, value AS score, max(user_id % 7) OVER (PARTITION BY event_type) AS last FROM events) WHERE run_seq = last GROUP BY ALL",
    "paired_deltas": f"WITH {_DELTAS} SELECT item_id, capability, round(delta, 5) AS delta FROM deltas",
    "missing_items": "SELECT doc_id::VARCHAR AS item_id, CASE WHEN doc_id % 5 = 0 THEN 'baseline' ELSE 'candidate' END AS missing_from FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0)",
    "paired_effect": f"WITH {_DELTAS} SELECT round(avg(sign(delta)::DOUBLE), 6) AS effect FROM deltas",
    "cliffs_delta": f"WITH {_snap('s1', 0.75)}, {_snap('s2', 0.7)} SELECT round(avg(sign(s1.score - s2.score)::DOUBLE), 6) AS cliffs_delta FROM s1, s2",
    "wilcoxon_stat": f"""WITH {_DELTAS}, u AS (SELECT delta AS d FROM deltas WHERE delta <> 0), r AS (SELECT d, abs(d) AS m, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM u),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY m)),
v AS (SELECT n, w, n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS v FROM s, t)
SELECT n, round(w, 1) AS w_plus, round(v, 2) AS variance, round((w - n::DOUBLE * (n + 1) / 4) / sqrt(v), 4) AS z FROM v""",
    "wilcoxon_exact": f"""WITH u AS (SELECT user_id || '/' || event_type AS sample, value - 50 AS d FROM events WHERE value <> 50),
r AS (SELECT sample, d, row_number() OVER (PARTITION BY sample ORDER BY abs(d)) - 1 AS i, rank() OVER (PARTITION BY sample ORDER BY abs(d)) + (count(*) OVER (PARTITION BY sample, abs(d)) - 1) / 2.0::DOUBLE AS r FROM u),
s AS (SELECT sample, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w FROM r GROUP BY 1),
a AS (SELECT sample, mask, sum(r * ((mask >> i) & 1)) AS w FROM r JOIN s USING (sample), range(65536) t(mask) WHERE n <= 16 AND mask < (1 << n::INT) GROUP BY ALL),
e AS (SELECT sample, least(1.0::DOUBLE, 2 * least(avg((a.w >= s.w)::INT::DOUBLE), avg((a.w <= s.w)::INT::DOUBLE))) AS p FROM a JOIN s USING (sample) GROUP BY sample),
t AS (SELECT sample, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT sample, count(*)::DOUBLE AS c FROM r GROUP BY sample, abs(d)) GROUP BY 1),
z AS (SELECT sample, n, w, abs(w - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s JOIN t USING (sample))
SELECT sample, n, round(w, 1) AS w_plus, round(coalesce(p, {_TWO_SIDED}), 6) AS p_value, CASE WHEN n <= 16 THEN 'exact' ELSE 'normal' END AS method FROM z LEFT JOIN e USING (sample)""",
    "wilcoxon_p_normal": f"WITH {_DELTAS}, {_SIGNED} SELECT n, round(w, 1) AS statistic, round({_TWO_SIDED}, 6) AS p_value, 'normal' AS method FROM zz",
    "bootstrap_ci": f"WITH {_DELTAS}, src AS (SELECT 'all' AS g, delta AS d FROM deltas), {_bootstrap('src', 2000, 12345)} SELECT n, round(mean, 5) AS mean, round(ci_low, 5) AS ci_low, round(ci_high, 5) AS ci_high FROM ci",
    "drift_slices": f"WITH {_DELTAS}, src AS (SELECT capability AS g, delta AS d FROM deltas), {_bootstrap('src', 1000, 12345)}, {_SLICES} SELECT g AS capability, n, round(mean, 5) AS mean_delta, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, round(effect, 5) AS effect_size, {_verdict('lo', 'hi')} AS verdict FROM cj",
    "gate_decision": f"WITH {_DELTAS}, src AS (SELECT 'all' AS g, delta AS d FROM deltas), {_bootstrap('src', 2000, 12345)} SELECT n, round(mean, 5) AS mean_delta, {_verdict('ci_low', 'ci_high')} AS verdict, {_verdict('ci_low', 'ci_high')} <> 'regressed' AS passed FROM ci",
    "drift_summary": f"""WITH {_DELTAS}, {_SIGNED},
total AS (WITH src AS (SELECT 'all' AS g, delta AS d FROM deltas), {_bootstrap('src', 2000, 12345)} SELECT *, {_verdict('ci_low', 'ci_high')} AS verdict FROM ci),
slices AS (WITH src AS (SELECT capability AS g, delta AS d FROM deltas), {_bootstrap('src', 1000, 12345)}, {_SLICES} SELECT g, {_verdict('lo', 'hi')} AS verdict FROM cj),
moved AS (SELECT coalesce(string_agg(g, ', ' ORDER BY g) FILTER (verdict = 'regressed'), '') AS worse, coalesce(string_agg(g, ', ' ORDER BY g) FILTER (verdict = 'improved'), '') AS better FROM slices)
SELECT concat_ws(chr(10), printf('%s over %d shared items (%d on one side only)', t.verdict, t.n, (SELECT count(*) FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0))),
  printf('loss: mean %.4f, 95%% between %.4f and %.4f, tolerated 0.05', t.mean, t.ci_low, t.ci_high), printf('sign balance: %.3f, asked for 0.1', t.effect), (SELECT printf('signed ranks: %.1f (p %.4f)', w, {_TWO_SIDED}) FROM zz),
  CASE WHEN worse <> '' THEN 'worse in: ' || worse END, CASE WHEN better <> '' THEN 'better in: ' || better END) AS summary FROM total t, moved""",
    "metrics_summary": f"""WITH {_snap('s', 0.7)}, m AS (SELECT capability, count(*) AS n, sum(score) AS t, round(avg(score), 4) AS m FROM s GROUP BY 1)
SELECT sum(n)::BIGINT AS n_items, round(sum(t) / sum(n), 4) AS mean_score, '{{' || string_agg('"' || capability || '":' || m::VARCHAR, ',' ORDER BY capability) || '}}' AS capability_means, 64::INT AS digest_length FROM m""",
    "bias_summary": f"""WITH {_LABELS}, {_PAIRS}, x AS (SELECT lj.*, 'f' || doc_id % 3 AS j, 'f' || doc_id % 2 AS a, 'f' || doc_id % 5 AS b, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS pref, CASE WHEN doc_id % 6 <> 0 THEN n_tokens ELSE 2 END AS len FROM lj),
o AS (SELECT pref, CASE WHEN j = a THEN 'a' WHEN j = b THEN 'b' END AS own FROM x WHERE pref IS NOT NULL),
f AS (SELECT count(own) AS n_comparable, count(*) FILTER (own = pref) AS n_flagged, round(coalesce((count(*) FILTER (own = pref))::DOUBLE / nullif(count(own), 0), 0), 6) AS rate FROM o), {_permutation('x', 'len', 'judge_score')}
SELECT 0.0::DOUBLE AS position_bias_rate, v.*, f.*, round(pt.p, 6) AS p_value, pt.p < 0.05 AS significant FROM f, pt, (SELECT round(coalesce(regr_slope(judge_score, len), 0) * 1000, 5) AS slope_per_1000, round(corr(judge_score, len), 5) AS r FROM x) v""",
    "pav_fit": f"""WITH {_LABELS}, o AS (SELECT judge_score AS x, human_score AS y, row_number() OVER (ORDER BY judge_score, doc_id) AS i FROM lj),
c AS (SELECT i, x, y, sum(y) OVER (ORDER BY i) AS s FROM o), l AS (SELECT b.i, max((b.s - a.s + a.y) / (b.i - a.i + 1)) AS v FROM c a JOIN c b ON a.i <= b.i GROUP BY 1),
r AS (SELECT a.i, min((b.s - a.s) / (b.i - a.i)) AS v FROM c a JOIN c b ON b.i > a.i GROUP BY 1),
g AS (SELECT c.*, coalesce(sum((l.v <= r.v)::INT) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM c JOIN l USING (i) LEFT JOIN r USING (i))
SELECT round(min(x), 6) AS x_start, round(max(x), 6) AS x_end, round(sum(y) / count(*), 6) AS value, round(count(*)::DOUBLE, 3) AS weight FROM g GROUP BY g.g""",
    "kappa": f"WITH {_LABELS}, {_LEVELS}, {_KAPPA} SELECT round(kappa, 6) AS kappa FROM kp",
    "qwk": f"""WITH {_LABELS}, {_LEVELS}, lev AS (SELECT v, row_number() OVER (ORDER BY v)::DOUBLE AS i FROM (SELECT j AS v FROM lv UNION SELECT h FROM lv)),
x AS (SELECT a.i, b.i AS j FROM lv JOIN lev a ON a.v = lv.j JOIN lev b ON b.v = lv.h)
SELECT round(CASE WHEN (SELECT count(*) FROM lev) < 2 THEN 1 ELSE 1 - (SELECT avg((i - j) * (i - j)) FROM x) / (SELECT avg((p.i - q.j) * (p.i - q.j)) FROM x p, x q) END, 6) AS qwk""",
    "spearman": f"WITH {_LABELS}, {_RANKS} SELECT round({_SPEARMAN}, 6) AS spearman FROM ranked",
    "midranks": f"WITH {_LABELS}, {_RANKS} SELECT DISTINCT judge_score AS value, rj AS midrank FROM ranked",
    "agreement_summary": f"WITH {_LABELS}, {_RANKS}, {_LEVELS}, {_KAPPA}, s AS (SELECT count(*) AS n, round({_SPEARMAN}, 6) AS spearman, round(avg(abs(judge_score - human_score)), 6) AS mae, round(avg((abs(judge_score - human_score) <= 1)::INT::DOUBLE), 6) AS within_1 FROM ranked) SELECT s.*, round(kappa, 6) AS kappa FROM s, kp",
    "pav_predict": f"""WITH {_LABELS}, o AS (SELECT doc_id, judge_score AS x, human_score AS y, row_number() OVER (ORDER BY judge_score, doc_id) AS i FROM lj),
c AS (SELECT i, sum(y) OVER (ORDER BY i) AS s FROM o), m AS (SELECT a.i, b.i AS j, (b.s - a.s + oa.y) / (b.i - a.i + 1) AS m FROM c a JOIN o oa ON oa.i = a.i JOIN c b ON b.i >= a.i),
l AS (SELECT x, max(i) AS k FROM o GROUP BY 1), f AS (SELECT x, i, min(m) AS v FROM l JOIN m ON m.i <= k AND m.j >= k GROUP BY ALL), g AS (SELECT x, max(v) AS v FROM f GROUP BY 1)
SELECT doc_id, round(v, 6) AS calibrated FROM o JOIN g USING (x)""",
    "verbosity_ols": f"WITH {_LABELS} SELECT count(*) AS n, round(coalesce(regr_slope(judge_score, n_tokens), 0) * 1000, 5) AS slope_per_1000, round(coalesce(regr_intercept(judge_score, n_tokens), avg(judge_score)), 5) AS intercept, round(corr(judge_score, n_tokens), 5) AS r FROM lj",
    "verbosity_permutation": f"""WITH {_LABELS}, e AS (SELECT p, item_id, n_tokens::DOUBLE AS x, human_score AS y, row_number() OVER (PARTITION BY p ORDER BY item_id) AS a,
  row_number() OVER (PARTITION BY p ORDER BY ('0x' || substr(md5('0|' || p || '|' || item_id), 1, 8))::UBIGINT, item_id) AS b FROM lj, range(1, 1000) t(p)),
s AS (SELECT u.p, coalesce(regr_slope(v.y, u.x), 0) AS s FROM e u JOIN e v ON u.p = v.p AND u.a = v.b GROUP BY 1), o AS (SELECT count(*) AS n, coalesce(regr_slope(human_score, n_tokens), 0) AS s FROM lj),
z AS (SELECT o.n, (count(*) FILTER (abs(s.s) >= abs(o.s) - 1e-15) + 1) / 1000.0::DOUBLE AS p FROM s, o GROUP BY o.n)
SELECT n, round(p, 6) AS p_value, p < 0.05 AS significant FROM z""",
    "self_preference": """WITH f AS (SELECT 'f' || doc_id % 3 AS j, 'f' || doc_id % 2 AS a, 'f' || doc_id % 5 AS b, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS pref FROM labels),
o AS (SELECT pref, CASE WHEN j = a THEN 'a' WHEN j = b THEN 'b' END AS own FROM f WHERE pref IS NOT NULL)
SELECT count(own) AS n_comparable, count(*) FILTER (own = pref) AS n_flagged, round(coalesce((count(*) FILTER (own = pref))::DOUBLE / nullif(count(own), 0), 0), 6) AS rate FROM o""",
    "active_queue": f"WITH {_LABELS}, p AS (SELECT item_id, 0.7::DOUBLE * CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE least(1.0::DOUBLE, abs(judge_score - human_score) / 5) END AS priority FROM lj) SELECT item_id, round(priority, 6) AS priority FROM p ORDER BY p.priority DESC, item_id LIMIT 10",
    "pairwise_debias": f"WITH {_PAIRS} SELECT item_id, CASE WHEN length(response_a) > length(response_b) THEN 1.0 WHEN length(response_a) < length(response_b) THEN 0.0 ELSE 0.5 END::DOUBLE AS score_a, CASE WHEN length(response_a) > length(response_b) THEN 'a' WHEN length(response_a) < length(response_b) THEN 'b' ELSE 'tie' END AS winner, false AS position_bias FROM pairs",
    "position_bias_rate": f"WITH {_PAIRS} SELECT round(coalesce(avg((NOT (length(response_a) > 2 * length(response_b) OR length(response_b) > 2 * length(response_a)))::INT::DOUBLE), 0), 6) AS position_bias_rate FROM pairs",
    "ensemble": f"WITH {_QA}, {_HEURISTIC}, {_f1('f', 'qa', 'response', 'prompt')}, b AS (SELECT item_id, overall AS x, round(5 * f1, 4) AS y FROM heuristic JOIN f USING (item_id)) SELECT item_id, round(round((3 * x + y) / 4, 4), 2) AS overall, round(round(abs(x - y), 4), 2) AS disagreement, abs(x - y) > 1.5 AS flagged FROM b",
    "self_consistency": """WITH s AS (SELECT user_id::VARCHAR AS item_id, (floor(value)::BIGINT % 11) / 2.0::DOUBLE AS score FROM events), v AS (SELECT item_id, floor(score + 0.5)::INT AS v, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT item_id, v FROM v QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, v) = 1)
SELECT item_id, m.v AS majority_score, round(avg(score), 5) AS mean, round(var_pop(score), 4) AS variance, round(round(1 / (1 + var_pop(score)), 4), 4) AS confidence FROM s JOIN m USING (item_id) GROUP BY item_id, m.v""",
    "flatten_fields": "SELECT event_id, 'k' AS path, 'number' AS type, json_extract_string(props, '$.k') AS value FROM events",
    "handoff_diff": f"WITH {_CHAINS} SELECT chain_id, seam::INT AS seam, kept::BIGINT AS kept, recovered::BIGINT AS recovered, dropped::BIGINT AS dropped, mutated::BIGINT AS mutated, type_changed::BIGINT AS type_changed, added::BIGINT AS added, round(fidelity, 5) AS fidelity FROM hf",
    "chain_fidelity": f"WITH {_CHAINS} SELECT chain_id, count(*) AS n_seams, round(round(CASE WHEN min(fidelity) <= 0 THEN 0 ELSE exp(avg(ln(fidelity))) END, 6), 4) AS chain_fidelity, min(CASE WHEN fidelity < 0.5 THEN seam END)::INT AS fidelity_halflife FROM hf GROUP BY 1",
    "blame": f"WITH {_CHAINS}, b AS (SELECT chain_id, seam, (max(seam) OVER (PARTITION BY chain_id) - seam + 1) AS after, (1 - fidelity) * (max(seam) OVER (PARTITION BY chain_id) - seam + 1) AS s FROM hf), r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY s DESC, seam) AS rk FROM b) SELECT chain_id, rk::INT AS rank, seam::INT AS seam, after::INT AS downstream_steps, round(s, 4) AS severity FROM r",
    "hash_embed_similarity": f"WITH {_QA}, {_embed('ea', 'qa', 'prompt')}, {_embed('eb', 'qa', 'response')}, n AS (SELECT item_id, sum(a.weight * b.weight) AS s FROM ea a JOIN eb b USING (item_id, bucket) GROUP BY 1) SELECT item_id, round(coalesce(s, 0), 6) AS similarity FROM (SELECT item_id FROM ea UNION SELECT item_id FROM eb) LEFT JOIN n USING (item_id)",
    "suite_checks": f"WITH {_SUITE} SELECT * FROM checks",
    "suite_by_name": f'WITH {_BY_NAME} SELECT name, check_no::INT AS check_no, "check", passed, severity, e AND NOT passed AS escalate FROM named',
    "suite_verdict": f"WITH {_SUITE} SELECT name, count(*) FILTER (NOT passed) AS n_failed, CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'PASS' WHEN count(*) FILTER (NOT passed) = count(*) FILTER (escalate) THEN 'ESCALATE' ELSE 'FAIL' END AS verdict FROM checks GROUP BY 1",
    "grid_cells": f"WITH {_GRID} SELECT topic || '__' || replace(persona, ' ', '-') || '__' || difficulty || '__' || edge_case || '__' || k AS item_id, topic, persona, difficulty, edge_case, cell::BIGINT AS cell, k::INT AS k FROM grid",
    "coverage": f"WITH {_GRID} SELECT topic || '|' || persona || '|' || difficulty AS cell, count(*) AS n FROM grid GROUP BY 1",
    "generate_items": _generated(),
    "prompt_payload": f"WITH {_QA} SELECT item_id, 'pairwise' AS kind, 'ba' AS \"order\", md5(prompt) AS first, md5(response) AS second, NULL::VARCHAR AS error FROM qa",
    "validate_items": """WITH i AS (SELECT CASE WHEN turn = 0 THEN '' ELSE conv_id::VARCHAR END AS id, CASE WHEN role = 'system' THEN '' ELSE text END AS p, CASE WHEN role = 'user' THEN '' ELSE text END AS r FROM conversations)
SELECT problem, count(*) AS n FROM (SELECT 'empty item_id' AS problem FROM i WHERE trim(id) = '' UNION ALL SELECT 'duplicate item_id' FROM (SELECT row_number() OVER (PARTITION BY id) AS k FROM i) WHERE k > 1
UNION ALL SELECT 'empty reference' FROM i WHERE trim(r) = '' UNION ALL SELECT 'empty prompt' FROM i WHERE trim(p) = '') GROUP BY 1""",
    "manifest_sha": f"""WITH {_digest("SELECT sha256('{\"item_id\":\"' || item_id || '\",\"t\":\"' || md5(text) || '\"}') AS h FROM benchmark")} SELECT n_items, sha256 FROM dg""",
}

ORACLES |= {
    "label_lines": f"WITH {_LABELS} SELECT item_id, judge_score, human_score FROM lj",
    "snapshot_runs": f"WITH {_snap('s', 0.7)} SELECT item_id, 2::INT AS run_seq, score FROM s",
    "dataset_version": "SELECT item_id::VARCHAR AS item_id, md5(text) AS digest, length(text)::VARCHAR AS n, count(*) OVER () AS n_items FROM benchmark",
    "no_regression": """WITH e AS (SELECT event_id::VARCHAR AS name, event_id AS n, CASE WHEN event_id % 8 = 2 THEN 'words' ELSE props END AS b, CASE event_id % 4 WHEN 0 THEN props || ' ' WHEN 1 THEN '{"k": -1}' WHEN 2 THEN 'words' ELSE props END AS a FROM events)
SELECT * FROM (SELECT name, CASE WHEN n % 13 = 0 THEN 'missing' WHEN b = 'words' THEN NULL WHEN a = 'words' OR json_extract_string(a, '$.k') <> json_extract_string(b, '$.k') THEN 'changed' END AS problem FROM e) WHERE problem IS NOT NULL""",
    "label_priority": f"""WITH {_LABELS} SELECT item_id, round(0.7::DOUBLE * CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE least(1.0::DOUBLE, abs(judge_score - human_score) / 5) END + CASE WHEN doc_id % 2 = 0 THEN 0.3::DOUBLE * least(1.0::DOUBLE, (doc_id % 7)::DOUBLE / 5) ELSE 0 END, 6) AS priority FROM lj""",
    "mock_answers": "SELECT item_id::VARCHAR AS item_id, CASE WHEN item_id % 6 = 0 THEN md5(text) WHEN item_id % 5 < 2 THEN upper(md5(text)) ELSE 'none' END AS response FROM benchmark",
    "calibration_report": f"""SELECT a.n, a.spearman, a.mae, a.within_1, a.kappa, b.position_bias_rate, b.p_value AS verbosity_p, b.rate AS self_preference_rate, p.n_blocks, b.significant AS verbosity_significant,
(b.position_bias_rate > 0.15)::INT + b.significant::INT + (b.rate > 0)::INT + (a.mae > 1)::INT + (a.spearman < 0.7)::INT AS n_advice FROM ({ORACLES['agreement_summary']}) a, ({ORACLES['bias_summary']}) b, (SELECT count(*) AS n_blocks FROM ({ORACLES['pav_fit']})) p""",
    "step_fidelity": f"WITH {_CHAINS} SELECT ev.chain_id, idx::INT AS step_no, kind AS name, round(fidelity, 5) AS fidelity FROM ev LEFT JOIN hf ON hf.chain_id = ev.chain_id AND hf.seam = ev.idx - 1",
    "rubric_scores": """WITH s AS (SELECT event_id::VARCHAR AS item_id, event_id AS n, round(greatest(0, least(5, value / 15 - 1)), 4) AS r, least(5, event_id % 6)::DOUBLE AS c FROM events)
SELECT item_id, CASE WHEN n % 17 = 0 THEN 'no score for relevance, completeness, clarity, format' WHEN n % 9 = 0 THEN 'no score for format' END AS error, CASE WHEN n % 17 <> 0 AND n % 9 <> 0 THEN round(r * 0.25 + c * 0.25 + 1 + 0.625, 4) END AS overall FROM s""",
    "checks_summary": f'WITH {_SUITE} SELECT "check", count(*) FILTER (NOT passed) AS n_failed, count(*) FILTER (escalate) AS n_escalated, count(*) FILTER (passed) AS n_passed FROM checks GROUP BY 1',
}
