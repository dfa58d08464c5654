"""DuckDB SQL for the training-data queries that SQL can express.

The others train models (op2, op5, op8), search (op1, op6), iterate over a
graph (op10) or depend on hash order (op9); tests compare them with brute
force.
"""

from __future__ import annotations

from judgelab.llm.license_rules import SPAN, signatures
from judgelab.llm.license_scan import by_anchor
from judgelab.llm.quality_rules import STOP_WORDS

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

_OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS i, w FROM d),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM win),
rep AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, range(35) t(k)),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, w FROM d),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM root LEFT JOIN n USING (doc_id)"""

_OP7 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS i, w FROM d),
gram AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM win),
rep AS (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) t(k) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, greatest(len(w), 1)::DOUBLE AS wn, greatest(len(l), 1)::DOUBLE AS ln,
  len(list_intersect(w, {_STOPS}))::DOUBLE AS stops, length(regexp_replace(t, '[^!]', '', 'g'))::DOUBLE AS bangs, len(regexp_extract_all(t, '\p{{L}}[^\x20\x09-\x0D]*'))::DOUBLE AS lettered,
  len(list_filter(l, lambda x: regexp_matches(x, '^ *(- |\* |•)')))::DOUBLE AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::DOUBLE AS dots FROM d LEFT JOIN again USING (doc_id)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_filter([
  CASE WHEN word_chars / wn < 1.5 OR word_chars / wn > 20 THEN 'mean_word_chars' END, CASE WHEN n_symbols / wn > 0.10::DOUBLE THEN 'symbol_ratio' END,
  CASE WHEN stops / least(wn, {len(STOP_WORDS)}) < 0.03::DOUBLE AND n_words >= 60 THEN 'stop_word_ratio' END, CASE WHEN n_dup_lines / ln > 0.60::DOUBLE THEN 'dup_line_ratio' END,
  CASE WHEN bullets / ln > 0.90::DOUBLE THEN 'bullet_line_ratio' END, CASE WHEN dots / ln > 0.30::DOUBLE THEN 'ellipsis_line_ratio' END,
  CASE WHEN bangs / wn > 0.30::DOUBLE AND n_words >= 10 THEN 'exclaimed_ratio' END, CASE WHEN lettered / wn < 0.60::DOUBLE THEN 'lettered_ratio' END], lambda x: x IS NOT NULL) AS f FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(f) = 0 AS kept, coalesce(array_to_string(f, ','), '') AS failed_rules FROM r"""



def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda acc, b: {step}))"


_OP11 = rf"""WITH raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, md5(length(r) || ':' || r || t) AS x, len({_WORDS.format("t")}) AS w, turn FROM raw),
own AS (SELECT c, x, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) - 1 AS p FROM turns),
convs AS (SELECT c, {_crc32("c::VARCHAR")} % 4 AS h, c - c % 20 AS base FROM (SELECT DISTINCT c FROM own)),
joint AS (SELECT v.c, 0 AS part, p, x, w FROM convs v JOIN own o ON o.c = v.base AND o.p < v.h UNION ALL SELECT v.c, 1, p, x, w FROM convs v JOIN own o ON o.c = v.c AND o.p >= v.h),
seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, x, w FROM joint),
steps AS (SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS k, w FROM seq UNION ALL SELECT c, 0, '', 0 FROM convs),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM steps),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM ended GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
own_figures AS (SELECT node.*, coalesce(kids.n, 0) AS kids, (node.n - 1) * w AS saved FROM node LEFT JOIN kids USING (k)),
below AS (SELECT left(k, 32 * j) AS k, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT k, saved, kids, unnest(range(d + 1)) AS j FROM own_figures) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM own_figures f JOIN below b USING (k) LEFT JOIN node up ON f.d > 0 AND up.k = left(f.k, 32 * (f.d - 1))"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """Levels {name}n0.. of (g, i, h, m) and {name}s0.. with the siblings before (b) and after (a); m nodes are on a level."""
    parts = [f"{name}n0 AS ({leaves})"]
    for k in range(levels):
        over = "(PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {} AND {})"
        before, after = over.format("UNBOUNDED PRECEDING", "1 PRECEDING"), over.format("1 FOLLOWING", "UNBOUNDED FOLLOWING")
        parts.append(f"{name}s{k} AS (SELECT g, i, m, coalesce(string_agg(h, '') OVER {before}, '') AS b, coalesce(string_agg(h, '') OVER {after}, '') AS a FROM {name}n{k})")
        parts.append(f"{name}n{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(m) + 7) // 8 AS m FROM {name}n{k} GROUP BY g, i // 8)")
    return ",\n".join(parts)


def _paths(name: str, source: str, levels: int) -> str:
    """``source`` with (g, i, fold, proof) carried up, as {name}p{levels}."""
    parts, before = [], source
    for k in range(levels):
        parts.append(f"{name}p{k + 1} AS (SELECT p.* REPLACE (CASE WHEN s.m = 1 THEN fold ELSE sha256(s.b || fold || s.a) END AS fold, proof || s.b || s.a AS proof) FROM {before} p JOIN {name}s{k} s ON s.g = p.g AND s.i = p.i // {8**k})")
        before = f"{name}p{k + 1}"
    return ",\n".join(parts)


def _op12(levels: int = 7, groups: int = 3) -> str:
    """For at most 8**levels rows a language and 8**groups languages."""
    said = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}, '-')"
    head = " || ".join(said(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    return f"""WITH d AS (SELECT doc_id, lang, sha256({head} || {said("text")}) AS leaf, sha256({head} || {said("low")}) AS tampered FROM (SELECT *, {low} AS low FROM documents)),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM d),
{_tree("d", "SELECT g, i, leaf AS h, m FROM numbered", levels)},
{_tree("l", f"SELECT 0 AS g, g AS i, h, count(*) OVER () AS m FROM dn{levels}", groups)},
start AS (SELECT doc_id, leaf, g, i, tampered AS fold, '' AS proof FROM numbered),
{_paths("d", "start", levels)},
lifted AS (SELECT doc_id, leaf, g AS language, 0 AS g, g AS i, fold, proof FROM dp{levels}),
{_paths("l", "lifted", groups)}
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.h AS verified FROM lp{groups} p JOIN dn{levels} sub ON sub.g = p.language JOIN ln{groups} top ON true"""


def _op13() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(a)}, {no}, {quoted(pattern)}, {r.priority}, {quoted(r.label)}, {r.weight!r}::DOUBLE, {r.base})" for a, group in by_anchor(signatures()).items() for no, r, pattern in group)
    return rf"""WITH rules(anchor, no, pattern, priority, label, weight, base) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT row, i, w[i] AS anchor, array_to_string(w[i:i + {SPAN - 1}], ' ') || ' ' AS said FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT anchor FROM rules)),
tried AS (SELECT row, i - 1 AS start, no, priority, label, weight, base, regexp_extract(said, pattern) AS hit FROM places JOIN rules USING (anchor)),
found AS (SELECT *, start + length(hit) - length(replace(hit, ' ', '')) AS stop FROM tried WHERE hit <> ''),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found e WHERE e.row = f.row AND e.start <= f.start AND e.stop >= f.stop AND CASE WHEN e.start = f.start AND e.stop = f.stop THEN e.priority > f.priority OR (e.priority = f.priority AND e.no < f.no) ELSE e.priority >= f.priority END)),
base AS (SELECT row, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found WHERE base GROUP BY row),
every AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM (SELECT row, label, weight FROM kept UNION ALL SELECT row, label, weight FROM found WHERE base) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN every USING (row)"""


ORACLES: dict[str, str] = {"op3_substring_dedup": _OP3, "op4_minhash_near_dedup": _OP4, "op7_quality_rules": _OP7, "op11_prefix_trie": _OP11, "op12_merkle_manifest": _op12(), "op13_license_scan": _op13()}
