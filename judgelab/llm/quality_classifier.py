"""Quality classifier from weak labels (operator 5).

1. Overlapping heuristic labellers vote good, bad or nothing on every text.
2. Documents are counted by vote pattern (at most 3 ** labellers patterns), and
   expectation-maximisation on the counts estimates each labeller's accuracy
   and the posterior of each pattern.
3. A linear scorer on hashed words and hashed figures learns the posteriors
   from all documents: in each round partitions sum the gradient over their
   documents and the driver takes one step of Adam, so the partitioning is of
   no consequence but for rounding.
4. Every text is scored; ``kept`` is score >= 0.5.

Texts are read once: their votes and sparse features are written to a table,
which the rounds and the scoring read.

Defined results: a null or empty text has no words, is voted bad and scored
like any other; repeated rows count as often as they occur; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.llm.common import Words, list_rows, materialise, mix, table, text_chunks, words_of
from judgelab.llm.quality_rules import STOP_WORDS

DIMENSIONS = 1 << 14
ROUNDS, RATE = 24, 0.3
#: Documents that the labellers' prior accuracies weigh as much as, at any size of the input.
PRIOR = 200.0
FIGURES = ("words", "word_bytes", "symbols", "exclaimed", "capitals", "distinct", "adjacent", "stops", "letters", "line_words", "commonest")
#: Labellers: figure, bad below, bad above, good from, good to (a vote only where the text is long enough).
LABELLERS = (
    ("words", 1, None, 12, None, 0),
    ("word_bytes", 2.0, 18.0, 3.0, 9.0, 1),
    ("symbols", None, 0.2, None, 0.01, 1),
    ("exclaimed", None, 0.3, None, 0.05, 1),
    ("capitals", None, 0.4, 0.005, 0.2, 10),
    ("distinct", 0.15, None, 0.3, None, 30),
    ("adjacent", None, 0.3, None, 0.05, 10),
    ("stops", 0.01, None, 0.08, None, 40),
    ("letters", 0.6, None, 0.8, None, 1),
    ("commonest", None, 0.15, None, 0.1, 30),
)

_kinds = {k: np.zeros(256, dtype=bool) for k in ("symbol", "bang", "upper", "letter", "line")}
_kinds["symbol"][[ord(c) for c in "#*$%&|<>"]] = True
_kinds["bang"][33] = _kinds["line"][10] = True
_kinds["upper"][65:91] = True
_kinds["letter"][65:91] = _kinds["letter"][97:123] = _kinds["letter"][128:] = True
_raw = np.frombuffer(" ".join(STOP_WORDS).encode(), dtype=np.uint8)
_STOPS = np.sort(words_of(_raw, np.array([0, len(_raw)]), lower=True).hash)


def figures(buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    w = words_of(buf, offsets, lower=True)

    def bytes_of(kind: str) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(_kinds[kind][buf])))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    def words(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(np.float64)

    count = w.counts().astype(np.float64)
    n = np.maximum(count, 1)
    word_bytes = words(w.end - w.start)
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.first[:-1][w.first[:-1] < len(same)]] = False
    at = np.minimum(np.searchsorted(_STOPS, w.hash), len(_STOPS) - 1)
    kinds = [np.unique(w.hash[a:b], return_counts=True)[1] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    distinct = np.array([len(k) for k in kinds], dtype=np.float64)
    commonest = np.array([k.max(initial=0) for k in kinds], dtype=np.float64)
    rows = [count, word_bytes / n, bytes_of("symbol") / n, bytes_of("bang") / n, bytes_of("upper") / np.maximum(bytes_of("letter"), 1), distinct / np.minimum(n, 200), words(same) / n, words(_STOPS[at] == w.hash) / n, bytes_of("letter") / np.maximum(word_bytes, 1), n / (bytes_of("line") + 1), commonest / n]
    return w, np.stack(rows, axis=1) if len(n) else np.empty((0, len(FIGURES)))


def votes(x: np.ndarray) -> np.ndarray:
    """0 nothing, 1 bad, 2 good, for every text and labeller."""
    out = np.zeros((len(x), len(LABELLERS)), dtype=np.int64)
    for k, (name, low, high, good_low, good_high, least) in enumerate(LABELLERS):
        v = x[:, FIGURES.index(name)]
        bad = (v < low if low is not None else False) | (v > high if high is not None else False)
        good = (v >= good_low if good_low is not None else True) & (v <= good_high if good_high is not None else True)
        out[:, k] = np.where(x[:, 0] < least, 0, np.where(bad, 1, np.where(good, 2, 0)))
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1], dtype=np.int64)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and P(vote | class) as (labeller, class, vote)."""
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    weight = counts.astype(np.float64)
    bad, good = (v == 1).sum(axis=1), (v == 2).sum(axis=1)
    p = (good + 1) / (good + 3 * bad + 2)  # start: one bad vote weighs more than a good one
    chance = np.empty((len(LABELLERS), 2, 3))
    # A labeller is better than chance: bad votes on good texts are thought to be rare.
    trust = PRIOR * np.array([[0.0, 0.5, 0.5], [0.0, 0.005, 0.995]])
    for _ in range(rounds):
        both = np.stack([(1 - p) * weight, p * weight])
        prior = (both.sum(axis=1) + 1) / (weight.sum() + 2)
        for k in range(len(LABELLERS)):
            for c in (0, 1):
                seen = np.bincount(v[:, k], both[c], 3) + 0.5 + trust[c]
                chance[k, c] = np.append(1.0, seen[1:] / seen[1:].sum())  # no vote tells nothing
        logs = np.log(prior)[:, None] + sum(np.log(chance[k][:, v[:, k]]) for k in range(len(LABELLERS)))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return p, chance


def hashed(w: Words, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a run of documents (how many each, numbers, values): words with damped counts, and binned figures."""
    docs, plain = len(x), np.uint64(DIMENSIONS - 1024)
    kinds, n = np.unique(w.doc() * DIMENSIONS + (w.hash % plain).astype(np.int64), return_counts=True)
    doc, value = kinds // DIMENSIONS, np.log1p(n)
    value *= 0.5 / np.maximum(np.sqrt(np.bincount(doc, value**2, docs)), 1e-9)[doc]
    bins = np.minimum(np.floor(np.log2(1 + 64 * x)), 15).astype(np.uint64)
    figure = (mix(np.arange(len(FIGURES), dtype=np.uint64) * np.uint64(16) + bins) % np.uint64(1024) + plain).astype(np.int64)
    owner = np.concatenate((doc, np.repeat(np.arange(docs), len(FIGURES))))
    order = np.argsort(owner, kind="stable")
    return np.bincount(owner, minlength=docs), np.concatenate((kinds % DIMENSIONS, figure.ravel()))[order], np.concatenate((value, np.full(figure.size, 0.5)))[order]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in text_chunks(batch.column(1)):
            w, x = figures(buf, offsets)
            lengths, index, value = hashed(w, x)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pattern(votes(x))), list_rows(index.astype(np.int16), lengths, pa.int16()), list_rows(value.astype(np.float32), lengths, pa.float32())], names=["id", "pattern", "i", "v"])


def vectors(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pattern, i, v): votes and sparse features of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return materialise(docs.select(F.col(id_col), F.col(text)).mapInArrow(_read, f"id {kind}, pattern bigint, i array<smallint>, v array<float>"), "quality-features")


@dataclass
class Model:
    weights: np.ndarray  # the last is the bias
    known: np.ndarray  # patterns found, sorted
    posterior: np.ndarray  # of good, for each pattern


def _margins(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Margin of every row of (..., i, v), and row, number and value of every feature."""
    i, v = (batch.column(c) for c in ("i", "v"))
    row = np.repeat(np.arange(batch.num_rows), i.value_lengths().to_numpy())
    index, value = i.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy().astype(np.float64)
    return weights[-1] + np.bincount(row, value * weights[index], batch.num_rows), row, index, value


def _gradient(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, seen = np.zeros(DIMENSIONS + 1), 0
        for batch in batches:
            m, row, index, value = _margins(batch, model.weights)
            error = model.posterior[np.searchsorted(model.known, batch.column("pattern").to_numpy())] - 1 / (1 + np.exp(-m))
            g[:-1] += np.bincount(index, value * error[row], DIMENSIONS)
            g[-1] += error.sum()
            seen += batch.num_rows
        if seen:
            some = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some])], names=["i", "g"])

    return run


def train(found: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """From :func:`vectors`."""
    rows = found.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3 ** labellers at most
    known, counts = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
    model = Model(np.zeros(DIMENSIONS + 1), known, expectation_maximisation(known, counts)[0] if rows else np.empty(0))
    part = found.select("pattern", "i", "v").coalesce(2 * found.sparkSession.sparkContext.defaultParallelism)
    first, second = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for r in range(1, rounds + 1 if rows else 0):
        g = np.zeros(DIMENSIONS + 1)
        for x in part.mapInArrow(_gradient(model), "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():  # at most DIMENSIONS + 1 rows
            g[x["i"]] = x["g"] / counts.sum()
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        model.weights += rate * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-6)
    return model


def quality_scores(found: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, weak_label (posterior of the labellers), score, kept for every row of :func:`vectors`."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = 1 / (1 + np.exp(-_margins(batch, model.weights)[0]))
            label = model.posterior[np.searchsorted(model.known, batch.column("pattern").to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label), pa.array(s), pa.array(s >= 0.5)], names=[id_col, "weak_label", "score", "kept"])

    return found.mapInArrow(scored, f"`{id_col}` {found.schema['id'].dataType.simpleString()}, weak_label double, score double, kept boolean")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors(table(spark, sf_dir, "documents"))
    return quality_scores(found, train(found))
