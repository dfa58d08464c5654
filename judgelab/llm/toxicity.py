"""Toxicity scores: boosted trees over dense text features, calibrated (operator 8).

1. A bounded sample of the labelled rows outside the held-out fifth is taken in
   hash order (``sample_rows`` at most) and cut in three by the id's hash.
2. Part one gives the lexicon: words whose share of toxic documents stands out,
   with log-odds weights.
3. Part two trains gradient-boosted trees on lexicon densities, second-person
   proximity, capitals, punctuation and obfuscation rates.
4. Part three calibrates the trees' margin by isotonic regression.
5. Every text is scored in Arrow batches; the model is a few kilobytes.

Nothing but the text enters a score.  Words are compared by 64-bit hashes.

Defined results: a null or empty text has all features 0 and gets the score of
such a text; several labels of an id count as the largest; a null id or label
is never learned from; without labels of both kinds every score is the share of
toxic labels (0 without labels); repeated rows are scored one by one, but an id
is learned from once, so the sample stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.llm.common import crc_mod, materialise, table, text_chunks, utf8, words_of

# Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tus usted ustedes vosotros".split()
# Look-alikes used to hide letters, and marks put between them.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "8": "b", "9": "g"}
MARKS = "*_-.~^`'\"()[]{}<>/\\,;:?#%&=!|+"

NEAR = 4
LEXICON_SIZE = 256
FEATURES = ("strong", "log_strong", "hits", "weight", "top", "hidden", "log_hidden", "near_you", "you", "capitals", "exclaimed", "punctuation", "obfuscated", "log_words", "word_bytes")

_upper = np.zeros(256, dtype=bool)
_upper[65:91] = True
_letter = np.zeros(256, dtype=bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_mark = np.zeros(256, dtype=bool)
_mark[[ord(c) for c in MARKS]] = True
_odd = np.zeros(256, dtype=bool)
_odd[48:58] = True
_odd[[ord(c) for c in "@$*_^~#"]] = True
_leet = np.arange(256, dtype=np.uint8)
for _a, _b in LOOK_ALIKES.items():
    _leet[ord(_a)] = ord(_b)


def _without(buf: np.ndarray, offsets: np.ndarray, drop: np.ndarray, change: np.ndarray | None = None):
    keep = ~drop[buf]
    at = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    out = buf[keep]
    return (out if change is None else change[out]), at[offsets]


def _views(buf: np.ndarray, offsets: np.ndarray):
    """Words without marks, and words with look-alikes resolved as well."""
    plain = words_of(*_without(buf, offsets, _mark), lower=True)
    shown = words_of(*_without(buf, offsets, _mark, _leet), lower=True)
    return plain, shown


def _hash_words(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return words_of(raw, np.array([0, len(raw)]), lower=True).hash


@dataclass
class Lexicon:
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    def of(self, h: np.ndarray) -> np.ndarray:
        """Weight of every word, 0 if it isn't in the lexicon."""
        if not len(self.hashes) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)


_YOU = Lexicon(np.sort(_hash_words(SECOND_PERSON)), np.ones(len(SECOND_PERSON)))


def features(buf: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n_docs = len(offsets) - 1
    raw = words_of(buf, offsets, lower=False)
    plain, shown = _views(buf, offsets)

    def per_doc(w, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[w.first[1:]] - total[w.first[:-1]]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags[buf])))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    weight, seen = lexicon.of(plain.hash), lexicon.of(shown.hash)
    you = _YOU.of(plain.hash)
    reach = np.concatenate(([0.0], np.cumsum(you)))
    here = np.arange(len(you))
    doc = plain.doc()
    lo, hi = np.maximum(here - NEAR, plain.first[doc]), np.minimum(here + NEAR + 1, plain.first[doc + 1])
    near = (weight > 0) & (reach[hi] > reach[lo])
    top = np.zeros(n_docs)
    np.maximum.at(top, doc, weight)
    strong = per_doc(plain, weight >= 2.0)
    hidden = np.maximum(per_doc(shown, seen >= 1.0) - per_doc(plain, weight >= 1.0), 0)
    letters, odd = (np.concatenate(([0], np.cumsum(k[buf]))) for k in (_letter, _odd))
    mixed = (letters[raw.end] > letters[raw.start]) & (odd[raw.end - 1] > odd[raw.start])  # not counting a closing mark
    n = np.maximum(raw.counts(), 1).astype(np.float64)
    out = np.empty((n_docs, len(FEATURES)))
    columns = (strong / n, np.log1p(strong), per_doc(plain, weight > 0) / n, per_doc(plain, weight) / n, top, hidden / n, np.log1p(hidden), per_doc(plain, near) / n, per_doc(plain, you) / n, per_text(_upper) / np.maximum(per_text(_letter), 1), per_text(np.arange(256) == 33) / n, per_text(_mark) / n, per_doc(raw, mixed) / n, np.log(n), per_doc(raw, raw.end - raw.start) / n)
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


# --- the model --------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of fixed depth in heap order, over binned features."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Second-order boosting of the logistic loss on feature histograms."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_bins)[1:-1])) for i in range(x.shape[1])]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(edges, float(np.log(share / (1 - share))), depth=depth)
    b, width = model.bins(x), n_bins
    margin = np.full(len(y), model.start)
    flat = b.astype(np.int64) + np.arange(x.shape[1]) * width
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, node = np.zeros(inner, dtype=np.int64), np.full(inner, 255, dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n_nodes = 2**level - 1, 2**level
            size = n_nodes * x.shape[1] * width
            cell = ((node - first)[:, None] * (x.shape[1] * width) + flat).ravel()
            gs, hs = (np.bincount(cell, np.repeat(v, x.shape[1]), size).reshape(n_nodes, x.shape[1], width) for v in (g, h))
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
            best = gain.reshape(n_nodes, -1).argmax(axis=1)
            for k in range(n_nodes):
                if gain[k].ravel()[best[k]] > 1e-6:
                    feature[first + k], cut[first + k] = divmod(best[k], width)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        margin += leaf[at]
        model.trees.append((feature, cut, leaf))
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled blocks: (mean margin, share), to be joined by lines; one pseudo-count keeps shares off 0 and 1."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([m, float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            m2, v2, w2 = blocks.pop()
            m1, v1, w1 = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), v1 + v2, w1 + w2]
    xs = np.array([b[0] for b in blocks])
    return xs, np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        m = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-m))
        flat = np.interp(m, *self.knots) if len(self.knots[0]) else raw
        return np.clip(0.999 * flat + 0.001 * raw, 0, 1)  # the last part only orders ties


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", sample_rows: int = 24_000) -> Model:
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).dropna().filter(crc_mod("id", 5) != 0)
    chosen = usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(10))
    source = docs.select(F.col(id_col).alias("id"), utf8(text).alias("text"))
    # At most sample_rows pairs of numbers: a fixed bound on what is broadcast.  Of rows with one id, the least text is learned from.
    found = source.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = materialise(found.select("id", "text", "y", part.alias("part")), "toxicity-sample")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(0)):
                _, shown = _views(buf, offsets)
                y = batch.column(1).slice(lo, hi - lo).to_numpy()
                for d in range(hi - lo):
                    words = np.unique(shown.hash[shown.first[d] : shown.first[d + 1]]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.full(len(words), y[d], dtype=np.int32))], names=["h", "y"])

    learn = rows.filter("part < 4")
    n1, n0 = learn.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    counts = learn.select("text", "y").mapInArrow(kinds, "h bigint, y int").groupBy("h").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n0 + 1.0))
    sure = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    top = counts.filter("t >= 2").select("h", odds.alias("w"), sure.alias("z")).filter("z > 2 and w > 0.5").orderBy(F.desc("z"), "h").limit(LEXICON_SIZE).collect()
    top.sort(key=lambda r: np.int64(r["h"]).view(np.uint64))
    lexicon = Lexicon(np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["w"] for r in top]))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(0)):
                x = features(buf, offsets, lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(x))], names=["y", "part", "x"])

    got = rows.filter("part >= 4").orderBy("id").select("text", "y", "part").mapInArrow(dense, "y int, part bigint, x array<double>").toPandas()
    y = got["y"].to_numpy(dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.0
    fit = got["part"].to_numpy() < 8
    if not len(y) or not 0 < y[fit].sum() < fit.sum():
        return Model(lexicon, None, (np.empty(0), np.empty(0)), share)
    x = np.stack(got["x"].to_list())
    trees = boost(x[fit], y[fit])
    rest = ~fit
    knots = isotonic(trees.margin(x[rest]), y[rest]) if 0 < y[rest].sum() < rest.sum() else (np.empty(0), np.empty(0))
    return Model(lexicon, trees, knots, share)


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) of ``docs`` and score double, predicted int (which replace clashing ones)."""
    names = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    read = names if text in names else [*names, text]
    at, width = read.index(text), len(names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(at)):
                s = model.score(features(buf, offsets, model.lexicon))
                rest = [c.slice(lo, hi - lo) for c in batch.columns[:width]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    rows = docs.select(*[F.col(f"`{c}`") for c in read])
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(scored, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    marked = docs.withColumn("held_out", crc_mod("doc_id", 5) == 0)
    return toxicity(marked, train(docs, labels), keep=["doc_id", "held_out"])
