"""Language-model scores from a hashed maximum-entropy model (operator 2).

Tokens are lower-cased words and one end per document; u and v are the tokens
before w.  The commonest ``MODEL_WORDS`` training words lie in classes of words
that keep the same company; all others fall into rare classes by their last
letters.  The model is

    P(w | u, v) = P(class | u, v) * P(w | class, u, v)

* The class is a softmax over sums of hashed feature rows: a bias, the previous
  word, the word before it (skip) and the pair of them.  Rows are of the
  ``OWN`` commonest words and of classes, so this factor has a fixed size.
* The word has n-gram and skip features of its own, for words of any rank: the
  pair (v, w), the skip pair (u, w) where v is rare, and the triple (u, v, w).
  Weights are those of discounted counts, level by level: with count n of N
  under T kinds in a context, a feature's share is (n - D) / N, and D * T / N
  goes to the level below, at last to the word's share of its class.  What is
  gathered thus grows with the corpus; each level sums to 1 over the class.

Training: exact counts of all training tokens; counts of classes by context
over all training positions, which tell all the class factor needs; rounds of
distributed gradient updates over these counts, in each of which partitions
sum observed minus expected counts.

Word features: every position, with a hash of its context, goes to the block of
its context and class, packed by runs of documents.  A block counts the
training positions, sets the weights and scores all its positions, in sparse
numpy batches; only sums a document go back.  A context and class of more than
``SPLIT`` training positions is split by context pairs, and such a pair by
documents, so that no block holds a hot context whole; every part gets the
counts of the whole, summed beforehand, so scores don't depend on the split.
Counts of common words are broadcast
(``HEAD_WORDS`` at most, a fixed bound); rarer words are joined to the count
table.  Words are compared by 64-bit hashes, contexts in a block by hashes too.

Defined results: a null or empty text is one end token; repeated rows count and
are scored one by one; a null id counts as the empty text for the split;
without training rows N and V are 0 and the base is 0; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from judgelab.llm.common import crc_mod, list_rows, materialise, mix, release, table, text_chunks, utf8, words_of

HEAD_WORDS = 1 << 18
CLASSES, MEMBERS, RARE = 64, 128, 16
MODEL_WORDS = CLASSES * MEMBERS
OUTCOMES = CLASSES + RARE
OWN = 256  # words with a context row of their own in the class factor
ROWS1 = OWN + OUTCOMES + 1  # the last is the start of a document
START = ROWS1 - 1
CELLS = ROWS1 * ROWS1
PAIRS = 8192
CLASS_ROWS = 2 * ROWS1 + PAIRS
ANCHORS = 32
ROUNDS, RATE = 8, 0.3
KAPPA = 8.0
DISCOUNT = 0.75
BLOCK = 1 << 16
#: Tokens that a task packs at once, positions of a block on average, and training positions of one part of a hot context.
PACK_TOKENS, BLOCK_TOKENS, SPLIT = 400_000, 700_000, 1_000_000
#: Tokens of a training task at least, once there are more tasks than twice the cores.
TASK_TOKENS = 50_000_000
END = np.uint64(0x656E64)
_BEGIN = np.uint64(0x626567696E)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in ".,;:!?"]] = True


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with one end a document, their rare classes, and where documents begin."""
    w = words_of(buf, offsets, lower=True)
    last = w.end - 1
    last = np.where(_PUNCT[w.buf[last]] & (last > w.start), last - 1, last)
    before = np.maximum(last - 1, w.start)
    rare = (mix(w.buf[last].astype(np.uint64) * np.uint64(256) + w.buf[before]) % np.uint64(RARE)).astype(np.int8)
    ends = w.first[1:]
    return np.insert(w.hash, ends, END), np.insert(rare, ends, 0), w.first + np.arange(len(w.first))


@dataclass
class Vocabulary:
    """Common training words, sorted by hash: count, rare class and number among the model's words (-1: not one)."""

    hash: np.ndarray
    count: np.ndarray
    rare: np.ndarray
    rank: np.ndarray
    total: int  # N
    kinds: int  # V
    place: np.ndarray  # class * MEMBERS + member of each model word, by rank
    rare_total: np.ndarray
    rare_kinds: np.ndarray

    @property
    def base_mass(self) -> float:
        return self.total + 0.5 * (self.kinds + 1)

    @property
    def rare_mass(self) -> np.ndarray:
        return self.rare_total + 0.5 * (self.rare_kinds + 1)

    def settle(self) -> None:
        """Outcome class and share of it for every common word; a rare class has half a count for each kind and for unknown words."""
        model = self.rank >= 0
        own = self.place[np.maximum(self.rank, 0)] // MEMBERS if len(self.place) else np.zeros(len(self.hash), dtype=np.int64)
        self.outcome = np.where(model, own, CLASSES + self.rare)
        mass = np.bincount(own[model], self.count[model], CLASSES)
        self.share = np.where(model, self.count / np.maximum(mass[own], 1), (self.count + 0.5) / self.rare_mass[self.rare])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each token, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)


@dataclass
class Weights:
    bias: np.ndarray
    classes: np.ndarray  # CLASS_ROWS x OUTCOMES


@dataclass
class Positions:
    """Tokens of a run of documents: row among the common words (-1: none), outcome class, context rows."""

    row: np.ndarray
    outcome: np.ndarray
    one: np.ndarray
    two: np.ndarray


def positions(h: np.ndarray, rare: np.ndarray, first: np.ndarray, v: Vocabulary) -> Positions:
    row = v.find(h)
    common = row >= 0
    outcome, rank = CLASSES + rare.astype(np.int64), np.full(len(h), -1)
    outcome[common], rank[common] = v.outcome[row[common]], v.rank[row[common]]
    context = np.where((rank >= 0) & (rank < OWN), rank, OWN + outcome)
    return Positions(row, outcome, _before(context, first, 1, START), _before(context, first, 2, START))


def _before(x: np.ndarray, first: np.ndarray, k: int, start) -> np.ndarray:
    """The value ``k`` places before each token, or ``start`` before its document begins."""
    out = np.full(len(x), start, dtype=x.dtype)
    out[k:] = x[:-k]
    for i in range(k):
        out[np.minimum(first[:-1] + i, first[1:] - 1)] = start
    return out


def class_rows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    pair = (mix((one * ROWS1 + two).astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
    return np.stack([one, ROWS1 + two, 2 * ROWS1 + pair])


def logits(bias: np.ndarray, table_: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = np.take(table_, rows[0], axis=0)
    for r in rows[1:]:
        x += np.take(table_, r, axis=0)
    x += bias
    return x  # sums of clipped weights and log shares: exponents stay small


def probabilities(bias: np.ndarray, table_: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = logits(bias, table_, rows)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """total[rows] += values, where rows repeat."""
    if len(rows):
        order = np.argsort(rows, kind="stable")
        r = rows[order]
        begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        total[r[begin]] += np.add.reduceat(values[order], begin, axis=0)


# --- sums of arrays over partitions ------------------------------------------------------


def _emit(array: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    flat = array.astype(np.float32).ravel()
    for b in range(0, len(flat), BLOCK):
        if (piece := flat[b : b + BLOCK]).any():
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK]), pa.array([part]), pa.array([zlib.compress(piece.tobytes(), 1)], type=pa.binary())], names=["block", "part", "data"])


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays in (block, part, data): in two steps, so that no group holds all partitions' parts."""

    def add(t: pa.Table) -> pa.Table:
        out = 0.0
        for x in t.column("data"):
            out = out + np.frombuffer(zlib.decompress(x.as_py()), dtype=np.float32).astype(np.float64)
        return pa.table({"block": t.column("block")[:1], "part": pa.array([0]), "data": pa.array([zlib.compress(out.astype(np.float32).tobytes(), 1)], type=pa.binary())})

    schema = "block bigint, part bigint, data binary"
    near = df.groupBy("block", F.pmod("part", F.lit(64)).alias("p")).applyInArrow(add, schema)
    rows = near.groupBy("block").applyInArrow(add, schema).collect()  # a fixed number of blocks
    out = np.zeros(-(-size // BLOCK) * BLOCK, dtype=np.float32)
    for r in rows:
        piece = np.frombuffer(zlib.decompress(r["data"]), dtype=np.float32)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(piece)] = piece
    return out[:size]


def _gathered(docs: DataFrame, v, size: int, add) -> np.ndarray:
    """Sum over all partitions of what ``add(total, h, rare, first, vocabulary)`` adds to a flat array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            for _, _, buf, offsets in text_chunks(batch.column(0)):
                add(total, *tokens(buf, offsets), v.value)
        yield from _emit(total, TaskContext.get().partitionId())

    # Every task sends one array: not more tasks than cores, but for large inputs.
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, v.value.total // TASK_TOKENS)
    return _summed(docs.coalesce(int(tasks)).mapInArrow(run, "block bigint, part bigint, data binary"), size)


# --- training ---------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, r = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        kinds, at, n = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(r[at].astype(np.int32)), pa.array(n)], names=["h", "r", "n"])

    size = 0
    for batch in batches:
        for _, _, buf, offsets in text_chunks(batch.column(0)):
            h, r, _ = tokens(buf, offsets)
            held.append((h, r))
            size += len(h)
            if size > 2_000_000:
                yield flush()
                size = 0
    if held:
        yield flush()


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The common words, and the table of all counts (h, r, n)."""
    counts = materialise(docs.mapInArrow(_counted, "h bigint, r int, n bigint").groupBy("h").agg(F.max("r").alias("r"), F.sum("n").alias("n")), "word-counts")
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(counts.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect(), reverse=True)
    least, room = 1 << 20, HEAD_WORDS
    for r in levels:
        if r["k"] > room:
            break
        room, least = room - r["k"], r["l"]
    head = counts.filter(level >= least).toArrow()
    h, r, n = (head.column(c).to_numpy() for c in ("h", "r", "n"))
    order = np.argsort(h.view(np.uint64))
    h, r, n = h[order].view(np.uint64), r[order], n[order]
    top = np.lexsort((h, -n))[:MODEL_WORDS]
    rank = np.full(len(h), -1, dtype=np.int64)
    rank[top] = np.arange(len(top))
    sums = counts.groupBy("r").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    rare_n, rare_k = np.zeros(RARE), np.zeros(RARE)
    for s in sums:
        rare_n[s["r"]], rare_k[s["r"]] = s["n"], s["k"]
    total, kinds = int(rare_n.sum()), int(rare_k.sum())
    rare_n -= np.bincount(r[top], n[top], RARE)
    rare_k -= np.bincount(r[top], minlength=RARE)
    return Vocabulary(h, n, r, rank, total, kinds, np.arange(len(top)), rare_n, rare_k), counts


def _company(total: np.ndarray, h: np.ndarray, rare: np.ndarray, first: np.ndarray, v: Vocabulary) -> None:
    """Counts of the last of the ANCHORS commonest words before each model word."""
    row = v.find(h)
    rank = np.where(row >= 0, v.rank[row], -1) if len(v.rank) else np.full(len(h), -1)
    anchor = np.where((rank >= 0) & (rank < ANCHORS), np.arange(len(h)), -1)
    last = np.maximum.accumulate(np.concatenate(([-1], anchor[:-1])))
    begin = np.repeat(first[:-1], np.diff(first))
    some = (rank >= 0) & (last >= begin)
    total += np.bincount(rank[some] * ANCHORS + rank[last[some]], minlength=len(total))


def _places(company: np.ndarray, n: int, clusters: int = 16, rounds: int = 10) -> np.ndarray:
    """class * MEMBERS + member for each model word: words of a cluster follow each other."""
    x = np.log1p(company.reshape(-1, ANCHORS)[:n])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[: min(clusters, n)].copy()
    mine = np.zeros(n, dtype=np.int64)
    for _ in range(rounds if n else 0):
        mine = (x @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            if (mine == k).any():
                centre[k] = x[mine == k].mean(axis=0)
    place = np.empty(n, dtype=np.int64)
    place[np.lexsort((np.arange(n), mine))] = np.arange(n)
    return place


# --- the class factor -------------------------------------------------------------------


def _cells(v, split: int):
    """Counts of (context pair, outcome class) over all positions; from ``CELLS`` on, those of contexts of words with over ``split`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        times = context_counts(v.value)

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((cell // OUTCOMES).astype(np.int32)), pa.array((cell % OUTCOMES).astype(np.int32)), pa.array(n)], names=["context", "outcome", "n"])

        size = 0
        for batch in batches:
            for _, _, buf, offsets in text_chunks(batch.column(0)):
                h, rare, first = tokens(buf, offsets)
                p = positions(h, rare, first, v.value)
                held.append((p.one * ROWS1 + p.two) * OUTCOMES + p.outcome)
                if (times > split).any():
                    near, row = context_rows(p.row, first)
                    many = times[row] > split
                    held.append((CELLS + 2 * (row[many] + 2) + near[many]) * OUTCOMES + p.outcome[many])
                size += len(p.row)
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _all_statistics(docs: DataFrame, v, split: int) -> DataFrame:
    cells = docs.mapInArrow(_cells(v, split), "context int, outcome int, n bigint").repartition("context").groupBy("context", "outcome").agg(F.sum("n").alias("n"))
    return materialise(cells.groupBy("context").agg(F.collect_list("outcome").alias("outcomes"), F.collect_list("n").alias("ns")), "class-counts")


def statistics(docs: DataFrame, v) -> DataFrame:
    """(context, outcomes, ns): one row a context pair, ROWS1 ** 2 at most, over all positions of ``docs``."""
    return _all_statistics(docs, v, SPLIT).filter(F.col("context") < CELLS)


def _gaps(weights):
    """Observed less expected counts of every feature row (observed ones alone without weights), and how often it was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w: Weights | None = weights.value if weights else None
        total, seen = np.zeros((CLASS_ROWS, OUTCOMES)), np.zeros(CLASS_ROWS)
        for batch in batches:
            context, lists = batch.column(0).to_numpy().astype(np.int64), [batch.column(1), batch.column(2)]
            outcome, n = (x.flatten().to_numpy() for x in lists)
            owner = np.repeat(np.arange(len(context)), lists[0].value_lengths().to_numpy())
            rows = class_rows(context // ROWS1, context % ROWS1)
            for a in range(0, len(context), 4096):
                r = rows[:, a : a + 4096]
                gap = np.zeros((r.shape[1], OUTCOMES))
                lo, hi = np.searchsorted(owner, [a, a + 4096])
                gap[owner[lo:hi] - a, outcome[lo:hi]] = n[lo:hi]
                times = gap.sum(axis=1)
                if w:
                    gap -= times[:, None] * probabilities(w.bias, w.classes, r)
                for x in r:
                    add_rows(total, x, gap)
                    np.add.at(seen, x, times)
        yield from _emit(np.concatenate((total.ravel(), seen)), TaskContext.get().partitionId())

    return run


def _sum_gaps(stats: DataFrame, weights=None) -> tuple[np.ndarray, np.ndarray]:
    sc, cells = stats.sparkSession.sparkContext, CLASS_ROWS * OUTCOMES
    g = _summed(stats.coalesce(2 * sc.defaultParallelism).mapInArrow(_gaps(sc.broadcast(weights) if weights else None), "block bigint, part bigint, data binary"), cells + CLASS_ROWS)
    return g[:cells].reshape(CLASS_ROWS, OUTCOMES).astype(np.float64), g[cells:].astype(np.float64)


def fit_classes(stats: DataFrame, rounds: int = ROUNDS) -> Weights:
    """One scaling step of every feature row from its counts, then gradient rounds."""
    obs, _ = _sum_gaps(stats)
    outcome = obs[:ROWS1].sum(axis=0) + 0.1
    share = outcome / outcome.sum()
    floor = KAPPA * share + 1e-9
    classes = (0.4 * np.log((obs + floor) / (obs.sum(axis=1, keepdims=True) * share + floor))).clip(-4, 4)
    w = Weights(np.log(share), classes)
    for _ in range(rounds):
        gap, seen = _sum_gaps(stats, w)
        w.classes += (RATE * gap / (seen[:, None] * share + KAPPA)).clip(-1, 1)
    return w


def _train(docs: DataFrame, split: int) -> tuple[Vocabulary, Weights, DataFrame, Hot]:
    sc = docs.sparkSession.sparkContext
    v, counts = vocabulary(docs)
    v.place = _places(_gathered(docs, sc.broadcast(v), MODEL_WORDS * ANCHORS, _company), int((v.rank >= 0).sum()))
    v.settle()
    stats = _all_statistics(docs, sc.broadcast(v), split)
    return v, fit_classes(stats.filter(F.col("context") < CELLS)), counts, hot_contexts(stats, v, split)


def train(docs: DataFrame) -> tuple[Vocabulary, Weights, DataFrame]:
    """``docs``: the training texts as one binary column."""
    return _train(docs, SPLIT)[:3]


def class_scores(p: Positions, w: Weights) -> np.ndarray:
    """log10 P(class | context) of every position; a context that repeats is computed once."""
    kinds, where = np.unique(p.one * ROWS1 + p.two, return_inverse=True)
    order, begin = np.argsort(where, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(kinds)))))
    rows, out = class_rows(kinds // ROWS1, kinds % ROWS1), np.empty(len(where))
    for a in range(0, len(kinds), 4096):
        b = min(len(kinds), a + 4096)
        mine = order[begin[a] : begin[b]]
        out[mine] = np.log10(probabilities(w.bias, w.classes, rows[:, a:b])[where[mine] - a, p.outcome[mine]])
    return out


# --- the word factor --------------------------------------------------------------------


@dataclass
class Grams:
    """Positions as a block gets them: context and class, word, context pair, document * 2 + (1 if training)."""

    key: np.ndarray
    word: np.ndarray  # row of a common word, else 2 ** 31 and bits of its hash
    pair: np.ndarray
    doc: np.ndarray


def _rare_word(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.uint32) | np.uint32(1 << 31)


def document_keys(h: np.ndarray, first: np.ndarray, ids: list) -> np.ndarray:
    """A number of each document that follows from its id and its tokens alone."""
    named = np.array([zlib.crc32(str(i).encode()) for i in ids], dtype=np.uint64)
    return mix(np.add.reduceat(h, first[:-1]) + mix(named)) if len(first) > 1 else np.empty(0, dtype=np.uint64)


def context_counts(v: Vocabulary) -> np.ndarray:
    """Occurrences of common words as contexts; at -2 and -1 those of a document's start and of a rare word."""
    ends = v.count[v.find(np.array([END]))].sum() if len(v.hash) else 0
    return np.append(v.count, (ends, 0))


def context_rows(row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the word before is a common one, and the row of the context: that word's, else that of the word before it."""
    row1 = _before(row, first, 1, -2)
    near = row1 != -1
    return near, np.where(near, row1, _before(row, first, 2, -2))


def _context_key(word: np.ndarray, near: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    return mix(mix(word ^ np.where(near, _A, _B)) * _A + outcome.astype(np.uint64))


def _pair(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (mix(two * _A + one) & np.uint64(0xFFFFFF)).astype(np.uint32)


def _pair_key(key: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(pair.astype(np.uint64) + np.uint64(1)))


def _part(key: np.ndarray, i: np.ndarray) -> np.ndarray:
    return mix(key + (i.astype(np.uint64) + np.uint64(1)) * _B)


def _found(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each of ``x`` in the sorted ``among``, or -1."""
    if not len(among):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, -1)


@dataclass
class Hot:
    """Contexts with a class, and pairs in them, of more than ``SPLIT`` training positions: sorted keys, numbers of parts, a pair's context and 24 bits."""

    key: np.ndarray
    parts: np.ndarray
    pair: np.ndarray
    pair_parts: np.ndarray
    pair_of: np.ndarray
    pair_bits: np.ndarray

    def places(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Keys of all parts of each context (also of its pairs' parts), and of each pair."""
        pairs = [_part(np.full(n, k), np.arange(n)) for k, n in zip(self.pair, self.pair_parts, strict=True)]
        mine = _found(self.key, self.pair_of)
        return [np.concatenate([_part(np.full(n, k), np.arange(n)), *(pairs[i] for i in np.flatnonzero(mine == j))]) for j, (k, n) in enumerate(zip(self.key, self.parts, strict=True))], pairs


def _hot(key: np.ndarray, n: np.ndarray, of: np.ndarray, pair: np.ndarray, pair_n: np.ndarray, split: int) -> Hot:
    """From training positions by context and class, and by their pairs."""
    key, n, of, pair, pair_n = key[n > split], n[n > split], of[pair_n > split], pair[pair_n > split], pair_n[pair_n > split]
    pairs = _pair_key(of, pair)
    a, b = np.argsort(key), np.argsort(pairs)
    return Hot(key[a], -(-n[a] // split), pairs[b], -(-pair_n[b] // split), of[b], pair[b])


def hot_contexts(stats: DataFrame, v: Vocabulary, split: int) -> Hot:
    """Contexts and pairs to split; less than one for ``split`` tokens each.

    Pairs are those of the ``OWN`` commonest words and starts; any other one has
    at most the occurrences of the commonest word beyond them.
    """
    cells = stats.select("context", F.explode(F.arrays_zip("outcomes", "ns")).alias("x")).select("context", "x.outcomes", "x.ns").filter(F.col("ns") > split).collect()
    context, outcome, n = (np.array([r[i] for r in cells], dtype=np.int64) for i in range(3))
    own = context >= CELLS
    code = context[own] - CELLS
    words = np.append(v.hash, (_BEGIN, np.uint64(0)))  # by row, as in context_counts
    key = _context_key(words[code // 2 - 2], code % 2 == 1, outcome[own])
    one, two = context[~own] // ROWS1, context[~own] % ROWS1
    plain = ((one < OWN) | (one == START)) & ((two < OWN) | (two == START))
    by_rank = np.zeros(ROWS1, dtype=np.uint64)
    common = (v.rank >= 0) & (v.rank < OWN)
    by_rank[v.rank[common]], by_rank[START] = v.hash[common], _BEGIN
    one, two = by_rank[one[plain]], by_rank[two[plain]]
    of = _context_key(one, np.ones(len(one), dtype=bool), outcome[~own][plain])
    return _hot(key, n[own], of, _pair(two, one), n[~own][plain], split)


def _context_grams(h: np.ndarray, first: np.ndarray, p: Positions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and class (64 bits), word and context pair of every position."""
    one, two = _before(h, first, 1, _BEGIN), _before(h, first, 2, _BEGIN)
    near, _ = context_rows(p.row, first)
    word = np.where(p.row >= 0, p.row.astype(np.uint32), _rare_word(h))
    return _context_key(np.where(near, one, two), near, p.outcome), word, _pair(two, one)


def grams(h: np.ndarray, first: np.ndarray, p: Positions, held_out: np.ndarray, v: Vocabulary, keys: np.ndarray, split: int = SPLIT, hot: Hot | None = None) -> Grams:
    """``hot``: contexts to split; without it, those with over ``split`` of these positions."""
    key, word, pair = _context_grams(h, first, p)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if hot is None:
        kinds, at, times = np.unique(_pair_key(key, pair), return_index=True, return_counts=True)
        hot = _hot(*np.unique(key, return_counts=True), key[at], pair[at], times, split)
    at = _found(hot.key, key)
    some = np.flatnonzero(at >= 0)
    if len(some):
        pairs = _pair_key(key[some], pair[some])
        key[some] = _part(key[some], pair[some] % hot.parts[at[some]])
        at = _found(hot.pair, pairs)
        many = at >= 0
        key[some[many]] = _part(pairs[many], keys[doc[some[many]]] % hot.pair_parts[at[many]].astype(np.uint64))
    return Grams(key >> np.uint64(24), word, pair, (2 * doc + ~held_out[doc]).astype(np.uint32))  # 40 bits, of which a block has part


@dataclass
class Known:
    """Training counts of whole contexts (pairs: of a whole pair) that are split, as a block with a part gets them."""

    key: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    of_pair: np.ndarray
    n: np.ndarray


def shares(g: Grams, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): P(word | class, contexts) is a + b * (the word's share of its class); learnt from the training positions of ``g``, or from ``known`` where contexts are split."""

    def ids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, at = np.unique(x, return_inverse=True)
        return kinds, at.astype(np.int32)

    size = len(g.key)
    first = second = (g.doc & 1).astype(np.float32)
    context, word, pair_of = g.key, g.word, g.pair
    if known is not None and len(known.key):
        of = known.of_pair
        first = np.concatenate((np.where(np.isin(g.key, known.key[~of]), 0.0, first), np.where(of, 0, known.n)))
        second = np.concatenate((np.where(np.isin(g.key, known.key[of]), 0.0, second), np.where(of, known.n, 0)))
        context, word, pair_of = (np.concatenate(x) for x in ((g.key, known.key), (g.word, known.word), (g.pair, known.pair)))

    def level(context: np.ndarray, n_contexts: int, feature: np.ndarray, of: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, total = np.bincount(feature, times, len(of)), np.bincount(context, times, n_contexts)
        kinds = np.bincount(of[n > 0], minlength=n_contexts)
        safe = np.maximum(total, 1)
        below = np.where(total > 0, DISCOUNT * kinds / safe, 1.0).astype(np.float32)
        return (np.maximum(n - DISCOUNT, 0).astype(np.float32))[feature] / safe.astype(np.float32)[context], below[context]

    keys, key = ids(context)
    gram, feature = ids(key.astype(np.int64) << 32 | word)
    a1, b1 = level(key, len(keys), feature, gram >> 32, first)
    gram, feature = ids(feature.astype(np.int64) << 24 | pair_of)
    pairs, pair = ids(key.astype(np.int64) << 24 | pair_of)
    of = np.empty(len(gram), dtype=np.int32)
    of[feature] = pair
    a2, b2 = level(pair, len(pairs), feature, of, second)
    return (a2 + b2 * a1)[:size], (b2 * b1)[:size]


def _hot_counts(v, hot):
    """Training counts (of_pair, at, word, n) of words in the contexts and pairs of ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            for of_pair, x in enumerate(held):
                kinds, n = np.unique(np.concatenate(x), return_counts=True)
                x.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), of_pair == 1)), pa.array((kinds >> 32).astype(np.int32)), pa.array(kinds & 0xFFFFFFFF), pa.array(n)], names=["of_pair", "at", "word", "n"])

        size = 0
        for batch in batches:
            for _, _, buf, offsets in text_chunks(batch.column(0)):
                h, rare, first = tokens(buf, offsets)
                key, word, pair = _context_grams(h, first, positions(h, rare, first, v.value))
                at = _found(hot.value.key, key)
                some = at >= 0
                held[0].append(at[some] << 32 | word[some])
                at = _found(hot.value.pair, _pair_key(key[some], pair[some]))
                held[1].append((at << 32 | word[some])[at >= 0])
                size += len(held[0][-1]) + len(held[1][-1])
                if size > 2_000_000:
                    yield from flush()
                    size = 0
        if held[0]:
            yield from flush()

    return run


def _known_sent(hot, blocks: int):
    """The counts of :func:`_hot_counts` for every part of the context or pair, as rows of :func:`_sent` with run -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [(np.concatenate([np.empty(0, dtype=np.uint64), *x]), np.cumsum([0, *map(len, x)])) for x in hot.value.places()]
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            key, word, pair, of_pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            block = (key >> np.uint64(8)) * np.uint64(blocks) >> np.uint64(32)
            order = np.argsort(block)
            block, columns = block[order], [x[order] for x in (key, word, pair, of_pair, n)]
            cut = np.concatenate((np.flatnonzero(np.diff(block, prepend=np.uint64(blocks))), [len(block)]))
            data = [_pack(*(x[a:b] for x in columns)) for a, b in zip(cut, cut[1:])]
            rows = len(data)
            known = [pa.array(block[cut[:-1]].astype(np.int32)), pa.array(np.full(rows, -1)), pa.array(np.diff(cut)), pa.array(np.zeros(rows, dtype=np.int64)), pa.array([x[0] for x in data], type=pa.int64()), pa.array([x[1] for x in data], type=pa.binary())]
            return pa.RecordBatch.from_arrays(known, names=_SENT[: len(known)])

        size = 0
        for batch in batches:
            of_pair, at, word, n = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            pair = np.zeros(len(at), dtype=np.uint32)
            pair[of_pair] = hot.value.pair_bits[at[of_pair]]
            for kind, (keys, first) in enumerate(places):
                mine = np.flatnonzero(of_pair == (kind == 1))
                times = np.diff(first)[at[mine]]
                total = int(times.sum())
                step = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
                mine = np.repeat(mine, times)
                held.append((keys[first[at[mine]] + step] >> np.uint64(24), word[mine].astype(np.uint32), pair[mine], of_pair[mine], n[mine]))
                size += total
            if size > PACK_TOKENS:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _known(rows: pa.Table) -> Known:
    got = []
    for raw, data, n in zip(*(rows.column(c).to_pylist() for c in ("raw", "data", "n")), strict=True):
        buf, at, out = pa.Codec(_CODEC["compression"]).decompress(data, raw, asbytes=True), 0, []
        for kind in (np.uint64, np.uint32, np.uint32, np.bool_, np.int64):
            out.append(np.frombuffer(buf, dtype=kind, count=n, offset=at))
            at += out[-1].nbytes
        got.append(out)
    return Known(*(np.concatenate(x) for x in zip(*got, strict=True)))


_CODEC = {"compression": "zstd", "compression_level": 1}


def _pack(*arrays: np.ndarray) -> tuple[int, bytes]:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw), pa.Codec(_CODEC["compression"], _CODEC["compression_level"]).compress(raw, asbytes=True)


def _sent(v, weights, blocks: int, kind: pa.DataType, hot):
    """A row for each run of documents with what is known of them, and its positions for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab: Vocabulary = v.value
        log_base, log_count = np.log10(vocab.base_mass) if vocab.total else 0.0, np.log10(vocab.count + 0.5)
        held: list[tuple] = []
        run_no = TaskContext.get().partitionId() << 20

        def flush() -> Iterator[pa.RecordBatch]:
            h, rare = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))))
            ids, out = pa.concat_arrays([x[3] for x in held]), np.concatenate([x[4].to_numpy(zero_copy_only=False) for x in held])
            held.clear()
            p = positions(h, rare, first, vocab)
            known = p.row >= 0
            base = np.full(len(h), -log_base)
            base[known] += log_count[p.row[known]]
            g = grams(h, first, p, out, vocab, document_keys(h, first, ids.to_pylist()), hot=hot.value)
            order = np.argsort(g.key << np.uint64(24) | (g.word * np.uint32(0x9E3779B1) >> np.uint32(8)).astype(np.uint64))
            key, word, pair, doc = (x[order] for x in (g.key, g.word, g.pair, g.doc))
            block = (key >> np.uint64(8)) * np.uint64(blocks) >> np.uint64(32)
            rare_word = word >= 1 << 31
            tail = h[order][rare_word], (p.outcome[order][rare_word] - CLASSES).astype(np.uint8)
            word[rare_word] = 1 << 31  # the rest follows from the hash
            cut = np.searchsorted(block, np.arange(blocks + 1))
            at = np.concatenate(([0], np.cumsum(rare_word)))
            some = np.flatnonzero(cut[1:] > cut[:-1])
            n, tails, data = [0], [0], [(0, b"")]
            for k in some:
                a, b, c, d = cut[k], cut[k + 1], at[cut[k]], at[cut[k + 1]]
                n.append(b - a)
                tails.append(d - c)
                data.append(_pack(np.diff(key[a:b], prepend=np.uint64(0)), word[a:b], (pair[a:b] >> 8).astype(np.uint16), pair[a:b].astype(np.uint8), doc[a:b], tail[0][c:d], tail[1][c:d]))
            docs, rows = len(ids), len(n)
            per_doc = lambda x: np.add.reduceat(x.astype(np.float64), first[:-1])
            own = [(ids, kind), (pa.array(out), pa.bool_()), (pa.array(np.diff(first)), pa.int64()), (pa.array(per_doc(known).astype(np.int64)), pa.int64()), (pa.array(per_doc(base)), pa.float64()), (pa.array(per_doc(class_scores(p, weights.value))), pa.float64())]
            columns = [pa.array([run_no % blocks, *some.tolist()], type=pa.int32()), pa.array([run_no] * rows), *(pa.array(x, type=pa.int64()) for x in (n, tails, [x[0] for x in data])), pa.array([x[1] for x in data], type=pa.binary())]
            offsets = pa.array([0, *[docs] * rows], type=pa.int32())
            none = pa.array([False, *[True] * (rows - 1)])
            yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(offsets, x.cast(k), mask=none) for x, k in own)], names=_SENT)

        size = 0
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(2)):
                h, rare, first = tokens(buf, offsets)
                held.append((h, rare, first, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)))
                size += len(h)
                if size > PACK_TOKENS:
                    yield from flush()
                    size, run_no = 0, run_no + 1
        if held:
            yield from flush()

    return run


_OWN = ["ids", "held", "n_tokens", "n_known", "base", "score"]
_SENT = ["block", "run", "n", "tails", "raw", "data", *_OWN]


def _unpack(raw: int, data: bytes, n: int, tails: int) -> tuple[np.ndarray, ...]:
    buf, at, out = pa.Codec(_CODEC["compression"]).decompress(data, raw, asbytes=True), 0, []
    for kind, k in ((np.uint64, n), (np.uint32, n), (np.uint16, n), (np.uint8, n), (np.uint32, n), (np.uint64, tails), (np.uint8, tails)):
        out.append(np.frombuffer(buf, dtype=kind, count=k, offset=at))
        at += out[-1].nbytes
    key, word, high, low, doc, h, cls = out
    word = word.copy()
    word[word == 1 << 31] = _rare_word(h)
    return np.cumsum(key, dtype=np.uint64), word, high.astype(np.uint32) << np.uint32(8) | low, doc, h, cls


def _block_scores(v):
    """Scores of a block's positions: sums a document for common words, the rare words one by one."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own = t.filter(pa.compute.is_valid(t.column("ids")))
        sent = t.filter(pa.compute.is_null(t.column("ids")))
        whole, sent = sent.filter(pa.compute.less(sent.column("run"), 0)), sent.filter(pa.compute.greater_equal(sent.column("run"), 0))
        runs = sent.num_rows
        got = [_unpack(*x) for x in zip(*(sent.column(c).to_pylist() for c in ("raw", "data", "n", "tails")), strict=True)]
        parts = [np.concatenate([x[i] for x in got]) if got else np.empty(0, dtype=d) for i, d in enumerate((np.uint64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint8))]
        sizes = [len(x[0]) for x in got]
        del got
        g, h, cls = Grams(*parts[:4]), parts[4], parts[5]
        a, b = shares(g, _known(whole) if whole.num_rows else None) if len(g.key) else (np.empty(0), np.empty(0))
        owner = np.repeat(np.arange(runs), sizes) if runs else np.empty(0, dtype=np.int64)
        doc = (g.doc >> 1).astype(np.int64)
        rare = g.word >= 1 << 31
        of, at = np.unique(owner[~rare] << 32 | doc[~rare], return_inverse=True)
        s = np.bincount(at, np.log10(a[~rare] + b[~rare] * v.value.share[g.word[~rare]])) if len(of) else np.empty(0)
        n_docs, n_rare = np.bincount(of >> 32, minlength=runs), np.bincount(owner[rare], minlength=runs)
        lists = [(of & 0xFFFFFFFF, n_docs, pa.int32()), (s.astype(np.float32), n_docs, pa.float32()), (doc[rare], n_rare, pa.int32()), (h.view(np.int64), n_rare, pa.int64()), (a[rare].astype(np.float32), n_rare, pa.float32()), ((b[rare] / v.value.rare_mass[cls]).astype(np.float32), n_rare, pa.float32())]
        back = [sent.column("run"), *(sent.column(c) for c in _OWN), *(list_rows(x, n, k) for x, n, k in lists)]
        first = pa.table(dict(zip(_BACK, back, strict=True)))
        return pa.concat_tables([first, own.select(["run", *_OWN])], promote_options="default")

    return run


_BACK = ["run", *_OWN, "doc", "s", "rare_doc", "rare", "share", "part"]


def _added(t: pa.Table) -> pa.Table:
    """Sums by document of one run."""
    doc, s = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("doc", "s"))
    of, at = np.unique(doc, return_inverse=True)
    return pa.table({"run": pa.array(np.full(len(of), t.column("run")[0].as_py(), dtype=np.int64)), "doc": pa.array(of, type=pa.int32()), "s": np.bincount(at, s, len(of)) if len(of) else np.empty(0)})


def language_model_scores(docs: DataFrame, text: str = "text", id_col: str = "doc_id", split: int = SPLIT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``split``: training positions of a context and class beyond which it is
    split; scores don't depend on it, but for the order of sums.
    """
    field = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, 5) == 1).alias("held_out"), utf8(text).alias("text"))
    learnt = source.filter("not held_out").select("text")
    v, weights, counts, found = _train(learnt, split)
    sc = docs.sparkSession.sparkContext
    shared, hot, blocks = sc.broadcast(v), sc.broadcast(found), max(1, v.total // BLOCK_TOKENS)
    lists = f"ids array<{field.simpleString()}>, held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, score array<double>"
    packed = "block int, run bigint, n bigint, tails bigint, raw bigint, data binary"
    sent = source.mapInArrow(_sent(shared, sc.broadcast(weights), blocks, to_arrow_type(field), hot), f"{packed}, {lists}")
    if len(found.key):
        whole = learnt.mapInArrow(_hot_counts(shared, hot), "of_pair boolean, at int, word bigint, n bigint").groupBy("of_pair", "at", "word").agg(F.sum("n").alias("n"))
        sent = sent.unionByName(whole.mapInArrow(_known_sent(hot, blocks), packed), allowMissingColumns=True)
    release(docs.sparkSession)
    back = sent.groupBy("block").applyInArrow(_block_scores(shared), f"run bigint, {lists}, doc array<int>, s array<float>, rare_doc array<int>, rare array<bigint>, share array<float>, part array<float>")
    back = materialise(back, "scores")
    del sent
    release(docs.sparkSession)
    key = lambda doc: F.shiftleft("run", 20) + F.col(doc)
    own = back.filter("ids IS NOT NULL").select("run", F.posexplode(F.arrays_zip(*_OWN)).alias("doc", "x")).select(key("doc").alias("key"), "x.*")
    sums = back.filter("ids IS NULL").select("run", "doc", "s").groupBy("run").applyInArrow(_added, "run bigint, doc int, s double").select(key("doc").alias("key"), "s")
    # Words that aren't broadcast: joined to the count table, which is small beside the texts.
    rare = back.filter("ids IS NULL").select("run", F.explode(F.arrays_zip("rare_doc", "rare", "share", "part")).alias("x")).select(key("x.rare_doc").alias("key"), F.col("x.rare").alias("h"), "x.share", "x.part")
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(counts.select("h", F.col("n").alias("c")), "h", "left").groupBy("key").agg(F.sum(F.log10(c + 0.5)).alias("logs"), F.count_if(F.col("c") > 0).alias("known"), F.sum(F.log10(F.col("share") + F.col("part") * (c + 0.5))).alias("s2"))
    out = own.join(sums, "key", "left").join(rest, "key", "left")
    or0 = lambda x: F.coalesce(x, F.lit(0))
    return out.select(F.col("ids").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + or0("known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + or0("logs")).alias("base_score"), (F.col("score") + or0("s") + or0("s2")).alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
