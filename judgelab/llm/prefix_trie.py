"""Trie of conversation prefixes from the LCP array of the sorted conversations (operator 11).

1. Every turn becomes a digest of role and text and its number of words; texts
   never leave the scan.  Turns get their places by ranges, not by groups, so
   that a conversation may have any number of them.
2. Digests are packed into keys of ``PACK`` turns.  Conversations are sorted by
   their first key; what follows it in longer ones is named by ranks of keys,
   packed again, until one rank is left.
3. The LCP of neighbours compares their keys block by block.
4. All nearest smaller values of the LCP array: positions are cut into blocks;
   each block answers what it can with a stack, and the block minima tell which
   one other block holds the rest.  Equal questions of a block are asked once.
5. Two neighbours' LCP and its nearest smaller values on both sides are a node
   of the Cartesian tree; equal ones merge.  With the leaves these are the
   trie's branchings, and the depths between a node and its parent are filled in.
6. Members are intervals of positions.  The smallest member is a range minimum
   (inside a block, whole blocks between, and the ends of two more); sums over
   subtrees are differences of sums running in preorder.

Block minima are the only thing that passes through the driver: blocks grow
with the table, so that there are at most ``MOST_BLOCKS`` (16 bytes each).

Defined results: rows without a conversation id belong to none and are left
out; null roles and texts are empty; turns of equal number are ordered by the
digest of role and text; repeated turns are turns; other columns are not read;
an empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.functions.tables import running
from judgelab.llm.common import WORD, discard, materialise, ranked, table

#: Turns of one key.
PACK = 64
#: Positions of a block, at least; and blocks, at most.
BLOCK_ROWS, MOST_BLOCKS = 2048, 65536
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, p, x, w): conversation, place from 0, digest of role and text, words of the text."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    found = conversations.filter(F.col(conv).isNotNull())
    found = materialise(found.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), digest.alias("x"), F.regexp_count(t, F.lit(WORD)).alias("w"), F.monotonically_increasing_id().alias("u")), "turns")
    return materialise(ranked(found, ["c"], ["t", "x", "u"]).select("c", F.col("__at").alias("p"), "x", "w"), "turns-numbered")


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns whose first h = crc32(c) % ``most`` come from conversation c - c % ``group``, and (c, len) of all conversations."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    heads = turns.filter(F.col("p") < most - 1).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "x", "w"))).alias("head"))
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    convs = convs.join(heads, "base", "left").select("c", "n", "h", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")).alias("head"))
    convs = materialise(convs.withColumn("k", F.size("head").cast("long")), "conversations")
    shifted = convs.filter("k <> h").select("c", "k")  # only what has a shorter head is looked up
    own = turns.join(shifted, "c", "left").withColumn("h", h).filter("p >= h").select("c", (F.col("p") - F.col("h") + F.coalesce("k", "h")).alias("p"), "x", "w")
    lead = convs.select("c", F.explode("head").alias("e")).select("c", "e.p", "e.x", "e.w")
    return own.unionByName(lead), convs.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def _packed(df: DataFrame, place: str, *values: Column | str) -> DataFrame:
    """Rows (c, place, ...) as one row for ``PACK`` places: (c, g, e)."""
    g = F.floor(F.col(place) / PACK).cast("long").alias("g")
    return df.groupBy("c", g).agg(F.sort_array(F.collect_list(F.struct(place, *values))).alias("e"))


def _joined(items: Column) -> Column:
    return F.unhex(F.array_join(items, ""))


def _tails(blocks: DataFrame) -> DataFrame | None:
    """(c, tail): a rank, from 1, of all that follows a conversation's first key; None where nothing does."""
    rest = blocks.filter("g > 0").select("c", (F.col("g") - 1).alias("g"), "key")
    last = rest.agg(F.max("g")).first()[0]
    if last is None:
        return None
    while True:
        ranks = ranked(materialise(rest.select("key").distinct(), "keys"), [], ["key"]).select("key", (F.col("__at") + 1).alias("r"))
        named = rest.join(ranks, "key")
        if last == 0:
            return named.select("c", F.col("r").alias("tail"))
        named = materialise(_packed(named, "g", F.lpad(F.hex("r"), 16, "0").alias("r")), "tails")
        rest, last = named.select("c", "g", _joined(F.col("e.r")).alias("key")), last // PACK


def _alike(a: str, b: str) -> Column:
    """Number of leading digests that two keys share."""
    n = (F.least(F.length(a), F.length(b)) / 16).cast("int")
    one = lambda c, k: F.substring(F.col(c), k * 16 + 1, 16)
    first = F.array_min(F.filter(F.sequence(F.lit(0), n - 1), lambda k: one(a, k) != one(b, k)))
    return F.when(F.col(a) == F.col(b), n).otherwise(F.coalesce(first, n))


def lcp_array(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sorted conversations (i, c, len, v), v the LCP with the one before (-1 for the first), and (i, g, ws): words of their turns."""
    packed = _packed(turns, "p", F.lower(F.hex("x")).alias("x"), "w")
    blocks = materialise(packed.select("c", "g", _joined(F.col("e.x")).alias("key"), F.col("e.w").alias("ws")), "blocks")
    keys = members.join(blocks.filter("g = 0").select("c", "key"), "c", "left").select("c", "len", F.coalesce("key", F.lit(b"")).alias("key"))
    tails = _tails(blocks)
    keys = keys.join(tails, "c", "left") if tails is not None else keys.withColumn("tail", F.lit(0))
    order = ranked(materialise(keys.withColumn("tail", F.coalesce("tail", F.lit(0))), "sort-keys"), [], ["key", "tail", "c"])
    order = materialise(order.select(F.col("__at").alias("i"), "c", "len"), "order")
    placed = materialise(blocks.join(order.select("i", "c"), "c").select("i", "g", "key", "ws"), "blocks-placed")
    both = placed.select("i", "g", "key").join(placed.select((F.col("i") + 1).alias("i"), "g", F.col("key").alias("before")), ["i", "g"])
    both = both.select("i", "g", _alike("key", "before").alias("k"))
    lcp = both.groupBy("i").agg(F.coalesce(F.min(F.when(F.col("k") < PACK, F.col("g") * PACK + F.col("k"))), F.max(F.col("g") * PACK + PACK)).alias("v"))
    v = F.when(F.col("i") == 0, -1).otherwise(F.coalesce("v", F.lit(0))).cast("long")
    out = materialise(order.join(lcp, "i", "left").select("i", "c", "len", v.alias("v")), "lcp")
    discard(blocks)
    return out, placed.select("i", "g", "ws")


# --- all nearest smaller values -------------------------------------------------------------


def nearest_smaller(v: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one; -1 where there is none."""
    out, stack = np.empty(len(v), dtype=np.int64), []
    for k, x in enumerate(v.tolist()):
        while stack and stack[-1][0] >= x:
            stack.pop()
        out[k] = stack[-1][1] if stack else -1
        stack.append((x, k))
    return out


def _both_sides(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    after = nearest_smaller(v[::-1])[::-1]
    return nearest_smaller(v), np.where(after < 0, -1, len(v) - 1 - after)


def _first_below(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where ``values`` first are below each of ``x``; their number where they never are."""
    return np.searchsorted(-np.minimum.accumulate(values), -x, side="right") if len(values) else np.zeros(len(x), dtype=np.int64)


def _sorted(t: pa.Table) -> tuple[np.ndarray, ...]:
    t = t.sort_by("i")
    return tuple(t[c].to_numpy() for c in ("i", "c", "len", "v"))


def _asker(minima: np.ndarray):
    def ask(key: tuple, t: pa.Table) -> pa.Table:
        b = key[0].as_py()
        v = _sorted(t)[3]
        before, after = _both_sides(v)
        left, right = np.unique(v[(before < 0) & (v >= 0)]), np.unique(v[(after < 0) & (v >= 0)])
        down, up = b - 1 - _first_below(minima[:b][::-1], left), b + 1 + _first_below(minima[b + 1 :], right)
        right, up = right[up < len(minima)], up[up < len(minima)]  # beyond the end all is smaller
        side = np.repeat([False, True], [len(left), len(right)])
        return pa.table({"block": np.full(len(side), b, dtype=np.int64), "at": np.concatenate([down, up]), "after": side, "v": np.concatenate([left, right])})

    return ask


def _answer(key: tuple, t: pa.Table, asked: pa.Table) -> pa.Table:
    """The last (first, for ``after``) position of a block whose value is below the asked one, and its value."""
    if not len(asked) or not len(t):
        return pa.table({"at": pa.array([], pa.int64()), "after": pa.array([], pa.bool_()), "v": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
    i, _, _, v = _sorted(t)
    after, x = asked["after"].to_numpy(zero_copy_only=False), asked["v"].to_numpy()
    k = np.where(after, _first_below(v, x), len(v) - 1 - _first_below(v[::-1], x))
    return pa.table({"at": asked["at"], "after": asked["after"], "v": asked["v"], "i": i[k], "low": v[k]})


class RangeMin:
    """Minima of slices of ``values``."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            half, last = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of ``lo:hi``, not empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.rows[k][lo[m]], self.rows[k][hi[m] - (1 << k)])
        return out


_PLACES = "i long, c long, len long, v long, l long, node boolean, r long, p long, up long, low long, out_l boolean, out_r boolean, leaf_p long, leaf_up long, to_end long, from_start long"


def _filler(firsts: np.ndarray, smallest: np.ndarray, n: int, width: int):
    """All of a block: nearest smaller positions, the node each value stands for, and minima up to the block's ends.

    A node's ``up`` (left end of its parent) is -1 where the position that tells
    lies in another block, and ``low`` lacks the parts of other blocks that
    ``out_l`` and ``out_r`` name.
    """

    def fill(key: tuple, t: pa.Table, found: pa.Table) -> pa.Table:
        b = key[0].as_py()
        i, c, length, v = _sorted(t)
        start, end = int(i[0]), int(i[-1]) + 1
        (before, after), at = _both_sides(v), np.arange(len(v))
        left, right = np.where(before >= 0, before + start, -1), np.where(after >= 0, after + start, n)
        v_left, v_right = np.where(before >= 0, v[before], -1), np.where(after >= 0, v[after], -1)
        told = {(a, x): (k, low) for a, x, k, low in zip(*[found[f].to_pylist() for f in ("after", "v", "i", "low")], strict=True)}
        for k in np.flatnonzero((before < 0) & (v >= 0)):
            left[k], v_left[k] = told[False, v[k]]
        for k in np.flatnonzero((after < 0) & (v >= 0)):
            right[k], v_right[k] = told.get((True, v[k]), (n, -1))
        node = np.zeros(len(v), dtype=bool)
        some = np.flatnonzero(v >= 0)
        node[some[np.unique(np.stack([left[some], v[some]]), axis=1, return_index=True)[1]]] = True  # equal values of one interval merge
        p = np.maximum(v_left, v_right)
        inside = left >= start
        up = np.where(v_left < p, left, np.where(inside, left[np.where(inside, left - start, 0)], -1))
        out_l, out_r = node & (left < start), node & (right > end)
        low = RangeMin(c)(np.where(node, np.maximum(left - start, 0), at), np.where(node, np.minimum(right - start, len(v)), at + 1))
        for k in np.flatnonzero(out_l):
            low[k] = smallest[left[k] // width + 1 : b].min(initial=low[k])
        for k in np.flatnonzero(out_r):
            low[k] = smallest[b + 1 : (right[k] - 1) // width].min(initial=low[k])
        following = np.append(v[1:], firsts[b + 1] if b + 1 < len(firsts) else -1)
        leaf_p = np.maximum(v, following)
        cols = (i, c, length, v, left, node, right, p, up, low, out_l, out_r, leaf_p, np.where(v == leaf_p, left, i), np.minimum.accumulate(c[::-1])[::-1], np.minimum.accumulate(c))
        return pa.table(dict(zip([x.split()[0] for x in _PLACES.split(", ")], cols, strict=True)))

    return fill


def _places(order: DataFrame, n: int, block_rows: int) -> DataFrame:
    width = max(block_rows, -(-n // MOST_BLOCKS))
    order = order.withColumn("block", F.floor(F.col("i") / width).cast("long"))
    blocks = sorted(order.groupBy("block").agg(F.min("v"), F.min_by("v", "i"), F.min("c")).collect())  # at most MOST_BLOCKS rows
    minima, firsts, smallest = (np.array([b[k] for b in blocks], dtype=np.int64) for k in (1, 2, 3))
    asked = materialise(order.groupBy("block").applyInArrow(_asker(minima), "block long, at long, after boolean, v long"), "asked")
    unlike = asked.select("at", "after", "v").distinct()
    answers = order.groupBy("block").cogroup(unlike.groupBy("at")).applyInArrow(_answer, "at long, after boolean, v long, i long, low long")
    told = asked.join(answers, ["at", "after", "v"]).select("block", "after", "v", "i", "low")
    filled = order.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_filler(firsts, smallest, n, width), _PLACES)
    return materialise(filled, "places")


def branchings(places: DataFrame) -> DataFrame:
    """(l, r, v, p, up, low): member interval, depth, the parent's depth and left end, and the smallest member."""
    found = places.filter("node")
    whole = found.filter("not out_l and not out_r and up >= 0").select("l", "r", "v", "p", "up", "low")
    # A block has as many nodes that cross its ends as its ends have different depths around them.
    cross = found.filter("out_l or out_r or up < 0").select("l", "r", "v", "p", "up", "low", F.when(F.col("out_l"), F.col("l")).alias("al"), F.when(F.col("out_r"), F.col("r") - 1).alias("ar"))
    ends = places.select("i", "to_end", "from_start", F.col("l").alias("l_at"))
    cross = cross.join(ends.select(F.col("i").alias("l"), "l_at", "to_end"), "l", "left").join(ends.select(F.col("i").alias("ar"), "from_start"), "ar", "left")
    low = F.least("low", F.when(F.col("al").isNotNull(), F.col("to_end")), "from_start")
    cross = cross.select("l", "r", "v", "p", F.when(F.col("up") < 0, F.col("l_at")).otherwise(F.col("up")).alias("up"), low.alias("low"))
    inner = whole.unionByName(cross).groupBy("l", "r", "v", "p").agg(F.max("up").alias("up"), F.min("low").alias("low"))
    leaves = places.filter("len > leaf_p").select(F.col("i").alias("l"), (F.col("i") + 1).alias("r"), F.col("len").alias("v"), F.col("leaf_p").alias("p"), F.col("leaf_up").alias("up"), F.col("c").alias("low"))
    return inner.unionByName(leaves)


# --- digests of the members that end at a node -------------------------------------------------

_CHUNK = 1 << 16


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (l, d, c) as pieces of comma-joined ids: (l, d, part, k, ids)."""
    part, rows, key, ids, size, k = TaskContext.get().partitionId(), [], None, [], 0, 0

    def cut() -> None:
        nonlocal ids, size, k
        if ids:
            rows.append((*key, part, k, ",".join(ids)))
        ids, size, k = [], 0, k + 1

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([dict(zip(("l", "d", "part", "k", "ids"), r, strict=True)) for r in rows], schema=pa.schema([("l", pa.int64()), ("d", pa.int64()), ("part", pa.int64()), ("k", pa.int64()), ("ids", pa.string())]))
        rows.clear()
        return out

    for b in batches:
        for l, d, c in zip(*[b.column(f).to_pylist() for f in ("l", "d", "c")], strict=True):  # noqa: E741
            if (l, d) != key or size > _CHUNK:
                cut()
                key = (l, d)
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(rows) > 1024:
            yield batch()
    cut()
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha, rows = None, None, []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["l", "v", "ends"])
        rows.clear()
        return out

    for b in batches:
        for l, d, ids in zip(*[b.column(f).to_pylist() for f in ("l", "d", "ids")], strict=True):  # noqa: E741
            if (l, d) != key:
                if sha:
                    rows.append((*key, sha.hexdigest()))
                key, sha = (l, d), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(rows) > 4096:
            yield batch()
    if sha:
        rows.append((*key, sha.hexdigest()))
    yield batch()


def _ends(places: DataFrame, n: int) -> DataFrame:
    """(l, v, ends): digest of the ids that end at a node; a node's ids are joined in ranges, and one task reads only the pieces."""
    ended = places.select(F.when(F.col("len") > F.col("v"), F.col("i")).otherwise(F.col("l")).alias("l"), F.col("len").alias("d"), "c")
    pieces = ended.repartitionByRange(max(1, -(-n // 32768)), "l", "d", "c").sortWithinPartitions("l", "d", "c").mapInArrow(_chunks, "l long, d long, part long, k long, ids string")
    return pieces.repartition("l", "d").sortWithinPartitions("l", "d", "part", "k").mapInArrow(_digests, "l long, v long, ends string")


# --- the trie ---------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, members: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a node of the trie of ``turns`` (c, p, x, w); ``members`` (c, len) lists all conversations, also those without turns."""
    order, words = lcp_array(turns, members)
    n = order.count()
    places = _places(order, n, block_rows)
    nodes = materialise(branchings(places), "branchings")
    kids = nodes.filter("p >= 0").groupBy(F.col("up").alias("l"), F.col("p").alias("v")).agg(F.count("*").alias("kids"))
    full = nodes.join(kids, ["l", "v"], "left").join(_ends(places, n), ["l", "v"], "left")
    full = full.join(nodes.select(F.col("l").alias("up"), F.col("v").alias("p"), F.col("low").alias("up_low")), ["up", "p"], "left")
    # Depths between a node and its parent, in pieces that lie within one key each.
    full = full.withColumn("g0", F.floor((F.greatest(F.col("p") + 1, F.lit(1)) - 1) / PACK)).withColumn("g", F.explode(F.sequence("g0", F.floor((F.greatest(F.col("v"), F.lit(1)) - 1) / PACK))))
    full = full.withColumn("a", F.when(F.col("g") == F.col("g0"), F.col("p") + 1).otherwise(F.col("g") * PACK + 1)).withColumn("b", F.least(F.col("v"), F.col("g") * PACK + PACK))
    full = full.join(words.withColumnRenamed("i", "l"), ["l", "g"], "left")
    lo = F.greatest(F.col("a"), F.lit(1))
    ws = F.slice(F.coalesce("ws", F.array().cast("array<int>")), (lo - F.col("g") * PACK).cast("int"), (F.col("b") - lo + 1).cast("int"))
    ws = F.when(F.col("a") == 0, F.concat(F.array(F.lit(0)), F.when(F.col("b") > 0, ws).otherwise(F.array()))).otherwise(ws)
    full = full.withColumn("size", F.col("r") - F.col("l")).withColumn("ws", F.transform(ws, lambda w: w * (F.col("size") - 1)))
    total = F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w)
    leaf = ((F.col("b") == F.col("v")) & F.col("kids").isNull()).cast("long")
    pieces = full.select("l", "a", "r", "v", "p", "size", "low", "up_low", "kids", "ends", "ws", total.alias("saved"), leaf.alias("leaf"))
    marks = order.select("i").unionByName(order.filter("i = 0").select(F.lit(n).cast("long").alias("i")))  # before each position, and after all
    marks = marks.select(F.col("i").alias("l"), F.lit(-2).cast("long").alias("a"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"))
    run = materialise(running(materialise(pieces.unionByName(marks, allowMissingColumns=True), "preorder"), [], ["l", "a"], ["saved", "leaf"], 32768), "preorder-sums")
    upto = run.filter("a = -2").select(F.col("l").alias("r"), F.col("before_saved").alias("saved_to"), F.col("before_leaf").alias("leaf_to"))
    out = run.filter("a >= 0").join(upto, "r")
    earlier = F.transform(F.sequence(F.lit(0), F.size("ws") - 1), lambda k: F.aggregate(F.slice("ws", 1, k), F.lit(0).cast("long"), lambda s, w: s + w))
    out = out.select("*", F.posexplode(earlier).alias("k", "skipped")).withColumn("depth", F.col("a") + F.col("k"))
    bottom = F.col("depth") == F.col("v")
    return out.select(
        F.col("low").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("p") + 1, F.col("up_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("size").alias("n_convs"),
        F.when(bottom, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        (F.col("leaf_to") - F.col("before_leaf")).alias("n_leaves"),
        (F.col("saved_to") - F.col("before_saved") - F.col("skipped")).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.lit(NOTHING)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(numbered_turns(table(spark, sf_dir, "conversations"))))
