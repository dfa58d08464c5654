"""Near-duplicate documents by MinHash with sequential Bayesian verification (operator 4).

1. Exact copies (equal word sequences) form classes; only classes go on.
2. 128 minimum hashes of a class's five-word shingles give 32 bands of four.
   A pair at the threshold shares no band with a probability of 5e-6.
3. Classes that share a band are compared with the bucket's hub, the member
   that shares most buckets.  Members of a hub that are still in different
   components are compared where they share a shingle the hub lacks, or where
   the hub's shingles alone could link them, and where bit sketches of what
   each lacks of the hub and has beside it leave the threshold in reach; other
   pairs can't reach it.  So groups of copies cost a few comparisons a member,
   not one a pair, and no pair of a bucket is left out.
4. A pair's signatures are compared in batches.  With a uniform prior, m
   matches in n give the posterior Beta(m + 1, n - m + 1) of the similarity; a
   pair is dropped once the probability of reaching the threshold is below
   ``miss``.
5. Survivors are checked on their full shingle sets; components of the checked
   links follow by large-star and small-star steps.

Defined results: a null text or one without words has no shingles and no links
(its component is itself); repeated rows and copies share a component; a null
id takes part, but never names a component; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgelab.llm.common import binary_rows, discard, list_rows, materialise, mix, ngram_hashes, span_hashes, table, text_chunks, utf8, words_of

SHINGLE = 5
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
BATCH = 16
SKETCH = 8  # words of 64 bits
_rng = np.random.default_rng(4)
_XOR = _rng.integers(0, 1 << 32, (PERMUTATIONS, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, (PERMUTATIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if len(h) >= SHINGLE:
        return np.unique(ngram_hashes(h, SHINGLE))
    return span_hashes(h, np.array([0]), np.array([len(h)])) if len(h) else h


def signature(found: np.ndarray) -> np.ndarray:
    x, least = (found >> np.uint64(32)).astype(np.uint32), np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[None, i : i + 1024] ^ _XOR) * _MUL).min(axis=1), out=least)
    return least


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    s = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    high = mix(s[:, :, 0] << np.uint64(32) | s[:, :, 1])
    return mix((high + _BAND) ^ (s[:, :, 2] << np.uint64(32) | s[:, :, 3]))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in text_chunks(batch.column(2)):
            w = words_of(buf, offsets, lower=True)
            n_docs, first = hi - lo, w.first
            sizes = np.zeros(n_docs, dtype=np.int64)
            sigs = np.zeros((n_docs, PERMUTATIONS), dtype=np.uint32)
            for d in np.flatnonzero(w.counts()):
                found = shingles(w.hash[first[d] : first[d + 1]])
                sizes[d] = len(found)
                sigs[d] = signature(found)
            cid = span_hashes(w.hash, first[:-1], first[1:], salt=1)
            some = sizes > 0
            bands = band_hashes(sigs[some])
            lengths = np.where(some, BANDS, 0)
            columns = [batch.column(0).slice(lo, n_docs), batch.column(1).slice(lo, n_docs), pa.array(sizes), pa.array(cid.view(np.int64)), list_rows(bands.reshape(-1).view(np.int64), lengths, pa.int64()), binary_rows((sigs & np.uint32(0xFFFF)).astype(np.uint16))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "n", "cid", "bands", "sig"])


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n compared, matches needed to go on): P(similarity >= threshold | m of n) >= miss."""
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        m, tail = 0, (1 - threshold) ** (n + 1)  # P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _bayes(needed: list[tuple[int, int]], part: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n1, n2 = b.column(2).to_numpy(), b.column(3).to_numpy()
            alive = np.flatnonzero(np.minimum(n1, n2) * part[1] >= np.maximum(n1, n2) * part[0])
            width = PERMUTATIONS * 2
            left, right = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint16).reshape(-1, width // 2) for c in (b.column(4), b.column(5)))
            matches, done = np.zeros(b.num_rows, dtype=np.int64), 0
            for n, least in needed:
                matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive))], names=["a", "b"])

    return run


def _with_cid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cid wanted, text) whose text has that class."""
    for batch in batches:
        for lo, hi, buf, offsets in text_chunks(batch.column(1)):
            w = words_of(buf, offsets, lower=True)
            cid = span_hashes(w.hash, w.first[:-1], w.first[1:], salt=1).view(np.int64)
            same = pa.array(np.flatnonzero(cid == batch.column(0).slice(lo, hi - lo).to_numpy()) + lo)
            yield pa.RecordBatch.from_arrays([c.take(same) for c in batch.columns], names=["cid", "text"])


def _exact(part: tuple[int, int]):
    def of(text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, dtype=np.uint8)
        return shingles(words_of(raw, np.array([0, len(raw)]), lower=True).hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0)
        for b in batches:
            a, good = b.column(0).to_numpy(), []
            for i in range(b.num_rows):
                if a[i] != last:  # rows of a hub follow each other
                    last, left = a[i], of(b.column(2)[i].as_py())
                right = of(b.column(3)[i].as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                if part[1] * both >= part[0] * (len(left) + len(right) - both):
                    good.append(i)
            keep = pa.array(good, type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    return run


def sketch(found: np.ndarray) -> np.ndarray:
    """The bits, of 64 * SKETCH, that the shingles set."""
    bits, at = np.zeros(SKETCH, dtype=np.uint64), (found >> np.uint64(7)) % np.uint64(64 * SKETCH)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits.view(np.int64)


def _beside_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (hub, member, root, hub's text, member's text): sizes, common shingles, the member's others, and sketches.

    The sketches are of the hub's shingles that the member lacks, and of the member's that the hub lacks.
    """

    def of(text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, dtype=np.uint8)
        return shingles(words_of(raw, np.array([0, len(raw)]), lower=True).hash)

    last, hub = None, np.empty(0)
    for b in batches:
        a, sizes, rests = b.column(0).to_numpy(), np.zeros((b.num_rows, 3), dtype=np.int64), []
        bits = np.zeros((2, b.num_rows, SKETCH), dtype=np.int64)
        for i in range(b.num_rows):
            if a[i] != last:
                last, hub = a[i], of(b.column(3)[i].as_py())
            mine = of(b.column(4)[i].as_py())
            rest = np.setdiff1d(mine, hub, assume_unique=True)
            sizes[i] = len(hub), len(mine), len(mine) - len(rest)
            bits[0, i], bits[1, i] = sketch(np.setdiff1d(hub, mine, assume_unique=True)), sketch(rest)
            rests.append(rest.view(np.int64))
        flat = np.concatenate(rests) if rests else np.empty(0, dtype=np.int64)
        lists = list_rows(flat, np.array([len(r) for r in rests], dtype=np.int64), pa.int64())
        sketches = [list_rows(x.reshape(-1), np.full(b.num_rows, SKETCH), pa.int64()) for x in bits]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(sizes[:, j]) for j in range(3)), lists, *sketches], names=["a", "b", "root", "hub_n", "n", "k", "rest", "lacks", "own"])


def _far_pairs(core: DataFrame, part: tuple[int, int]) -> DataFrame:
    """Pairs of a hub's members in different components that can still reach the threshold.

    Two members have min(k1, k2) shingles of the hub in common at most.  So they
    reach it only if they share a shingle outside the hub, or if that bound
    alone suffices, which takes a member smaller than the hub.  Neither kind
    grows with the square of a group of copies of one text.

    Sketches bound what they share more closely: of the hub's shingles those
    that neither lacks, each bit set by either standing for one lacked at least;
    of the others, those of a member but one for each bit that only it sets.
    """
    p, q = part

    def bits(of) -> Column:
        return sum(F.bit_count(of(i)) for i in range(SKETCH))

    def common() -> Column:
        """The most shingles that the two can share."""
        l1, l2, o1, o2 = (lambda i, c=c: F.col(c)[i] for c in ("lacks1", "lacks2", "own1", "own2"))
        of_hub = F.least("k1", "k2", F.col("hub_n") - bits(lambda i: l1(i).bitwiseOR(l2(i))))
        only1, only2 = bits(lambda i: o1(i).bitwiseAND(F.bitwise_not(o2(i)))), bits(lambda i: o2(i).bitwiseAND(F.bitwise_not(o1(i))))
        return of_hub + F.least(F.col("n1") - F.col("k1") - only1, F.col("n2") - F.col("k2") - only2)

    def reaches(shared):  # shared / (n1 + n2 - shared) >= p / q
        return (p + q) * shared >= p * (F.col("n1") + F.col("n2"))

    row = ["b", "root", "n", "k", "lacks", "own"]
    one, two = (core.select("a", *([] if side == 1 else ["hub_n"]), *[F.col(c).alias(f"{c}{side}") for c in row]) for side in (1, 2))
    outside = core.select("a", "b", "root", "n", "k", F.explode("rest").alias("x"))
    # To reach p / q of its own size a member must share `need` shingles outside the hub; so it
    # shares one of its rarest, as many as leave fewer than `need` over.
    kinds = outside.groupBy("a", "x").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("f", "x"))  # one document's shingles
    need = F.greatest(F.ceil(p * F.col("n") / q) - F.col("k"), F.lit(1))
    ranked = outside.join(kinds, ["a", "x"]).withColumn("place", place).filter(F.col("place") <= F.col("n") - F.col("k") - need + 1)
    outside = ranked.filter("lo < hi").select("a", "b", "x")
    left, right = (outside.withColumnRenamed("b", f"b{side}").join(x, ["a", f"b{side}"]) for side, x in ((1, one), (2, two)))
    meet = left.join(right, ["a", "x"]).filter((F.col("b1") < F.col("b2")) & (F.col("root1") != F.col("root2")) & reaches(common()))
    least = core.groupBy("a").agg(F.min("n").alias("least"))
    could = one.join(least, "a").filter((p + q) * F.col("k1") >= p * (F.col("n1") + F.col("least")))
    small = two.filter("n2 < hub_n")
    count = could.join(small, "a").filter((F.col("root1") != F.col("root2")) & reaches(F.least("k1", "k2")) & reaches(common()))
    ordered = [F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b")]
    return meet.select(*ordered).union(count.select(*ordered)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.u", "e.v").filter("u > v").distinct(), "edges")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(e)
        e = after
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", part: tuple[int, int] = (75, 100), miss: float = 1e-7) -> DataFrame:
    """id, n_shingles, component_id, kept for every row; linked if intersection / union >= part[0] / part[1]."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), utf8(text).alias("text")).select("id", F.xxhash64("text").alias("th"), "text")
    sigs = materialise(source.mapInArrow(_signed, f"id {id_type}, th bigint, n bigint, cid bigint, bands array<bigint>, sig binary"), "signatures")
    some = sigs.filter("n > 0")
    # One row a class: a row that stands for it (its id, if any has one, and its text's hash), set size and signature.
    classes = some.groupBy("cid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("x"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(classes.select("cid", F.col("x.id").alias("label"), "x.th", "n", "sig"), "classes")
    banded = some.select("cid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi").select("band")
    members = materialise(banded.join(shared, "band", "left_semi").distinct(), "members")
    rep, classes = classes.select("cid", "n", "sig"), classes.select("cid", "label", "th")
    needed = least_matches(part[0] / part[1], miss)

    nodes = members.select("cid").distinct().join(classes, "cid").select("cid", "label", F.col("th").alias("h"))
    mine = source.join(nodes, (source.th == nodes.h) & source.id.eqNullSafe(nodes.label)).select("cid", "text")
    texts = materialise(mine.mapInArrow(_with_cid, "cid bigint, text binary").dropDuplicates(["cid"]), "texts")
    classes = classes.select("cid", "label")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = rep.toDF("a", "n1", "s1"), rep.toDF("b", "n2", "s2")
        likely = pairs.join(right, "b").join(left, "a").select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(_bayes(needed, part), "a bigint, b bigint")
        likely = materialise(likely.distinct(), "likely")
        both = likely.join(texts.toDF("b", "t2"), "b").join(texts.toDF("a", "t1"), "a").select("a", "b", "t1", "t2")
        return materialise(both.mapInArrow(_exact(part), "a bigint, b bigint").distinct(), "links")

    # The hub of a bucket: the member that shares most buckets with others.
    sizes = members.groupBy("band").agg(F.count("*").alias("k"))
    degree = members.join(sizes, "band").groupBy("cid").agg(F.sum("k").alias("k"))
    hub = members.join(degree, "cid").groupBy("band").agg(F.max(F.struct("k", "cid")).alias("x")).select("band", F.col("x.cid").alias("a"))
    spokes = materialise(members.join(hub, "band").filter("a <> cid").select("a", F.col("cid").alias("b")).distinct(), "spokes")
    links = verified(spokes)
    roots = materialise(components(links), "roots")
    rooted = roots.toDF("cid", "root")
    of_b = spokes.join(rooted.withColumnRenamed("cid", "b"), "b", "left").select("a", "b", F.coalesce("root", "b").alias("root"))
    of_a = of_b.join(rooted.toDF("a", "own"), "a", "left").select("a", "b", "root", F.coalesce("own", "a").alias("own"))
    apart = of_a.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("a")
    apart = materialise(of_b.join(apart, "a", "left_semi"), "apart")
    if not apart.isEmpty():
        core = apart.join(texts.toDF("b", "t2"), "b").join(texts.toDF("a", "t1"), "a").select("a", "b", "root", "t1", "t2")
        core = materialise(core.mapInArrow(_beside_hub, "a bigint, b bigint, root bigint, hub_n bigint, n bigint, k bigint, rest array<bigint>, lacks array<bigint>, own array<bigint>"), "beside-hub")
        pairs = materialise(_far_pairs(core, part), "far-pairs")
        more = verified(pairs)
        roots = materialise(components(links.unionByName(more)), "roots")

    named = classes.join(roots.toDF("cid", "root"), "cid", "left").select("cid", "label", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("label").alias("component_id"))
    named = named.join(least, "root").select("cid", "component_id")
    out = sigs.select("id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(named, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
