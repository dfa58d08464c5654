"""Removal of repeated passages with an FM-index per shard (operator 3).

A window is ``WINDOW`` consecutive words of one document; words covered by a
window that also starts elsewhere go.

1. The anchor of a window is its ``ANCHOR``-word run of least hash.  Equal
   windows have equal anchors, so what can match meets by anchor.  Successive
   windows with one anchor form a segment.
2. Segments whose anchor occurs once are unique.  Where all segments of an
   anchor are alike, all their windows repeat.
3. The other distinct segments are sharded by anchor.  Each shard is indexed by
   a compressed FM-index (Burrows-Wheeler transform of the segments' words in a
   wavelet matrix of packed bits).  Backward search over all segments gives
   their matching statistics: the longest run ending at each word that occurs
   twice or more; windows whose run reaches ``WINDOW`` words repeat.
4. Repeated windows go back to their documents as intervals.

Shards are as many as the text to be indexed needs: ``SHARD_WORDS`` each on
average.  An anchor with more words than that is not one shard: its windows go
one by one to shards by the hash of all their words, where equal windows are
counted first and one of them is indexed with its count; what repeats is joined
back to its places.  So a shard holds unlike windows only, however many
documents share a passage.  Equal segments are counted, not gathered.  Words, anchors and segments
are compared by 64-bit hashes.

Defined results: a null or empty text has 0 words and the hash of the empty
text; a document of fewer than ``WINDOW`` words loses nothing; in copies and
repeated rows every window repeats; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.llm.common import discard, inside_doc, list_rows, materialise, ngram_hashes, span_hashes, table, text_chunks, utf8, words_of

WINDOW, ANCHOR = 35, 12
SHARD_WORDS = 200_000
#: Backward search starts from the interval of this many words, which sorting has found already.
FIRST = 16


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(document, first window, windows, anchor hash, segment hash) of a run of documents; positions count from its first word."""
    n = len(h)
    empty = np.empty(0, dtype=np.int64)
    if n < window:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = ngram_hashes(h, anchor, salt=3)
    place, width, want = np.arange(len(grams)), 1, window - anchor + 1
    while width < want:  # place[i]: leftmost least hash among `width` grams from i
        step = min(width, want - width)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(grams[left] <= grams[right], left, right)
        width += step
    starts = np.flatnonzero(inside_doc(first, window))
    if not len(starts):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    at = place[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(starts)))
    lo = starts[begin]
    return np.searchsorted(first, lo, side="right") - 1, lo, count, grams[at[begin]], span_hashes(h, lo, lo + count + window - 1, salt=4)


def _segmented(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(1)):
                w = words_of(buf, offsets, lower=False)
                doc, at, count, anchors, segs = segments(w.hash, w.first, window, anchor)
                n = np.bincount(doc, minlength=hi - lo)
                lists = [(at - w.first[doc], pa.int32()), (count, pa.int32()), (anchors.view(np.int64), pa.int64()), (segs.view(np.int64), pa.int64())]
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([c.take(some) for c in (batch.column(0).slice(lo, hi - lo), *(list_rows(x, n, k) for x, k in lists))], names=["key", "at", "n", "anchor", "seg"])

    return run


# --- the index --------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks of symbols in a sequence: a packed bit vector a level, with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.words.append(packed)
            self.blocks.append(ones[:-1])
            self.zeros.append(len(bit) - int(ones[-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))
        kinds = np.arange(top + 1)
        self.start = self._down(kinds, np.zeros(top + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block, inside = i >> 6, (i & 63).astype(np.uint64)
            mask = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.blocks[k][block] + np.bitwise_count(self.words[k][block] & mask)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``i``."""
        return self._down(symbol, i) - self.start[symbol]


class FMIndex:
    """Of word sequences, each closed by a mark; sorted by as many words as a window can need."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.text = text
        rank = np.searchsorted(np.sort(text), text)  # first place among equals
        self.first_rank, width = rank if FIRST == 1 else None, 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            follow = np.full(n, -1, dtype=np.int64)
            follow[: n - width] = rank[width:]
            key = rank * np.int64(n + 1) + follow + 1
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            new = np.ones(n, dtype=bool)
            new[1:] = sorted_[1:] != sorted_[:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            width *= 2
            if width == FIRST:
                self.first_rank = rank
        self.size = np.bincount(self.first_rank, minlength=n)
        top = int(text.max(initial=0))
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.wavelet = WaveletMatrix(text[order - 1], top)

    def matching(self, ends: np.ndarray, longest: int) -> np.ndarray:
        """Longest run, up to ``longest`` words, that ends at each place and occurs twice or more (0 if under FIRST)."""
        at = ends - (FIRST - 1)
        lo = self.first_rank[at]
        hi = lo + self.size[lo]
        out = np.zeros(len(ends), dtype=np.int64)
        live = np.flatnonzero(hi - lo >= 2)
        out[live] = FIRST
        lo, hi, at = lo[live], hi[live], at[live]
        for length in range(FIRST + 1, longest + 1):
            at = at - 1
            c = self.text[at]
            lo, hi = self.below[c] + self.wavelet.rank(c, lo), self.below[c] + self.wavelet.rank(c, hi)
            on = np.flatnonzero(hi - lo >= 2)
            live, lo, hi, at = live[on], lo[on], hi[on], at[on]
            out[live] = length
            if not len(live):
                break
        return out


def _indexed(window: int):
    def run(t: pa.Table) -> pa.Table:
        """Repeated windows of a shard's segments (seg, off, times, words): (seg, first window, last window)."""
        seg, off, times = (t.column(c).to_numpy() for c in ("seg", "off", "times"))
        words = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("words")]
        size = np.array([len(x) for x in words])
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        flat = np.concatenate(words)
        text = np.zeros(int((size + 1).sum()), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[begin + size] = False
        text[inside] = np.unique(flat, return_inverse=True)[1] + 1
        count = size - window + 1
        owner = np.repeat(np.arange(len(seg)), count)
        ends = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) + window - 1
        again = times[owner] > 1
        once = np.flatnonzero(~again)
        if len(once):
            again[once] = FMIndex(text, window).matching(ends[once], window) >= window
        window_no = ends - (window - 1) - begin[owner]
        hit = np.flatnonzero(again)
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(hit))[: len(a)] - 1
        of = owner[hit[a]]
        return pa.table({"seg": seg[of], "lo": off[of] + window_no[hit[a]], "hi": off[of] + window_no[hit[z]], "shard": np.full(len(a), t["shard"][0].as_py())})

    return run


# --- documents --------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    codec = pa.Codec("zstd")
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(batch.num_columns - 1)]
        data = [codec.compress(x, asbytes=True) for x in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in texts], type=pa.int64()), pa.array(data, type=pa.binary())], names=[*batch.schema.names[:-1], "size", "data"])


def _unpack(size: pa.Scalar, data: pa.Scalar) -> bytes:
    return pa.Codec("zstd").decompress(data.as_py(), size.as_py(), asbytes=True)


def _fetched(window: int, hot_shards: int):
    """Words of the wanted segments of each document: (shard, seg, off, times, hash, words); of a hot anchor, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(_unpack(batch.column("size")[i], batch.column("data")[i]), dtype=np.uint8)
                h = words_of(raw, np.array([0, len(raw)]), lower=False).hash
                rows: list[tuple] = []
                for x in batch.column("want")[i].as_py():
                    mine = h[x["at"] : x["at"] + x["words"]]
                    if x["shard"] >= 0:
                        rows.append((x["shard"], x["seg"], 0, x["times"], 0, mine.tobytes()))
                    else:
                        at = np.arange(len(mine) - window + 1)
                        whole = span_hashes(mine, at, at + window, salt=5)
                        shard = -1 - (whole % np.uint64(hot_shards)).astype(np.int64)
                        rows += [(k, x["seg"], o, x["times"], w, mine[o : o + window].tobytes()) for o, (k, w) in enumerate(zip(shard.tolist(), whole.view(np.int64).tolist(), strict=True))]
                kinds = (*[pa.int64()] * 5, pa.binary())
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "seg", "off", "times", "hash", "words"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for i in range(batch.num_rows):
                words = _unpack(batch.column("size")[i], batch.column("data")[i]).split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for x in batch.column("gone")[i].as_py() or ():
                    gone[x["lo"]] += 1
                    gone[x["hi"]] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                if covered.any():
                    n = len(words)
                    words = [words[k] for k in np.flatnonzero(~covered)]
                    n_words.append(n)
                else:
                    n_words.append(len(words))
                n_removed.append(n_words[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(digests, type=pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    return run


def distinct_windows(words: DataFrame) -> DataFrame:
    """(shard, hash, words, times, seg, off): the unlike windows of hot anchors, how often each occurs, and one place of it."""
    found = words.filter("shard < 0").groupBy("shard", "hash", "words").agg(F.sum("times").alias("times"), F.min(F.struct("seg", "off")).alias("x"))
    return found.select("shard", "hash", "words", "times", "x.seg", "x.off")


def repeated_intervals(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, gone): word intervals lo:hi of each document that repeated windows cover; key is the hash of id and text."""
    keyed = docs.select(_key(id_col, text), utf8(text).alias("text"))
    found = materialise(keyed.mapInArrow(_segmented(window, anchor), "key bigint, at array<int>, n array<int>, anchor array<bigint>, seg array<bigint>"), "segments")
    rows = found.select("key", F.explode(F.arrays_zip("at", "n", "anchor", "seg")).alias("x")).select("key", "x.at", "x.n", "x.anchor", "x.seg")
    shared = rows.groupBy("anchor").agg(F.count("*").alias("times"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).filter("times > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    shared = materialise(shared, "shared-anchors")  # both sides of the join are then dealt out anew, and a hot anchor is split
    some = materialise(rows.join(shared, "anchor"), "shared-segments")
    discard(found)
    kinds = some.filter("mixed").groupBy("anchor", "seg").agg(F.count("*").alias("times"), F.min(F.struct("key", "at", "n")).alias("x"))
    kinds = materialise(kinds.select("anchor", "seg", "times", "x.key", "x.at", (F.col("x.n") + window - 1).alias("words")), "kinds")
    by_anchor = kinds.groupBy("anchor").agg(F.sum("words").alias("volume"), (F.sum(F.col("words") - window + 1) * window).alias("by_window"))
    hot = F.col("volume") > shard_words
    volume = by_anchor.agg(F.coalesce(F.sum(F.when(~hot, F.col("volume"))), F.lit(0)), F.coalesce(F.sum(F.when(hot, F.col("by_window"))), F.lit(0))).first()
    shards, hot_shards = (max(1, -(-v // shard_words)) for v in volume)
    shard = F.pmod("anchor", F.lit(shards))
    if volume[1]:  # not more anchors than volume / shard_words
        kinds = kinds.join(by_anchor.filter(hot).select("anchor", F.lit(True).alias("hot")), "anchor", "left")
        shard = F.when(F.col("hot"), F.lit(-1)).otherwise(shard)
    want = kinds.groupBy("key").agg(F.collect_list(F.struct(shard.alias("shard"), "seg", "times", "at", "words")).alias("want"))
    texts = keyed.mapInArrow(_packed, "key bigint, size bigint, data binary")
    words = texts.join(want, "key").mapInArrow(_fetched(window, hot_shards), "shard bigint, seg bigint, off bigint, times bigint, hash bigint, words binary")
    words = words.dropDuplicates(["shard", "seg", "off"])
    if volume[1]:
        words = materialise(words, "words")
        indexed = words.filter("shard >= 0").select("shard", "seg", "off", "times", "words").unionByName(distinct_windows(words).select("shard", "seg", "off", "times", "words"))
    else:
        indexed = words.select("shard", "seg", "off", "times", "words")
    hits = materialise(indexed.groupBy("shard").applyInArrow(_indexed(window), "seg bigint, lo bigint, hi bigint, shard bigint"), "repeated-windows")
    if volume[1]:  # a repeated window of a hot anchor stands for all of its places
        again = hits.filter("shard < 0").select("seg", F.col("lo").alias("off"))
        named = distinct_windows(words).join(again, ["seg", "off"], "left_semi").select("shard", "hash", F.col("words").alias("same"))
        places = words.filter("shard < 0").join(named, ["shard", "hash"]).filter(F.col("words") == F.col("same"))
        hits = hits.filter("shard >= 0").select("seg", "lo", "hi").unionByName(places.select("seg", F.col("off").alias("lo"), F.col("off").alias("hi")))
        hits = materialise(hits, "repeated-places")
    whole = some.filter("not mixed").select("key", F.col("at").alias("lo"), (F.col("at") + F.col("n") + window - 1).alias("hi"))
    part = some.filter("mixed").join(hits, "seg").select("key", (F.col("at") + F.col("lo")).cast("int").alias("lo"), (F.col("at") + F.col("hi") + window).cast("int").alias("hi"))
    return whole.unionByName(part).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))  # each interval once, however often a row repeats


def _key(id_col: str, text: str):
    return F.xxhash64(F.col(id_col), F.col(text)).alias("key")


def without_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    gone = materialise(repeated_intervals(docs, text, id_col, window, shard_words=shard_words), "intervals")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(_key(id_col, text), F.col(id_col).alias("id"), utf8(text).alias("text")).mapInArrow(_packed, f"key bigint, id {kind}, size bigint, data binary")
    out = texts.join(gone, "key", "left").select("id", "size", "data", "gone").mapInArrow(_cut(window), f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
