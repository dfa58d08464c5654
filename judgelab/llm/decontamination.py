"""Benchmark decontamination by templates (operator 6).

Texts and benchmark items are read as template words: numbers, names and units
become typed placeholders, other words are lower-cased without marks around
them.  An item leaks into a document if at least ``part`` of its five-word
template windows occur there and its slots are filled consistently: the same
item value is always replaced by the same document value.  So re-parameterised
copies of a question are caught as well as literal ones.

Items that differ in their slots' values alone are one class: they share all
windows, and what decides is which of their slots are equal, so a document is
paired with the class and checked once.  ``item_classes`` tells the members.

Windows meet by their hashes in a join.  An item of n windows that leaks shares
at least one of its floor(n * (1 - part)) + 1 rarest windows, so only those, the
seeds, are joined.  A bit filter of the seeds, of one fixed size (``FILTER``
bits), goes to all tasks, and only document windows that pass it reach the join;
a large benchmark lets more of them pass, but none is lost.  Candidate pairs are
then checked on their texts.  Equal texts are judged once, by a 64-bit hash.

Defined results: a null text or one without words is clean; null, empty and
repeated items are ignored, equal items are of one class; an item of
fewer than five words is one window; repeated documents are judged one by one;
an empty benchmark leaves every document clean.  Added columns replace clashing
ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgelab.llm.common import Words, byte_span_hashes, inside_doc, materialise, ngram_hashes, span_hashes, table, text_chunks, words_of

WINDOW = 5
FILTER = 1 << 26
_PIECE = 1 << 16
#: Rows of a key table that may be broadcast; a larger one is joined by shuffle.
FEW = 100_000

# Units of measure and of money.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "km/h mph kmh hz khz mhz ghz w kw mw v kv b kb mb gb tb percent % ° °c °f usd eur gbp dollar dollars euro euros cent cents"
).split()

_digit = np.zeros(256, dtype=bool)
_digit[48:58] = True
_alpha = np.zeros(256, dtype=bool)
_alpha[65:91] = _alpha[97:123] = _alpha[128:] = True
_core = _digit | _alpha
_core[[ord("%")]] = True
_stop = np.zeros(256, dtype=bool)
_stop[[ord(c) for c in ".!?:"]] = True
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x6E756D, 0x756E6974, 0x6E616D65))
_UNIT_HASHES = np.sort(words_of(np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8), np.array([0, len(" ".join(UNITS).encode())]), lower=True).hash)


@dataclass
class Template:
    """Template words of a run of documents: ``word`` is a placeholder or the literal, ``raw`` the literal."""

    word: np.ndarray
    raw: np.ndarray
    slot: np.ndarray
    first: np.ndarray


def _lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters U+00C0 to U+00DE."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    lead = np.flatnonzero(buf[:-1] == 0xC3) + 1
    out[lead[(buf[lead] >= 0x80) & (buf[lead] <= 0x9E) & (buf[lead] != 0x97)]] += 32
    return out


def templates(buf: np.ndarray, offsets: np.ndarray) -> Template:
    w: Words = words_of(buf, offsets, lower=False)
    inner = np.flatnonzero(_core[buf])
    lo, hi = np.searchsorted(inner, w.start), np.searchsorted(inner, w.end)
    some = np.flatnonzero(hi > lo)
    start, end = inner[lo[some]], inner[hi[some] - 1] + 1
    first = np.searchsorted(some, w.first)
    raw = byte_span_hashes(_lowered(buf), start, end)
    digits, letters = (np.concatenate(([0], np.cumsum(k[buf]))) for k in (_digit, _alpha))
    number = (digits[end] > digits[start]) & (letters[end] - letters[start] <= 2)
    at = np.minimum(np.searchsorted(_UNIT_HASHES, raw), len(_UNIT_HASHES) - 1)
    unit = (_UNIT_HASHES[at] == raw) & np.concatenate(([False], number[:-1]))  # a unit follows a number
    head = buf[start]
    after = buf[np.minimum(start + 1, len(buf) - 1)] if len(buf) else head
    capital = ((head >= 65) & (head <= 90) & ~((after >= 65) & (after <= 90))) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    # Not a name: the first word of a document, of a line or after the end of a sentence.
    fresh = np.ones(len(some), dtype=bool)
    if len(some) > 1:
        lines = np.concatenate(([0], np.cumsum(buf == 10)))
        fresh[1:] = _stop[buf[w.end[some[:-1]] - 1]] | (lines[start[1:]] > lines[w.end[some[:-1]]])
    fresh[first[:-1][first[:-1] < len(some)]] = True
    name = capital & ~fresh & ~number
    word = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, raw)))
    return Template(word, raw, number | unit | name, first)


@dataclass
class Item:
    word: np.ndarray
    raw: np.ndarray
    slot: np.ndarray
    hashes: np.ndarray


def item_of(text: bytes) -> Item:
    buf = np.frombuffer(text, dtype=np.uint8)
    t = templates(buf, np.array([0, len(buf)]))
    n = len(t.word)
    whole = n >= WINDOW or not n
    return Item(t.word, t.raw, t.slot, ngram_hashes(t.word, WINDOW) if whole else span_hashes(t.word, np.array([0]), np.array([n])))


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, item, body): an item with its class, a hash of its template words and of which slots have equal values."""
    for batch in batches:
        keys = []
        for text in batch.column("body").to_pylist():
            item = item_of(text)
            first = np.unique(item.raw[item.slot], return_index=True, return_inverse=True)
            equal = first[1][first[2]] if len(first[0]) else np.empty(0, dtype=np.int64)  # where a slot's value first stood
            keys.append(int.from_bytes(hashlib.blake2b(item.word.tobytes() + b"|" + equal.astype(np.int64).tobytes(), digest_size=8).digest(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(keys, pa.int64()), batch.column("body")], names=["i", "item", "body"])


def _given(benchmark: DataFrame, item_text: str, item_id: str) -> DataFrame:
    kind = benchmark.schema[item_id].dataType.simpleString()
    given = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("binary").alias("body")).filter("i IS NOT NULL AND body IS NOT NULL AND body <> X''")
    return given.mapInArrow(_classed, f"i {kind}, item bigint, body binary")


def item_classes(benchmark: DataFrame, item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, class_id): every item with the smallest id of its class."""
    given = _given(benchmark, item_text, item_id).select("i", "item")
    return given.join(given.groupBy("item").agg(F.min("i").alias("class_id")), "item").select(F.col("i").alias("item_id"), "class_id")


def _item_windows(part: tuple[int, int]):
    """(item, words, need, hash): each distinct window of an item, and how many of them are to be seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = item_of(text)
                h = np.unique(item.hashes)
                # Repeats of a window count each, so a bound over positions holds for the distinct ones as well.
                need = math.floor(len(item.hashes) * (part[1] - part[0]) / part[1]) + 1
                rows = [np.full(len(h), x, dtype=d) for x, d in ((key, np.int64), (len(item.word), np.int32), (need, np.int32))]
                yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(h.view(np.int64))], names=["item", "words", "need", "hash"])

    return run


def _packed(t: pa.Table) -> pa.Table:
    bits = np.zeros(_PIECE, dtype=np.uint8)
    bits[t.column("at").to_numpy()] = 1
    return pa.table({"piece": t.column("piece")[:1], "bits": pa.array([np.packbits(bits).tobytes()], type=pa.binary())})


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """One flag for the last bits of a hash: FILTER / 8 bytes on the driver, whatever the number of hashes."""
    at = F.col("hash").bitwiseAND(F.lit(FILTER - 1))
    pieces = hashes.select(F.floor(at / _PIECE).cast("int").alias("piece"), (at % _PIECE).cast("int").alias("at")).distinct()
    out = np.zeros(FILTER // 8, dtype=np.uint8)
    for r in pieces.groupBy("piece").applyInArrow(_packed, "piece int, bits binary").collect():
        out[r["piece"] * _PIECE // 8 : (r["piece"] + 1) * _PIECE // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _near(bits, lengths: list[int]):
    """(text, hash) of the distinct windows of a document that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, buf, offsets in text_chunks(batch.column(1)):
                t = templates(buf, offsets)
                for k in lengths:
                    n = max(0, len(t.word) - k + 1)
                    h, ok = (ngram_hashes(t.word, k) if k == WINDOW else span_hashes(t.word, np.arange(n), np.arange(n) + k)), inside_doc(t.first, k)
                    low = (h & np.uint64(FILTER - 1)).astype(np.int64)
                    near = np.flatnonzero(ok & (bits.value[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1 == 1)) if n else np.empty(0, dtype=np.int64)
                    if len(near):
                        pairs = np.unique(np.stack([np.searchsorted(t.first, near, side="right") - 1, h[near].view(np.int64)], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[lo + pairs[:, 0]]), pa.array(pairs[:, 1])], names=["text", "hash"])

    return run


def _leaks(item: Item, t: Template, lo: int, hi: int, hashes: np.ndarray, part: tuple[int, int]) -> float:
    """Share of the item's windows found in words lo:hi, or 0 if too few or inconsistent."""
    k = min(WINDOW, len(item.word))
    order = np.argsort(hashes, kind="stable")
    left = np.searchsorted(hashes[order], item.hashes, side="left")
    right = np.searchsorted(hashes[order], item.hashes, side="right")
    found = np.flatnonzero(right > left)
    if len(found) * part[1] < len(item.hashes) * part[0]:
        return 0.0
    if item.slot.any():
        diagonal = np.median(order[left[found]] - found)
        values: dict[int, set[int]] = {}
        for i in found:
            places = order[left[i] : right[i]]
            p = int(places[np.abs(places - i - diagonal).argmin()])
            for j in range(k):
                if item.slot[i + j]:
                    values.setdefault(int(item.raw[i + j]), set()).add(int(t.raw[lo + p + j]))
        steady = sum(len(v) == 1 for v in values.values())
        if steady * part[1] < len(values) * part[0]:
            return 0.0
    return len(found) / len(item.hashes)


def share_of(item: Item, t: Template, part: tuple[int, int]) -> float:
    """Share of the item found in the one document of ``t``, or 0 if it doesn't leak into it."""
    k = min(WINDOW, len(item.word))
    n = len(t.word) - k + 1
    if not k or n <= 0:
        return 0.0
    h = ngram_hashes(t.word, k) if k == WINDOW else span_hashes(t.word, np.arange(n), np.arange(n) + k)
    return _leaks(item, t, 0, len(t.word), h, part)


def _checked(part: tuple[int, int]):
    """(text, item, share) of the candidate pairs (text, item, item's text, document's text) that leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, None
        for batch in batches:
            share = np.zeros(batch.num_rows)
            for i, (key, item, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                if key != last:  # pairs of one text follow each other
                    buf = np.frombuffer(raw.as_py(), dtype=np.uint8)
                    last, t = key, templates(buf, np.array([0, len(buf)]))
                share[i] = share_of(item_of(item), t, part)
            some = pa.array(np.flatnonzero(share))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(share[share > 0])], names=["text", "item", "share"])

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def leaks(texts: DataFrame, items: DataFrame, part: tuple[int, int]) -> DataFrame:
    """(text, item, share) from (text, body) and (item, body), bodies in bytes, one row a class: hashes of texts and the classes that leak into them."""
    sc, kinds = texts.sparkSession.sparkContext, items
    windows = materialise(kinds.mapInArrow(_item_windows(part), "item bigint, words int, need int, hash bigint"), "item-windows")
    rarity = windows.groupBy("hash").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("times", "hash"))  # one item's windows
    seeds = materialise(windows.join(rarity, "hash").withColumn("place", place).filter("place <= need").select("hash", "item"), "seeds")
    lengths = sorted({WINDOW, *(r[0] for r in windows.filter(f"words < {WINDOW}").select("words").distinct().collect())})
    near = texts.mapInArrow(_near(sc.broadcast(bit_filter(seeds)), lengths), "text bigint, hash bigint")
    pairs = materialise(near.join(seeds, "hash").select("text", "item").distinct(), "candidates")
    wanted = texts.join(_few(pairs.select("text").distinct()), "text", "left_semi").dropDuplicates(["text"])
    both = pairs.join(kinds.select("item", F.col("body").alias("a")), "item").join(wanted.select("text", F.col("body").alias("b")), "text")
    return both.select("text", "item", "a", "b").mapInArrow(_checked(part), "text bigint, item bigint, share double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", part: tuple[int, int] = (75, 100)) -> DataFrame:
    """All columns of ``docs``, ``leaks`` array<struct<item_id, n_items, share>> and ``contaminated`` boolean.

    A leak names a class of items by its smallest id, and how many items it has.
    """
    names = [c for c in docs.columns if c not in ("leaks", "contaminated", "__text")]
    kind = benchmark.schema[item_id].dataType.simpleString()
    kinds = materialise(_given(benchmark, item_text, item_id).groupBy("item").agg(F.min("i").alias("i"), F.count("*").alias("n"), F.min_by("body", "i").alias("body")), "item-classes")
    texts = docs.select(F.xxhash64(text).alias("text"), F.col(text).cast("binary").alias("body")).filter("body IS NOT NULL")
    found = leaks(texts, kinds.select("item", "body"), part).join(kinds.select("i", "n", "item"), "item")
    by_text = materialise(found.groupBy(F.col("text").alias("__text")).agg(F.collect_list(F.struct(F.col("i").alias("item_id"), F.col("n").alias("n_items"), "share")).alias("__leaks")), "leaks")
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(text).alias("__text"))
    none = F.array().cast(f"array<struct<item_id:{kind},n_items:bigint,share:double>>")
    out = keyed.join(_few(by_text), "__text", "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("__leaks", none).alias("leaks"))
    return out.withColumn("contaminated", F.size("leaks") > 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (~F.col("contaminated")).alias("kept"), "contaminated", F.array_sort(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["share"])), F.lit(0.0)).alias("max_share"))
