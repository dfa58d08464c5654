"""Shared pieces of the training-data operators.

* A shared folder for cut lineage (``spark.checkpoint.dir``) and a helper that
  writes a table there and reads it back.
* Vectorised word and n-gram hashing over UTF-8 buffers, used inside Arrow
  batches.  Words are ``[^\\x20\\x09-\\x0D]+``; hashes are 64-bit polynomial
  hashes with a finalising mix, so two different words (or n-grams) collide
  with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only for local masters that have none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="judgelab-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`materialise`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark's cleaner drops them once the driver's garbage is collected."""
    for _ in range(2):  # what refers to a shuffle may itself go only in the first turn
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def utf8(c: Column | str) -> Column:
    """Bytes of a text column; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


# --- vectorised hashing -----------------------------------------------------------------

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M64 = 1 << 64
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_cache: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    got = _cache.get((base, inverse))
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, pow(base, -1, _M64) if inverse else base, dtype=np.uint64)
        step[0] = 1
        got = _cache[base, inverse] = np.multiply.accumulate(step)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a run of documents: hash, byte span in ``buf``, and where each document's words begin."""

    buf: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[d]:first[d + 1] are the words of document d

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def byte_span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the byte spans ``start:end``."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=total[1:])
    h = (total[end] - total[start]) * _powers(_P, n + 1, inverse=True)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(_Q))


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Split ``buf`` (documents lie at ``offsets``) into hashed words."""
    n = len(buf)
    if lower:
        buf = _LOWER[buf]
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[buf]
    begin = inside[1:] & ~inside[:-1]
    stop = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut + 1]]  # a word on either side of a document boundary
    begin[cut] = stop[cut] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    return Words(buf, byte_span_hashes(buf, start, end), start, end, np.searchsorted(start, offsets))


def ngram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words; runs may cross documents (see :func:`inside_doc`)."""
    n = len(h)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    base = (_Q + 2 * salt * 0x1000193) | 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * _powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(base, n, inverse=True)[: n - k + 1] + np.uint64(k))


def span_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the word runs ``lo:hi``, of any lengths."""
    base = (_Q + 2 * salt * 0x1000193) | 1
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _powers(base, len(h)), out=total[1:])
    return mix((total[hi] - total[lo]) * _powers(base, len(h) + 1, inverse=True)[lo] + (hi - lo).astype(np.uint64))


def inside_doc(first: np.ndarray, k: int) -> np.ndarray:
    """True for every run of ``k`` words that stays in one document."""
    n = int(first[-1])
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for d in first[1:-1]:
        ok[max(0, d - k + 1) : d] = False
    return ok


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text or binary column into runs of whole rows of about ``limit`` bytes: (row, end row, bytes, offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    if len(rows) * width < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def list_rows(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Flat ``values`` cut into one list a row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def ranked(df: DataFrame, by: list[str], order: list[str], limit: int = 32768) -> DataFrame:
    """``df`` (a written table) with ``__part`` and ``__at``: the row's place by ``order`` within ``by``, from 0.

    Rows are cut into sorted ranges of about ``limit`` rows; a group of any
    size spans as many ranges as it fills, and its ranges' counts are added up.
    ``order`` should tell all rows apart, or rows alike share a range.
    """
    local = (1 << 33) - 1  # an id's lower bits count the rows of its partition
    cut = df.repartitionByRange(max(1, -(-df.count() // limit)), *by, *order).sortWithinPartitions(*by, *order)
    cut = materialise(cut.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    cut = cut.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(local).alias("__row"))
    found = cut.groupBy(*by, "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = found.select(*by, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return cut.join(shift, [*by, "__part"]).select(*[F.col(f"`{c}`") for c in df.columns], "__part", (F.col("__row") + F.col("__shift")).alias("__at"))
