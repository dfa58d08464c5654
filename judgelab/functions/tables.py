"""Tables written between steps, ranges of them in order, and running sums over the ranges."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one range, about.
RANGE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only for local masters that have none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="judgelab-"))
        found = sc.getCheckpointDir()
    return found


_folders: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def step_path(spark: SparkSession) -> str:
    """A new path for a table between steps; all of an application's lie in one folder, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/steps-{app}"

        def remove() -> None:
            with contextlib.suppress(Exception):  # the application may have ended before the driver
                _remove(spark, _folders[app])

        atexit.register(remove)
    return f"{_folders[app]}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and scanned from then on."""
    path = step_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """Rows of a table, and of its largest group."""
    if not by:
        return (n := df.count()), n
    found = df.groupBy(*by).count().agg(F.sum("count"), F.max("count")).first()
    return found[0] or 0, found[1] or 0


def running(df: DataFrame, by: list[str], order: list[str], sums: list[str], limit: int = RANGE_ROWS) -> DataFrame:
    """``df`` (a written table) with ``before_<c>`` for each of ``sums``: the sum over the rows before, by ``order`` within ``by``.

    Rows are cut into ranges of about ``limit`` rows; a window spans one range
    of one group, and the ranges' totals give their offsets.  Groups that are all
    within ``limit`` need no ranges.
    """
    rows, largest = _sizes(df, by)
    if by and largest <= limit:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums])
    parts = -(-rows // limit)
    if parts > 1:
        df = written(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    else:
        df = df.withColumn("__part", F.lit(0))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = df.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    offsets = offsets.select(*by, "__part", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    out = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"before_{c}") for c in sums])
    if parts > 1 or by:
        out = out.join(offsets, [*by, "__part"])
        return out.select(*[c for c in df.columns if c != "__part"], *[(F.col(f"before_{c}") + F.col(f"__{c}")).alias(f"before_{c}") for c in sums])
    return out.drop("__part")


def sequenced(df: DataFrame, by: list[str], order: list[str], ahead: dict[str, str], limit: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``__at``, the row's place from 1 by ``order`` within ``by``, and for each (new: old) of ``ahead`` the next row's ``old``.

    As in :func:`running`, windows span one range of one group; the first row of
    a range is carried to the range before it where a group goes on.  ``df`` is
    read twice, or three times if a group is larger than ``limit``.
    """
    rows, largest = _sizes(df, by)
    if by and largest <= limit:
        whole = Window.partitionBy(*by).orderBy(*order)
        return df.select("*", F.row_number().over(whole).cast("bigint").alias("__at"), *[F.lead(old).over(whole).alias(new) for new, old in ahead.items()])
    df = written(df.repartitionByRange(max(1, -(-rows // limit)), *by, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "__part").orderBy(*order)
    ranges = df.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min_by(F.struct(F.lit(True).alias("there"), *[F.col(old).alias(new) for new, old in ahead.items()]), F.struct(*order)).alias("__first"))
    over = Window.partitionBy(*by).orderBy("__part")  # one row a range
    ranges = ranges.select(*by, "__part", F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lead("__first").over(over).alias("__carried"))
    out = df.select("*", F.row_number().over(inside).alias("__k"), F.lead(F.struct(F.lit(True).alias("there"), *[F.col(old).alias(new) for new, old in ahead.items()])).over(inside).alias("__next")).join(ranges, [*by, "__part"])
    follows = F.when(F.col("__next.there"), F.col("__next")).otherwise(F.col("__carried"))
    return out.select(*[c for c in df.columns if c != "__part"], (F.col("__before") + F.col("__k")).alias("__at"), *[follows[new].alias(new) for new in ahead])
