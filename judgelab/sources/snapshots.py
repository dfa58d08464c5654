"""The snapshot store: an append-only Parquet table partitioned by model version."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    """Every append is a run; ``run_seq`` orders runs, so the latest of a version needs no file order.

    A run claims its number by creating a file of that name under ``_runs``,
    which the store's file system lets one writer do alone; so appends at the
    same time get different numbers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def _there(self) -> bool:
        p, fs = self._at(self.path)
        return fs.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))

    def load_all(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self._there() else None

    def _claim(self, seq: int) -> bool:
        """True for the one caller that creates the run's file."""
        folder, fs = self._at(f"{self.path}/_runs")
        fs.mkdirs(folder)
        p, _ = self._at(f"{self.path}/_runs/{seq:012d}")
        if fs.getScheme() == "file":  # the local file system creates in two steps, the platform in one
            jvm = self.spark.sparkContext._jvm
            return jvm.java.io.File(p.toUri().getPath()).createNewFile()
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        return True

    def claim_run(self) -> int:
        """The next run's number, which no other run gets."""
        p, fs = self._at(f"{self.path}/_runs")
        claimed = [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()] if fs.exists(p) else []
        old = self.load_all() if not claimed else None  # a store written before runs were claimed
        seq = max(claimed, default=(old.agg(F.max("run_seq")).first()[0] or 0) if old is not None else 0) + 1
        while not self._claim(seq):
            seq += 1
        return seq

    def append(self, snapshot: DataFrame) -> int:
        """Adds rows (model_version, item_id, capability, score); returns the run's number."""
        seq = self.claim_run()
        snapshot.withColumn("run_seq", F.lit(seq)).write.mode("append").partitionBy("model_version").parquet(self.path)
        return seq

    def problems(self) -> DataFrame:
        """(model_version, run_seq, problem, n): rows without an item or a score, and items that a run has more than once."""
        every = self.load_all()
        if every is None:
            raise FileNotFoundError(self.path)
        said = F.array_compact(F.array(F.when(F.col("item_id").isNull(), F.lit("no item_id")), F.when(F.col("score").isNull() | F.isnan("score"), F.lit("no score"))))
        rows = every.select("model_version", "run_seq", F.explode(said).alias("problem"), F.lit(1).alias("n"))
        again = every.filter("item_id IS NOT NULL").groupBy("model_version", "run_seq", "item_id").count().filter("count > 1").select("model_version", "run_seq", F.lit("repeated item_id").alias("problem"), (F.col("count") - 1).cast("int").alias("n"))
        return rows.unionByName(again).groupBy("model_version", "run_seq", "problem").agg(F.sum("n").alias("n"))

    def latest(self, model_version: str) -> DataFrame:
        """Rows of the version's last run: partition pruning, then one aggregate over the run numbers."""
        every = self.load_all()
        if every is None:
            raise FileNotFoundError(self.path)
        mine = every.filter(F.col("model_version") == model_version)
        return latest_run(mine)


def latest_run(snapshots: DataFrame) -> DataFrame:
    """Rows of each version's last run."""
    last = snapshots.groupBy("model_version").agg(F.max("run_seq").alias("run_seq"))
    return snapshots.join(last, ["model_version", "run_seq"], "left_semi")
