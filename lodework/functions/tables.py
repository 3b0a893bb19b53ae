"""Tables that a plan writes and reads again, and small helpers on DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: the shuffle files of an execution go when it ends. What is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which is one machine, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodework-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Written tables cut lineage: after the loss of an executor only reads of them are repeated."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/lodework-{name}-{uuid.uuid4().hex[:12]}", 0
        self.latest: dict[str, str] = {}

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:04d}-{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        self.latest[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def step(self, df: DataFrame, name: str) -> DataFrame:
        """Save a round's table and drop the one of the round before, which nothing may read any more."""
        old = self.latest.get(name)
        out = self.save(df, name)
        if old:
            self._delete(old)
        return out

    def drop(self, *names: str) -> None:
        """Delete the last tables saved under these names."""
        for name in names:
            if path := self.latest.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
