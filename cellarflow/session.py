"""Session helpers: a local session for tests, and a shared place to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session for tests and the bench; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellarflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what the session or the context names, else, in local mode only, one of our own.

    A cluster has to name one: a folder of this machine isn't shared.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cellarflow-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Intermediate Parquet tables in the shared folder: they cut lineage and survive the loss of executors.

    ``save`` writes a table and returns it read back; ``drop`` removes one that no later step reads. What is
    left goes when the application ends, since the result of a query may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cellarflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, name: str) -> DataFrame:
        """The table again, with columns that no join confuses with those of another reading."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the context is gone: nothing left to clean with
            pass
