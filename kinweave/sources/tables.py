"""Reading the driver's tables, and the shared folder that plans write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application's intermediate tables.
_RUNS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a session in one process, as in tests, gets one of its own; a cluster doesn't."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's JVM ends."""
    app = f"{spark.sparkContext.applicationId}:{shared_dir(spark)}"
    if app not in _RUNS:
        path = f"{shared_dir(spark)}/kinweave-{uuid.uuid4().hex}"
        system, at = _hadoop(spark, path)
        system.mkdirs(at)
        system.deleteOnExit(at)
        _RUNS[app] = path
    return _RUNS[app]


def new_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: a cut of its lineage that survives lost executors."""
    path = new_dir(df.sparkSession, what)
    _write(df, path, codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Writes df; its shuffle files go with the end of the job, not when the driver happens to collect garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(name, before)


class Rounds:
    """The tables of an iteration: each round is kept, and the one before it deleted, which nothing else may read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.last = spark, what, None

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_dir(self.spark, self.what)
        _write(df, path)
        if self.last:
            system, at = _hadoop(self.spark, self.last)
            system.delete(at, True)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out for a stage that computes much on few bytes, which adaptive execution would otherwise put into few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
