"""Session, table loading and materialising in the folder all executors share."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, one of our own.

    A cluster without that setting is an error: a folder of one machine would not be seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/featherloom-shared"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


_roots: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. The application's folder goes when the driver ends."""
    root = f"{shared_dir(spark)}/featherloom-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


_written: list[str] = []


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage at data that survive the loss of executors. Later readers get column pruning and
    statistics. The table is needed as long as frames made from it are; see release.
    """
    spark = df.sparkSession
    path = scratch(spark)
    _written.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def release(spark: SparkSession):
    """Removes, at its end, all tables that were materialised within: for sessions of many queries, each read to its end inside."""
    at = len(_written)
    try:
        yield
    finally:
        for path in _written[at:]:
            _remove(spark, path)
        del _written[at:]
