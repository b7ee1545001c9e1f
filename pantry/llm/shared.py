"""Tables in the folder that driver and executors share, and other small helpers of the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where a local session has none (as in tests), one is set in the warehouse; a cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs within go as it ends, else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there: lineage ends, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def gone(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote and no later plan reads; other frames are left alone."""
    for t in tables:
        if folder := vars(t).get("_kept"):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).getParent()  # each table has a folder of its own there
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores before it as it takes to clash with no column, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
