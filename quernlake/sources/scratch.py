"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set on the context; in local mode, where neither is, a new one is set."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quernlake-')}")
        base = context.getCheckpointDir()
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's setting by which an execution's shuffle files go when it ends, and not once the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, codec: str = "zstd", options: dict[str, int] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet (with the writer's ``options``) to the shared folder and reads it back: cuts the lineage, and survives the loss of executors.

    Nothing reads the shuffles of the write again, so they go with it.
    """
    path, conf = shared_path(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).options(**(options or {})).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
