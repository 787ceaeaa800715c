"""Tables written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a file of a table of known size holds.
FILE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a single machine; a cluster,
    whose machines would not see each other's, raises an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="jobloom-shared-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/jobloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, once: bool = False, size: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage at a copy that survives the loss of any executor.
    ``once``: nothing else will run ``df``, so its shuffle files go as soon as
    it is written, and don't wait for the driver to collect its garbage.
    ``size``: about how many bytes its rows have; a small table then has a file
    for each core or for each ``FILE_BYTES``, not one for each shuffle
    partition.  Hadoop's local file system starts two processes a file
    (``chmod``), each for a moment as large as the executor that starts it.
    """
    if size is not None:
        df = df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))
    path = scratch_path(df.sparkSession, label)
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    try:
        if once:
            conf.set(name, "true")
            df = df.select("*")  # it is looked up when a plan is made
        df.write.parquet(path)
    finally:
        if once:
            conf.set(name, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned, once nothing will read them again."""
    for df in tables:
        path = df.__dict__.get("_scratch") if df is not None else None
        if path:
            spark = df.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete shuffle files and broadcasts of finished queries, which it does once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
