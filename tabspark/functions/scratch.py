"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A local session without one gets a fresh temporary folder. On a cluster the
    setting is required, because executors cannot see a folder of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared folder that no other call returns."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and unlike a checkpoint lets the
    optimizer prune columns and know the size. The folder may be emptied after the
    session.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table written by :func:`materialise`, once nothing reads it any more."""
    folder = shared_folder(df.sparkSession)
    for file in df.inputFiles():
        parent = file.rsplit("/", 1)[0]
        if parent.rsplit("/", 1)[-1].startswith("step-") and folder.rstrip("/").split(":")[-1].lstrip("/") in parent:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            return
