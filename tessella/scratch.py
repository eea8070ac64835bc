"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading
it again: the files outlive any executor, unlike a local checkpoint. They stay until
:func:`drop` or :func:`clear`, since a result may be computed from them at any time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session: its setting, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster each machine would have its own, so that is an error.
    """
    known = spark.conf.get(SETTING, None)
    if not known:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = held.get() if held.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all machines share")
        known = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set(SETTING, known)
    return known.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; nothing that reads them can run afterwards."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessella_path = path
    return table


def drop(table: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    path = getattr(table, "_tessella_path", None)
    if path:
        jvm = table.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
