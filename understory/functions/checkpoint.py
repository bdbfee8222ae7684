"""Cutting lineage, and scratch space, in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, one process alone gets a temporary folder; a cluster gets an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def mounted(path: str) -> str:
    """``path`` as the driver's and the executors' own file systems name it; an error if it lies in another one."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme and scheme[1] != "file":
        raise ValueError(f"{path} is not in a folder that driver and executors mount")
    return re.sub(r"^file:(?://(?=/))?", "", path)


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder so that its lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder as Parquet: for tables of a row a point or an edge, whose columns take few bytes there.

    ``cut`` writes rows as they lie in memory, 8 bytes a column and more, but keeps how they are partitioned.
    """
    to = scratch(df.sparkSession, "stored")
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
