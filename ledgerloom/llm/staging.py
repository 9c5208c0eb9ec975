"""Intermediate tables in the folder that the driver and all executors share.

``stage`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back, which cuts the lineage: a lost
executor costs at most the stage that was running, and a frame that several later steps need is computed once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.ledgerloom.llm.folder"


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below ``spark.checkpoint.dir``; only in local mode, if that is unset, a temporary one.

    Elsewhere executors could not share it, so the setting must be given.
    """
    known = spark.conf.get(_FOLDER, None)
    if known:
        return known
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
    spark.conf.set(_FOLDER, folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return the frame that reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def own_folder(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Stages inside go to a folder of their own; the function given deletes all of them but those that a frame reads."""
    outer = shared_folder(spark)
    folder = f"{outer}/{uuid.uuid4().hex}"
    spark.conf.set(_FOLDER, folder)

    def keep_only(df: DataFrame) -> None:
        kept = {f.split("/")[-2] for f in df.inputFiles()}
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.listStatus(path):
            if found.getPath().getName() not in kept:
                files.delete(found.getPath(), True)

    try:
        yield keep_only
    finally:
        spark.conf.set(_FOLDER, outer)


def drop_stages(spark: SparkSession) -> None:
    """Delete every table that ``stage`` wrote in this session; frames that still read them become unusable."""
    folder = spark.conf.get(_FOLDER, None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset(_FOLDER)
