"""Ending lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


_own_dir: list[str] = []  # the folder of a local session without spark.checkpoint.dir


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet under spark.checkpoint.dir and read again; the table stays until the session's JVM ends.

    Only a session in one process may have no such folder: it gets one that goes with the process.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="chronogrid-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        shared = "file://" + _own_dir[0]
    path = f"{shared.rstrip('/')}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
