"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: the warehouse of a cluster, which is shared too; a new local folder if there is one machine only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="quillsight-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillsight-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A path of its own for a table in the shared folder."""
    return f"{shared_dir(spark)}/quillsight/{name}-{uuid.uuid4().hex}"


def remove_tables(spark: SparkSession) -> bool:
    """Remove all tables that jobs have left in the shared folder; no job that still reads them may be running."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillsight")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
