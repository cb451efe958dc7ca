"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and everything runs in one process (tests, one machine) a temporary folder stands in for it;
    on a cluster a machine's own folder would lose rows, so there the setting is demanded.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidewater-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_all_settled(spark: SparkSession) -> None:
    """Removes all tables that settle() wrote in this application: for callers whose results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(path):
        if f.getPath().getName().startswith(f"tidewater-{spark.sparkContext.applicationId}-"):
            files.delete(f.getPath(), True)
