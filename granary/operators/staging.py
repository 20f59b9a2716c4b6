"""Written intermediate results in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str = "rows") -> str:
    """A fresh path below spark.checkpoint.dir, which every executor can reach.

    Only where the session names no such folder (tests, notebooks) is a
    temporary one set, so a cluster never falls back to a machine-local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/granary-{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str = "rows") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs only its own tasks."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a staged DataFrame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/granary-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
