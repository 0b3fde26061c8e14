"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; where that is unset, a local master gets one below the temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def state_of(df: DataFrame) -> str:
    """Names, sizes and times of the files that ``df`` reads: changes when they do."""
    spark, out = df.sparkSession, []
    for file in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((file, status.getLen(), status.getModificationTime()))
    return repr(out)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows doesn't work it out anew, and lost executors don't matter."""
    path = f"{shared_root(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*settled_: DataFrame) -> None:
    """Removes the files of settled tables that nothing reads any more."""
    for df in settled_:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
