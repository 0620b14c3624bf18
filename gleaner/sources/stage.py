"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """Write the rows under spark.checkpoint.dir (a temporary folder where it is unset, as in tests) and read them again.

    Lineage ends there and a lost executor loses nothing; the folder goes when the JVM ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/gleaner-stage"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table of staged() that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
