"""Tables of a folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core below which a table is dealt anew: a file of one row group is one task's work, however many cores wait.
LEAST_BYTES = 8 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, scanned as it lies; one that is small for the cores is dealt to them by a shuffle of a few megabytes."""
    path = f"{folder}/{name}.parquet"
    df, sc = spark.read.parquet(path), spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if 1 << 20 < size < sc.defaultParallelism * LEAST_BYTES:
        return df.repartition(sc.defaultParallelism)
    return df
