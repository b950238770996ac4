"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage: a lost executor costs the recomputation of
one step, never of the whole job. The folder comes from ``spark.checkpoint.dir``;
only a local session without that setting (tests, a laptop) gets a folder of its
own, on a cluster the setting is required.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parlance.runtime import shared_folder


class Scratch:
    """Named Parquet tables of one run; ``drop`` frees those no longer needed.

    Tables that a returned DataFrame still reads stay until the folder's owner
    cleans it: the result is lazy, so nothing here can know when it was read.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/parlance/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` once and give back a scan of it with the same schema."""
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(conf).delete(path, True)
