"""Intermediate tables in the cluster's shared folder.

A written table cuts a plan's lineage, survives the loss of executors and
brings its size to the planner.  The folder is the one that
``spark.checkpoint.dir`` names.  ``with Tables(spark) as t`` drops every
table stored in the block when it ends, but for those handed to ``keep``:
the ones that the block's lazy result still reads.  Kept tables are dropped
when the driver process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from flowlab.session import checkpoint_dir

ROWS = 200_000


class Tables:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/flowlab-{uuid.uuid4().hex}"
        self.made = 0
        self.kept: list[DataFrame] = []

    def store(self, df: DataFrame, rows: int | None = ROWS) -> DataFrame:
        """``df``, written and read again, in as many partitions as its number of rows calls for (None: as Spark reads it)."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        if rows:
            back = back.coalesce(1 + back.count() // rows)
        back._table_path = path
        return back

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, as stored, stays when the block ends."""
        self.kept.append(df)
        return df

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._table_path)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        stay = {df._table_path for df in self.kept}
        for i in range(self.made):
            if (path := f"{self.folder}/{i}") not in stay:
                _delete(self.spark, path)
        if stay:
            atexit.register(_delete, self.spark, self.folder)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that has ended cannot delete; the folder is scratch space
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
