"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of packed blocks that go to a Python worker at once.
BATCH = "4m"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "flowlab") -> SparkSession:
    """A session tuned for this library.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (roughly
    input bytes / 128 MB); AQE coalesces small partitions and splits
    skewed ones at run time either way.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    spark = (
        b.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLOWLAB_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage (HDFS/S3/...).  Only
    a local-mode session without the setting (tests, laptops) gets a fresh
    temporary folder, because there driver and executors share one disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is unset; set it to a shared folder "
                "(e.g. hdfs:///tmp/flowlab-ckpt) before running iterative jobs")
        d = tempfile.mkdtemp(prefix="flowlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never localCheckpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as there are cores where it has fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def store(df: DataFrame, batch: str | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: cuts lineage, survives lost executors.

    ``batch``: most bytes of rows that go to a Python worker at once, for rows that hold large blocks.  It is a setting of a
    session of its own, a copy of the frame's, which what is made of the result belongs to.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/flowlab-{uuid.uuid4().hex}"
    pages = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"} if batch else {}  # else a page is 100 blocks, and its codec's buffers too
    df.write.options(**pages).parquet(path)
    if batch:
        spark = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes what ``store`` wrote; frames that still read it fail from now on."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
