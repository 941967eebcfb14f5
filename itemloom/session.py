"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes an Arrow batch may hold: bounds what one Python worker has in memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Bound what a Python worker holds of long texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("itemloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a size that long texts cannot break, whatever the session was started with."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_folder(spark: SparkSession) -> str | None:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    Where it is unset, local mode makes a folder of its own; a cluster gets None.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.startswith("local"):
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame several branches read, in reliable storage that all executors see."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = work_folder(df.sparkSession)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = work_folder(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs run in here leave no shuffle files behind; nothing else may read them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: a cut of its lineage that keeps columns apart.

    The write's shuffle files go with it.
    """
    path = work_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
