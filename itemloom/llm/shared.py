"""What several operators of this package need: shared folders, Arrow batches, worker state."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.session import bounded_batches, shuffles_removed, work_folder  # noqa: F401 - the operators take it from here


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the folder that driver and executors share."""
    folder = work_folder(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The frame, written to the shared folder and read again: a cut of its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised_alone(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``materialised``, after which the files of this write's shuffles are removed; nothing else reads them."""
    with shuffles_removed(df.sparkSession):
        return materialised(df, name, codec)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialised`` wrote and nothing will read again."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def worker_state() -> dict:
    """A store that lives as long as the Python worker, so tables are built once, not once a task.

    Task functions travel by value and get new globals in each task; a module entry stays.
    """
    name = "itemloom_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text; the large numbers are the checksum's start and polynomial."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"
