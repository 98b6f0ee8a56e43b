"""Tables written in the folder that spark.checkpoint.dir names, to cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Without that setting, a temporary folder serves a local session; anywhere else executors share no
    such folder, and that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sceneloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, by: str | None = None, compression: str = "zstd", group: int | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors.

    With `by`, in one folder per value of that column, so that a filter on it reads one. group: bytes of a row group, for tables of long values, since up
    to 4,096 rows of one are read at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    writer = writer if group is None else writer.option("parquet.block.size", group)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task takes where tables are dealt out.
ROWS = 100_000


def tasks(df: DataFrame, rows: int | None = None) -> int:
    """How many tasks take df's rows, so many each. They are counted."""
    return max(1, -(-df.count() // (rows or ROWS)))


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt out by keys, so many rows a task: tasks do not grow with the table, whatever the session's number of partitions. It is counted first."""
    return df.repartition(tasks(df, rows), *keys)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table that `written` gave (without `by`), once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
