"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set as Spark's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get at most BATCH_ROWS texts at once, for the rest of the session, unless it already has a lower bound.

    A batch lies in memory several times, in the executor and in its workers;
    Spark's own bound is 10,000 rows however long they are. Plans read the
    setting when they are made, which is after an operator has returned.
    """
    now = int(spark.conf.get(BATCH_KEY))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def all_columns(df: DataFrame) -> list[Column]:
    """Every column by its quoted name, so that names with dots and blanks are columns too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(name: str, df: DataFrame) -> str:
    """The name, or the name and underlines, whatever no column of df is called (in small or capital letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _written(df: DataFrame, label: str) -> tuple[DataFrame, object]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the session ends, as the returned frame is lazy.
    """
    table, path = _written(df, label)
    _files(df.sparkSession, path).deleteOnExit(path)
    return table


class Scratch:
    """Shared tables that go at the end of a with block; nothing that is returned may depend on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        table, path = _written(df, label)
        self.paths.append(path)
        return table

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for path in self.paths:
            _files(self.spark, path).delete(path, True)
