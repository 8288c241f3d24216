"""Session helpers: building a session, the shared work folder, size checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession


def build_session(app_name: str = "disputatio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on.

    On a cluster the submit command sets master, memory and ``spark.checkpoint.dir``;
    nothing here overrides them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder all executors share.

    Only where the setting is missing the warehouse, which executors share too, stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, label: str = "cut", path: str | None = None, compression: str | None = None) -> DataFrame:
    """Cut the lineage by writing the frame to the shared folder (or to ``path``) and reading it back.

    The files survive the loss of any executor, so a lost task re-reads instead of recomputing.
    """
    path = path or work_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`work_dir` named and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def measure(df: DataFrame, *aggregates: Column) -> Row:
    """One row of aggregates, used to check a side's size before it is broadcast."""
    return df.agg(*aggregates).first()


def spread(df: DataFrame) -> DataFrame:
    """Spread a table read from very few files over all cores.

    Meant for a frame straight from a scan: its planned partitions are counted without running a job.
    A table of many files has more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
