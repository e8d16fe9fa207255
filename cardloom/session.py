"""Session settings and the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Adaptive execution sizes the shuffles at run time and splits hot join partitions; nothing here depends on the
# number of cores. The initial partition number is deliberately high, as adaptive execution merges what is small.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Building a column would otherwise look up the calling line each time, which takes longer than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings the jobs are designed for to a session builder."""
    for key, value in CLUSTER_SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, and where it is unset a folder of the warehouse.

    A warehouse on the local disk is shared only where driver and executors are one process. On a cluster it is refused,
    as a stage would be scattered over the machines and found by none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not warehouse_is_shared(warehouse, spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/cardloom-stages"


def warehouse_is_shared(warehouse: str, master: str) -> bool:
    return master.split("[")[0] == "local" or not warehouse.startswith(("file:", "/"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; no two calls give the same one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Stages:
    """Tables written to the shared folder and read from there, each worked out once; ``drop`` deletes them.

    Jobs drop their stages when they have written what is made of them. An operator that gives a lazy table keeps its
    stages in :data:`OPEN_STAGES` until the caller has used the table and calls ``OPEN_STAGES.drop()``.
    """

    def __init__(self) -> None:
        self._written: list[tuple[SparkSession, str]] = []

    def write(self, table: DataFrame, name: str) -> DataFrame:
        path = fresh_path(table.sparkSession, name)
        table.write.parquet(path)
        self._written.append((table.sparkSession, path))
        return table.sparkSession.read.schema(table.schema).parquet(path)

    def drop(self) -> None:
        while self._written:
            spark, path = self._written.pop()
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()


OPEN_STAGES = Stages()


def let_go(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted: Spark's cleaner drops them once the driver's garbage is collected, which
    a mostly idle driver puts off."""
    spark.sparkContext._jvm.System.gc()


def numbered(stages: Stages, ordered: DataFrame, name: str) -> DataFrame:
    """A sorted table with the ``position`` of each row from 1, as written: rows before its file, then rows in it.

    Only the files are counted in one place, never the rows.
    """
    written = stages.write(ordered, name)
    placed = written.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line"))
    files = placed.groupBy("file").agg(F.count("*").alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "file").select(*ordered.columns, (F.col("start") + F.col("line") + 1).alias("position"))
