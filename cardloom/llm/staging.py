"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in tests, a folder of the warehouse.

    The warehouse is the other place that driver and executors share, so the rule is the same on every master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cardloom-stages"


def staged(table: DataFrame, name: str) -> DataFrame:
    """Write ``table`` to the shared folder and read it from there, which cuts its lineage.

    A stage survives the loss of any executor, and what reads it twice does not compute it twice. Afterwards the shuffle
    files it was made from are let go: Spark's cleaner drops them once the driver's garbage is collected, which a mostly
    idle driver would put off.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    stage = spark.read.schema(table.schema).parquet(path)
    stage.stage_path = path
    return stage


def drop_stage(stage: DataFrame) -> None:
    """Delete a table that ``staged`` wrote; what still reads it fails from here on."""
    jvm, conf = stage.sparkSession.sparkContext._jvm, stage.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(stage.stage_path)
    path.getFileSystem(conf).delete(path, True)


def in_order(docs: DataFrame, once: bool = False) -> DataFrame:
    """``doc_id``, ``text``, and the order of documents as ``key`` and ``part``.

    ``part`` is 0 if all ids differ, else the text's hash. A null ``doc_id`` comes first. Rows that are equal in both
    columns are one document; with ``once`` only one of them stays.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    differ = ids.isEmpty()
    part = F.lit(0).cast("long") if differ else F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", "text", key.alias("key"), part.alias("part"))
    return rows.dropDuplicates(["key", "part"]) if once and not differ else rows
