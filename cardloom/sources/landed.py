"""Landed web pages and API responses as page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from cardloom.functions.urls import event_url

FILE_PATH = "_metadata.file_path"


def read_whole_files(spark: SparkSession, path: str, content: str, **keys: str) -> DataFrame:
    """One row per landed file: its whole text as ``content`` and, per keyword, group 1 of a pattern on its path."""
    files = spark.read.text(path, wholetext=True)
    columns = [F.regexp_extract(FILE_PATH, pattern, 1).alias(name) for name, pattern in keys.items()]
    return files.select(*columns, F.col("value").alias(content))


def load_files(spark: SparkSession, reader: DataFrameReader, folder: str, files: str) -> DataFrame:
    """Load ``folder/files`` (a pattern of folders and a file name) with a reader that has its format.

    For a pattern Spark opens all its folders one after the other in the driver and then looks at the files in up to 10 000
    tasks. Here the driver matches only the names of the last folders; what is in them is listed by as many tasks as the
    session has shuffle partitions. As with the pattern, files of deeper folders do not count (:func:`is_at_depth`).
    """
    folders, name = files_in(folder, files)
    before = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folders)
    finally:
        spark.conf.set(_LISTING_TASKS, before)
    return found.where(is_at_depth(spark, F.col(FILE_PATH), folders))


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def files_in(folder: str, files: str) -> tuple[str, str]:
    """The pattern of the folders, and that of the names of the files right in them."""
    folders, _, name = f"{folder.rstrip('/')}/{files}".rpartition("/")
    return folders, name


def is_at_depth(spark: SparkSession, path: Column, folders: str) -> Column:
    """Is a file right in a folder of a pattern, not deeper?"""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders)
    depth = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).depth()
    return F.size(F.split(F.regexp_replace(path, "^[^:/]+:(?://[^/]*)?", ""), "/")) == depth + 2


def folder_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes in each folder of a dataset that is partitioned by one column, by the column's value; none is ``''``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    unescaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    sizes = {}
    for status in system.listStatus(place):
        column, is_one, value = status.getPath().getName().partition("=")
        if status.isDirectory() and is_one:
            name = unescaped(value)
            sizes["" if name == _NO_VALUE else name] = system.getContentSummary(status.getPath()).getLength()
    return sizes


_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows of a stored table out evenly, whatever their keys, to as many tasks as the session has shuffle
    partitions, or to more if that leaves a task more than ``ROWS_PER_TASK``.

    Parsing a page costs far more than moving it, and a few large files would keep few cores busy. No key decides where a
    row goes. What a task sorts or holds does not grow with the table, whose rows are counted by its files' footers.
    """
    return table.repartition(tasks_for(table))


ROWS_PER_TASK = 1 << 20


def tasks_for(table: DataFrame) -> int:
    """Tasks for the rows of a stored table, as :func:`spread` takes them."""
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table.count() // ROWS_PER_TASK))


def read_api_responses(spark: SparkSession, path: str, page_pattern: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """Landed API responses, one file per page: ``page_no, body``. The page number is cut from the file name."""
    return read_whole_files(spark, path, "body", page_no=page_pattern).withColumn("page_no", _int("page_no"))


def read_catalog_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed catalogue pages ``{site}/{page_no}.html``: ``site, page_no, html``."""
    pages = read_whole_files(spark, path, "html", site=r"([^/]+)/\d+\.html$", page_no=r"(\d+)\.html$")
    return pages.withColumn("page_no", _int("page_no"))


def read_listing_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing pages ``{page_no}.html``: ``page_no, html``."""
    return read_whole_files(spark, path, "html", page_no=r"(\d+)\.html$").withColumn("page_no", _int("page_no"))


def read_event_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed result pages ``{event_id}/{page_no}.html`` of events: ``event_url, page_no, html``."""
    pages = read_whole_files(spark, path, "html", event_id=r"([^/]+)/\d+\.html$", page_no=r"(\d+)\.html$")
    return pages.select(event_url(F.col("event_id")).alias("event_url"), _int("page_no").alias("page_no"), "html")


def read_detail_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed price pages ``{lang}/{code}.html``: ``lang, code, html``."""
    return read_whole_files(spark, path, "html", lang=r"([^/]+)/[^/]+\.html$", code=r"([^/]+)\.html$")


def read_keyed_pages(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Landed pages named by an id, ``{id}.html`` (decks, cards): the id as ``key``, and ``html``."""
    return read_whole_files(spark, path, "html", **{key: r"([^/]+)\.html$"})


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, form: str = "parquet") -> DataFrame:
    """Read a dataset with a declared schema; a path that is not there gives an empty table."""
    found = read_or_none(spark, path, schema, form)
    return spark.createDataFrame([], schema) if found is None else found


def read_or_none(
    spark: SparkSession, path: str, schema: str | T.StructType, form: str = "parquet"
) -> DataFrame | None:
    """Read a dataset with a declared schema; a path that is not there gives nothing."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        return None


def path_is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _int(name: str) -> Column:
    return F.col(name).try_cast("int")
