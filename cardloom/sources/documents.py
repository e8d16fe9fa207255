"""Event and deck documents and the code cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.once import select_once
from cardloom.schemas import DECK_DDL, EVENT_DDL
from cardloom.sources.landed import FILE_PATH, files_in, is_at_depth, load_files, path_is_missing

_CORRUPT = "corrupt_record"
_EVENT_FILES = "event_*/event_info.json"
_DECK_FILES = "event_*/deck_*.json"
# Only the last folder counts: a parent folder may hold the same word.
_FOLDER_EVENT_ID = r"event_([^_/]+)_[^/]*/[^/]+$"


def read_event_documents(spark: SparkSession, folder: str, files: str = _EVENT_FILES) -> DataFrame:
    """All ``event_*/event_info.json`` (or ``files``) under a folder: the event document and its ``folder``."""
    found = _load(spark, EVENT_DDL, folder, files)
    if found is None:
        return spark.createDataFrame([], f"{EVENT_DDL}, folder string")
    return found.select("*", F.regexp_replace(FILE_PATH, "/[^/]*$", "").alias("folder"))


def read_deck_documents(
    spark: SparkSession, folder: str, files: str = _DECK_FILES, event_id: str = _FOLDER_EVENT_ID
) -> DataFrame:
    """All ``event_*/deck_*.json`` (or ``files``) under a folder: the deck document, ``event_id`` and ``deck_file``.

    The event id is group 1 of a pattern on the path. One unreadable file fails the read; :func:`read_deck_documents_tolerant` goes on.
    """
    found = _load(spark, DECK_DDL, folder, files)
    if found is None:
        return spark.createDataFrame([], f"{DECK_DDL}, event_id string, deck_file string")
    return _with_lineage(found, event_id)


def read_deck_documents_tolerant(
    spark: SparkSession, folder: str, files: str = _DECK_FILES, event_id: str = _FOLDER_EVENT_ID
) -> tuple[DataFrame, DataFrame]:
    """Readable deck documents as in :func:`read_deck_documents`, and the rejected files: ``deck_file, text``.

    An unreadable file is rejected and the read goes on. Spark passes over empty files before anything is read, so they
    are what its listing of the folder has and the read has not.
    """
    try:
        texts = load_files(spark, spark.read.format("text").option("wholetext", True), folder, files)
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        return (
            spark.createDataFrame([], f"{DECK_DDL}, event_id string, deck_file string"),
            spark.createDataFrame([], "deck_file string, text string"),
        )
    lineage = [F.regexp_extract(FILE_PATH, event_id, 1).alias("event_id"), F.col(FILE_PATH).alias("deck_file")]
    good, bad = _good_and_bad(texts.select("value", *lineage), DECK_DDL, "event_id", "deck_file")
    paths = spark.createDataFrame([(path,) for path in texts.inputFiles()], "deck_file string")
    listed = paths.where(is_at_depth(spark, F.col("deck_file"), files_in(folder, files)[0]))
    place = F.regexp_replace("deck_file", "^file:/+", "/")
    read = texts.select(F.col(FILE_PATH).alias("deck_file")).select(place.alias("place"))
    empty = listed.withColumn("place", place).join(read, "place", "left_anti")
    return good, bad.select("deck_file", "text").unionByName(empty.select("deck_file", F.lit("").alias("text")))


def read_document_lines(
    spark: SparkSession, path: str, schema: str, *partitions: str
) -> tuple[DataFrame, DataFrame]:
    """Documents stored as JSON lines, with their partition columns as strings: the readable documents, and the
    rejected lines as ``file, text``."""
    declared = ", ".join(f"{name} string" for name in ("value", *partitions))
    lines = spark.read.schema(declared).text(path).select("value", *partitions, F.col(FILE_PATH).alias("file"))
    good, bad = _good_and_bad(lines, schema, *partitions, "file")
    return good.drop("file"), bad.select("file", "text")


def _good_and_bad(texts: DataFrame, schema: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    document = F.from_json("value", f"{schema}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = select_once(texts, ["value", *keep], document.alias("document"))
    broken = F.col("document").isNull() | F.col(f"document.{_CORRUPT}").isNotNull()
    good = parsed.where(~broken).select("document.*", *keep).drop(_CORRUPT)
    return good, parsed.where(broken).select(*keep, F.col("value").alias("text"))


def _with_lineage(found: DataFrame, event_id: str) -> DataFrame:
    path = F.col(FILE_PATH)
    return found.select(
        "*", F.regexp_extract(path, event_id, 1).alias("event_id"), path.alias("deck_file")
    )


def _load(spark: SparkSession, schema: str, folder: str, files: str) -> DataFrame | None:
    reader = spark.read.schema(schema).format("json").option("multiLine", True).option("mode", "FAILFAST")
    try:
        return load_files(spark, reader, folder, files)
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        return None


def read_code_cache(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """Code cache as ``card_id, card_code``, one row per id.

    ``layout='object'`` is one JSON object per file, ``'lines'`` one JSON object per line (what
    :func:`cardloom.sinks.documents.write_code_cache` writes). A missing or unreadable cache is empty.
    """
    if layout not in ("object", "lines"):
        raise ValueError("layout is 'object' or 'lines'")
    try:
        reader = spark.read.format("text").option("wholetext", layout == "object")
        folder, _, files = path.rpartition("/")
        # A path may also be a folder of files; with a pattern in front of its name it is files in many folders.
        text = load_files(spark, reader, folder, files) if "*" in folder else reader.load(path)
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        return spark.createDataFrame([], "card_id string, card_code string")
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("card_id", "card_code"))
    return entries.groupBy("card_id").agg(F.max("card_code").alias("card_code"))
