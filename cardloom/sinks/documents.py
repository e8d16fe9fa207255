"""Product file, event and deck documents, code cache, flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.constants import PRODUCT_COLUMNS
from cardloom.operators.products import sort_products
from cardloom.session import Stages
from cardloom.sources.documents import read_code_cache

# Bounds the size of one output file, so that a date with very many events still becomes several files.
MAX_RECORDS_PER_FILE = 1_000_000


def write_csv(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, quotes doubled, fields quoted only when needed, empty and missing text bare."""
    (
        table.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_product_csv(spark, path: str) -> DataFrame:
    """Read a product file back; bare fields become ``''``."""
    schema = ", ".join(f"{name} string" for name in PRODUCT_COLUMNS)
    table = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return table.fillna("")


def write_products(products: DataFrame, path: str, undated: str = "first") -> bool:
    """Sorted product file; an empty table writes nothing. Tells whether something was written.

    A global sort reads its input twice, first to find the ranges. The products are therefore written to the shared
    folder before they are sorted, so that the pages behind them are parsed once.
    """
    with Stages() as stages:
        staged = stages.write(products, "products-unsorted")
        if staged.isEmpty():
            return False
        write_csv(sort_products(staged, undated).select(*PRODUCT_COLUMNS), path)
    return True


def write_documents(
    documents: DataFrame, path: str, partition: str = "event_date", mode: str = "overwrite"
) -> None:
    """Event or deck documents as JSON lines, one folder per ``partition`` value.

    The value also stays in the row, as the name of a folder cannot tell a blank value from none; the folder is named
    after ``<partition>_folder``.

    A folder per event or a file per deck would be millions of tiny files. Rebalancing brings a date together, so that
    it becomes few files, and splits a date with very many documents over several tasks. With ``mode='overwrite'``
    only the partitions that occur in ``documents`` are replaced.
    """
    folder = f"{partition}_folder"
    (
        documents.withColumn(folder, F.coalesce(F.col(partition).cast("string"), F.lit("")))
        .hint("rebalance", folder)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .option("ignoreNullFields", False)
        .partitionBy(folder)
        .json(path)
    )


def write_code_cache(cache: DataFrame, path: str) -> None:
    """Code cache as one small JSON object per line; ``path`` must be new, so a failed write loses no cache."""
    line = F.to_json(F.create_map("card_id", "card_code"))
    cache.select(line.alias("value")).write.mode("errorifexists").text(path)


def append_code_cache(codes: DataFrame, path: str) -> int:
    """Add the codes of new ids to a cache of lines and nothing else; gives their number.

    What the cache holds is neither written again nor shuffled: it is read for its ids alone. Known ids keep their code,
    and an id without one is not added. An append that fails leaves the cache as it was. Of two appends at a time both
    may add an id; a read then takes the greater code, always the same one.
    """
    known = read_code_cache(codes.sparkSession, path, layout="lines")
    fresh = codes.where("card_id is not null").groupBy("card_id").agg(F.max("card_code").alias("card_code"))
    with Stages() as stages:
        new = stages.write(fresh.join(known.select("card_id"), "card_id", "left_anti"), "new-codes")
        added = new.count()
        if added:
            line = F.to_json(F.create_map("card_id", "card_code"))
            new.select(line.alias("value")).hint("rebalance").write.mode("append").text(path)
    return added


def merge_code_cache(spark: SparkSession, path: str, new_path: str) -> None:
    """The cache and all that was appended to it as one, at a new path, so a failed merge loses nothing."""
    write_code_cache(read_code_cache(spark, path, layout="lines").hint("rebalance"), new_path)
