import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def stages_are_dropped():
    from cardloom.session import OPEN_STAGES

    yield
    OPEN_STAGES.drop()


@pytest.fixture()
def apply(spark):
    """``apply(function, values)``: the outcome of a column function for each value."""
    from pyspark.sql import functions as F

    def run(function, values):
        numbered = spark.createDataFrame(list(enumerate(values)), "n int, value string")
        rows = numbered.select("n", function(F.col("value")).alias("out")).orderBy("n").collect()
        return [row["out"] for row in rows]

    return run
