import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from whence.session import tune

    session = (
        SparkSession.builder.master("local[8]")
        .appName("whence-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture(scope="session")
def frame(spark):
    """Make an annotated frame from rows; the first column is the key of the token."""
    from whence.sources.tokens import annotate_keys

    def make(prefix, schema, rows):
        df = spark.createDataFrame(rows, schema)
        return annotate_keys(df, prefix, [df.columns[0]])

    return make
