import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditspark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def files(spark):
    """(path, content) pairs -> files table."""
    from pyspark.sql import functions as F

    from auditspark.sources.corpus import is_testlike, language

    def make(*pairs):
        df = spark.createDataFrame(list(pairs), "path string, content string")
        return df.select("path", language(F.col("path")).alias("language"), is_testlike(F.col("path")).alias("is_testlike"),
                         F.length("content").cast("long").alias("length"), "content")

    return make
