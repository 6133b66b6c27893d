import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsloom.session import get_spark  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        os.environ.get("TEST_MASTER", "local[4]"),
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SMALL


@pytest.fixture
def one(spark):
    """Evaluate a column function on a few texts: list of results in order."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        out = rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()
        return [r.v for r in out]

    return run
