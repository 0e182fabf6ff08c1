import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from podium.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("podium-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def one(df):
    return df.collect()[0]


@pytest.fixture
def values(spark):
    """Evaluate a function of one text column on a list of texts."""
    def run(texts, build):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
        return [r["x"] for r in df.select("i", build("s").alias("x")).orderBy("i").collect()]
    return run


OBS = "ord bigint, entity string, date string, value double"


@pytest.fixture
def obs(spark):
    def make(rows, schema=OBS):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    return make
