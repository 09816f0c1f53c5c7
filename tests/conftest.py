import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.session import SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("seriesloom-tests")
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Build ``(key, date, value)`` from ``{key: [values]}`` on a monthly or daily grid."""
    import datetime as dt

    def build(data, step="month", extra=None):
        rows = []
        for key, values in data.items():
            for i, v in enumerate(values):
                date = dt.date(2020 + i // 12, i % 12 + 1, 1) if step == "month" else dt.date(2020, 1, 1) + dt.timedelta(i)
                rows.append((key, date, None if v is None else float(v)))
        return spark.createDataFrame(rows, "key string, date date, value double")

    return build


@pytest.fixture
def values():
    """Values of one key in date order."""

    def pick(df, key="a", col="value"):
        rows = df.filter(df["key"] == key).orderBy("date").collect()
        return [row[col] for row in rows]

    return pick
