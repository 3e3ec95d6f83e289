from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def make_session(**extra):
    from pyspark.sql import SparkSession
    from weblake.session import RECOMMENDED_CONF
    builder = SparkSession.builder.master("local[8]").appName("weblake-tests")
    conf = {**RECOMMENDED_CONF, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", **extra}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
