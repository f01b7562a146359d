import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="chronoweave-ckpt-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("chronoweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def data_dir(sf="sf0.001"):
    return os.environ.get("CHRONOWEAVE_TESTDATA", f"/root/testdata/{sf}")
