import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data(spark):
    from cardflow.plans.adapter import card_data

    return card_data(spark, SMALL)


@pytest.fixture(scope="session")
def hot_txn(spark, data):
    """Adapter rows with a third of the cards merged into one, written once."""
    from pyspark.sql import functions as F

    from cardflow.sources.store import materialize

    merged = F.when(F.col("card_no").cast("int") % 3 == 0, "HOT").otherwise(F.col("card_no"))
    return materialize(data.txn.withColumn("card_no", merged), "hot-txn")
