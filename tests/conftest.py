import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from daystrata.session import tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    s = (tuned(SparkSession.builder).master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", str(warehouse)).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def days(n, start="2000-01-01"):
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(n)]
