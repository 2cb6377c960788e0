import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quarry.session import get_session
    s = SparkSession.builder.master("local[4]") \
        .config("spark.sql.shuffle.partitions", "8") \
        .config("spark.ui.enabled", "false") \
        .config("spark.ui.showConsoleProgress", "false") \
        .getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    get_session()  # fills the defaults and a test checkpoint folder
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
