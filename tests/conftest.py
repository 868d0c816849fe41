import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from peopleweave.session import build_session
    session = build_session("tests", "local[*]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def tables(spark):
    from peopleweave.bindings import Tables
    return Tables(spark, SF)
