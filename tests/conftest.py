import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from eddyflow.session import session

    folder = tmp_path_factory.mktemp("shared")
    settings = {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1",
        "spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = session("local[4]", "tests", **settings)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
