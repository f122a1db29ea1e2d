import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parley.session import build_session

    s = build_session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="3g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF
