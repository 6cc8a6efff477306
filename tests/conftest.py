from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lumenframe import get_spark

    place = tmp_path_factory.mktemp("spark")
    os.environ.setdefault("PYTHONPATH", ROOT)
    session = get_spark("tests", "local[4]", **{
        "spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_driver_memory": "4g",
        "spark_checkpoint_dir": str(place / "shared"), "spark_sql_warehouse_dir": str(place / "warehouse"),
        "spark_ui_showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
