"""Every relational query against the SQL that checks it."""

from __future__ import annotations

import pytest
from compare import connect, duck_rows, spark_rows

from lumenframe.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert name in ORACLES
    want_names, want = duck_rows(duck, ORACLES[name])
    assert names == want_names
    assert rows == want
