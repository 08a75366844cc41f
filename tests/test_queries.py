"""Every query with SQL gives the rows of its SQL; every other one runs."""

from __future__ import annotations

import pytest
from oracle import connect, rows

from plumbline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), con.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
