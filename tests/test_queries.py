"""Every registered query beside its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from seriatim.plans import catalogue
from tests.compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
    assert catalogue.queries().keys() <= entry.queries().keys()


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"page_id", "url", "pos", "link", "rule", "kind"}
    assert df.count() > 0
