"""Every registered query against its plain SQL."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from fleetlens.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_rows(spark, plain, name):
    df = entry.queries()[name](spark, FOLDER)
    assert differences(df, plain, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 31 and "memPct" in df.columns


def test_listing_comes_sorted(spark):
    rows = entry.queries()["listing_sorted"](spark, FOLDER).collect()
    keys = [(r.dir, r.type != "DIRECTORY", r.pathSuffix.lower(), r.pathSuffix) for r in rows]
    assert keys == sorted(keys)
