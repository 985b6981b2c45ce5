"""Queries of the training-data operators against plain SQL."""

import pytest
from compare import connect, differences

from fleetlens.llm.common import release
from fleetlens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None
    release(spark)
