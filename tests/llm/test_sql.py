import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracle

from chunklake.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    oracle.same(spark, oracle.connection(SMALL), QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
