"""Every registered query against its SQL twin on the small data set."""

import pytest
from compare import compare, connect

from gridsieve.queries import ORACLES, QUERIES

ROWS_ONLY = {"i15_ablation"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    ok, message, _ = compare(spark, duck, sf_dir, name)
    assert ok, message


def test_only_iterative_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
