"""Every query that has SQL gives the rows of its SQL."""

import pytest
from compare import connect, difference

from tarnlight.plans import content_queries, preparation, score_queries

MODULES = (preparation, content_queries, score_queries)
CASES = [(m, n) for m in MODULES for n in m.oracle_sql()]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_rows_equal_sql(spark, sf_dir, con, module, name):
    assert difference(module.queries()[name](spark, sf_dir), con, module.oracle_sql()[name]) is None


def test_every_other_query_runs(spark, sf_dir):
    for m in MODULES:
        for name in m.queries().keys() - m.oracle_sql().keys():
            assert m.queries()[name](spark, sf_dir).count() >= 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
