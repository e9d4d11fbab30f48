"""Every value-checked query equals its DuckDB oracle (sf0.001); the rest run."""

import pytest

from conftest import SF_SMALL
from weblens.plans.compare import compare
from weblens.plans.registry import ORACLE, QUERIES

SLOW_STREAMS = {"stream_snapshot", "selection_replay_stream"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE))
def test_matches_oracle(spark, duck, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), duck, ORACLE[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["page_id", "snapshot"] and df.count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
