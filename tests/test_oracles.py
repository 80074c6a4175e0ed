"""Every registered query of the engine against its SQL."""

import pytest
from tests.conftest import same_rows

from loomstone.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, duck, sf_dir):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_entry_runs(spark, monkeypatch, sf_dir):
    import __spark_entry__

    monkeypatch.setenv("ENTRY_SF_DIR", sf_dir)
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "name", "amount_text", "event_date", "migrated"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
