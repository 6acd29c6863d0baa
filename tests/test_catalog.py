"""Every query with a SQL twin against that twin, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from procsift.plans.catalog import QUERIES
from procsift.plans.oracles import ORACLES
from verify import SF_DIR, canonical, connect, oracle_rows

ONLY_ROWS = {"rf_importance", "forest_scores", "forest_alerts", "attribution"}


@pytest.fixture(scope="module")
def twins():
    return connect(SF_DIR)


def test_every_query_has_a_twin_but_the_fitted_models():
    assert set(QUERIES) - set(ORACLES) == ONLY_ROWS
    assert set(ORACLES) <= set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, twins, name):
    df = queries()[name](spark, SF_DIR)
    rows, columns = oracle_rows(twins, oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, columns)


def test_forest_alerts(spark):
    rows = queries()["forest_alerts"](spark, SF_DIR).collect()
    assert rows and all(r.explanation.startswith("Flagged: ") for r in rows)
    assert {r.risk_level for r in rows} <= {"Critical", "High"}


def test_entry(spark):
    assert entry(spark).count() == 20
