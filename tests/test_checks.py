"""Every query with an SQL check agrees with it on the given tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SF

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problems = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert not [p for p in problems if not p.startswith("note")], problems


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_no_pairing_of_everything(spark):
    """No plan pairs all rows of two tables."""
    for name in ("parse_entries", "rule_engine", "severity_scores", "timeline", "mine_templates", "search_logs",
                 "relationship_groups", "actionable_patterns", "alert_matches", "category_heatmap"):
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_search_filter_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = QUERIES["search_logs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(severity,MEDIUM)" in plan
    assert "GreaterThanOrEqual(timestamp" in plan
