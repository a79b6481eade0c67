import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["rule_match", "label_semi_scan", "route_alerts", "assemble_incidents", "event_count_corr", "rollup_5m", "knn_cosine"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).schema == entry.entry(spark).schema


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_product(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rules_are_matched_in_one_scan(spark):
    plan = entry.queries()["rule_match"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("RelationV2") == 1
