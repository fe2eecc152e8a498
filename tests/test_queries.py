import oracle
import pytest

import __spark_entry__
from lodestone.queries import ORACLE_SQL, QUERIES
from lodestone.query_base import session

pytestmark = pytest.mark.skipif(not oracle.there, reason="no test tables")


@pytest.mark.parametrize("name", [k for k in QUERIES if k in ORACLE_SQL])
def test_matches_sql(spark, name):
    oracle.same(QUERIES[name](spark, oracle.SF), ORACLE_SQL[name])


def test_explain_row(spark):
    row = QUERIES["explain"](spark, oracle.SF).first().asDict()
    assert row["collection"] == "nation" and row["estimated_rows"] == 25 and row["scan"] == "FULL SCAN"
    assert row["join_1"].startswith("HASH JOIN") and row["join_1_cost"] == 30 and row["join_1_estimated_output"] == 25
    assert row["selectivity"] == 0.33 and row["estimated_after_filter"] == 8
    assert "Join" in session(spark, oracle.SF, "nation", "region").query("EXPLAIN SELECT n_name FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey").first().plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_reader(spark):
    plan = QUERIES["filter_compare"](spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_totalprice" in plan and "o_custkey" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize("name, node", [("join_hash_hint", "ShuffledHashJoin"), ("sub_not_in", "LeftAnti"), ("sub_in", "LeftSemi"), ("order_limit", "TakeOrderedAndProject")])
def test_plans(spark, name, node):
    assert node in QUERIES[name](spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()


def test_a_nested_loop_hint_makes_no_pairs_of_an_equi_join(spark):
    plan = QUERIES["join_nested_loop_hint"](spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "HashJoin" in plan
