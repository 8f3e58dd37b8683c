"""Whole queries on the paths for large inputs: every key is split, shared results are kept."""

import pytest

import __spark_entry__ as contract
from small_data import SMALL
from test_oracle import ordered

NAMES = (
    "active_user_gate", "already_redeemed", "cascade_delete", "login_gate", "match_forms", "match_forms_matches",
    "append_usage_log", "build_prompts", "merge_fields", "delete_field", "redeem_codes", "redeem_codes_state",
    "register_users", "register_users_rows", "update_users", "update_users_verdicts", "user_code_grants",
    "validate_code", "delete_resumes_verdicts", "deactivate_users_verdicts",
)


@pytest.fixture
def large_input_limits(spark):
    limits = {"groupRows": "20", "pieceRows": "40"}
    for name, value in limits.items():
        spark.conf.set(f"spark.fieldloom.skew.{name}", value)
    yield
    for name in limits:
        spark.conf.unset(f"spark.fieldloom.skew.{name}")


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, duck, large_input_limits):
    df = contract.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = ordered([[row[names.index(c)] for c in columns] for row in result.fetchall()])
    assert ordered(df.select(*columns).collect()) == expected
