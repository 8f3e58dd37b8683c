"""The plans keep what they should: pushdown, pruning, pre-aggregation, no pair joins."""

import re

import pytest

from small_data import SMALL
from fieldloom.operators import resumes, stats
from fieldloom.plans.catalog import QUERIES
from fieldloom.sources import derived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_pair_joins_and_no_single_task_windows(name, spark):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
    # only the four one-row counts of the integrity reports gather on one task
    singles = text.count("Exchange SinglePartition")
    assert singles <= {"fk_orphans": 4, "check_lengths": 5}.get(name, 0)


def test_filters_and_columns_reach_the_scan(spark):
    logs = derived.usage_logs(spark, SMALL)
    users = derived.users(spark, SMALL)
    text = plan(stats.match_stats(logs.filter("log_id > 10"), users))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(event_id,10\)", text)
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text
    assert "ReadSchema: struct<c_custkey:bigint>" in text
    assert "partial_sum" in text


def test_paging_prunes_before_the_shuffle(spark):
    text = plan(resumes.resume_page(derived.resumes(spark, SMALL), 0, 5, "updated_seq"))
    assert "WindowGroupLimit" in text


def test_repeated_windows_share_one_exchange(spark):
    text = plan(QUERIES["quota_ledger"](spark, SMALL))
    by_user = re.findall(r"Exchange hashpartitioning\(user_id", text)
    assert len(by_user) == 1
