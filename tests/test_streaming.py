"""Streams fed in several arrivals give the batch result, also after a repeated batch."""

import os
import re
import tempfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import codes, quota
from fieldloom.plans.catalog import QUERIES
from fieldloom.sources import tables
from fieldloom.streaming import runs, stateful, usage
from fieldloom.streaming.state import FAN, StreamState
from small_data import SMALL
from test_quota import frames, moment, redemption, redemption_frames, timelines

CUTS = [0, 9, 17, 30, 99]


def arrivals(spark, df, at, folder, advance):
    """Land df in slices of time and run the stream after each."""
    result = None
    for low, high in zip(CUTS, CUTS[1:]):
        tables.append_table(df.filter((df[at] >= moment(low)) & (df[at] < moment(high))), f"{folder}/landing")
        result = advance(tables.stream_table(spark, f"{folder}/landing", df.schema))
    return result


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def check_ledger(spark, folder):
    g, u = frames(spark, *timelines(31, n=150))
    got = arrivals(spark, quota.quota_events(g, u), "event_at", folder,
                   lambda s: stateful.stream_quota_ledger(s, folder))
    assert got.filter("late").count() == 0 and rows(got.drop("late")) == rows(quota.quota_ledger(g, u))


def test_quota_ledger(spark, folder):
    check_ledger(spark, folder)


def test_quota_ledger_with_hot_users(spark, folder, tiny_limits):
    check_ledger(spark, folder)


def test_redeem(spark, folder):
    requests, table, grants = redemption(41)
    r, c, g = redemption_frames(spark, requests, table, grants)
    got = arrivals(spark, r, "requested_at", folder, lambda s: stateful.stream_redeem(s, c, g, folder))
    assert rows(got) == rows(codes.redeem_codes(r, c, g).verdicts)


def test_repeated_batch_changes_nothing(spark, folder, monkeypatch):
    """The step of every batch runs twice, as after a failure between step and commit."""
    each = runs.each_batch

    def twice(stream, where, step, mode="append"):
        def again(batch, batch_id):
            step(batch, batch_id)
            step(batch, batch_id)
        each(stream, where, again, mode)

    monkeypatch.setattr(runs, "each_batch", twice)
    check_ledger(spark, folder)
    requests, table, grants = redemption(43)
    r, c, g = redemption_frames(spark, requests, table, grants)
    other = os.path.join(folder, "redeem")
    got = arrivals(spark, r, "requested_at", other, lambda s: stateful.stream_redeem(s, c, g, other))
    assert rows(got) == rows(codes.redeem_codes(r, c, g).verdicts)


def test_match_stats(spark, folder):
    logs = spark.createDataFrame(
        [(i, i % 4, "u", 1 + i % 3, i % 2, moment(i % 40)) for i in range(90)],
        "log_id long, user_id long, website_url string, fields_count int, success_count int, used_at timestamp_ntz")
    got = arrivals(spark, logs, "used_at", folder, lambda s: usage.stream_match_stats(s, folder))
    expected = logs.groupBy("user_id").agg({"*": "count", "fields_count": "sum", "success_count": "sum"}).collect()
    assert {r.user_id: (r.total_uses, r.total_fields, r.total_successes) for r in got.collect()} == {
        r["user_id"]: (r["count(1)"], r["sum(fields_count)"], r["sum(success_count)"]) for r in expected}


def test_streams_over_a_file_and_over_a_folder_of_files(spark, folder):
    """A source that is a folder of files streams all of its rows."""
    for source in ("conversations", "events"):
        spark.read.parquet(f"{SMALL}/{source}.parquet").repartition(3).write.parquet(f"{folder}/{source}.parquet")
    for name in ("stream_extract_matches", "stream_match_stats", "stream_daily_usage"):
        got = rows(QUERIES[name](spark, folder))
        assert got and got == rows(QUERIES[name](spark, SMALL))


def test_extract_matches_without_a_match(spark, folder):
    schema = "request_id long, status_code int, output_text string"
    tables.append_table(spark.createDataFrame([(1, 200, "no array here"), (2, 500, "[{}]")], schema), f"{folder}/landing")
    got = usage.stream_extract_matches(tables.stream_table(spark, f"{folder}/landing", schema), folder)
    assert got.columns == ["request_id", "pos", "field_name", "field_type", "matched_value"] and got.count() == 0


def test_steps_run_with_adaptive_execution(spark, folder):
    seen = []
    tables.append_table(spark.range(5), f"{folder}/landing")
    stream = tables.stream_table(spark, f"{folder}/landing", "id long")
    runs.each_batch(stream, folder, lambda batch, _: seen.append(
        (batch.count(), batch.sparkSession.conf.get("spark.sql.adaptive.enabled"))))
    assert seen == [(5, "true")]


def dealt(spark, df, n, folder, advance):
    """Land df in n arrivals by a hash, so out of order in time; the last one ends the stream."""
    for i in range(n):
        tables.append_table(df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == i), f"{folder}/landing")
        result = advance(tables.stream_table(spark, f"{folder}/landing", df.schema), i == n - 1)
    return result


def test_arrivals_in_any_order_within_the_delay(spark, folder):
    g, u = frames(spark, *timelines(37, n=80))
    week = timedelta(days=10_000)
    got = dealt(spark, quota.quota_events(g, u), 3, folder,
                lambda s, last: stateful.stream_quota_ledger(s, folder, week, last))
    assert got.filter("late").count() == 0 and rows(got.drop("late")) == rows(quota.quota_ledger(g, u))
    r, c, held = redemption_frames(spark, *redemption(47))
    other = os.path.join(folder, "redeem")
    got = dealt(spark, r, 3, other, lambda s, last: stateful.stream_redeem(s, c, held, other, week, last))
    assert rows(got) == rows(codes.redeem_codes(r, c, held).verdicts)


def test_late_events_are_named_and_change_nothing(spark, folder):
    """Events behind the watermark come out as late; all others equal the batch over the others."""
    g, u = frames(spark, *timelines(39, n=80))
    events = quota.quota_events(g, u)
    behind = F.col("event_id") % 5 == 1
    for part in (events.filter(~behind), events.filter(behind)):
        tables.append_table(part, f"{folder}/landing")
        got = stateful.stream_quota_ledger(tables.stream_table(spark, f"{folder}/landing", events.schema), folder)
    seen = events.filter(~behind).agg(F.max("event_at")).first()[0]
    late = behind & (F.col("event_at") <= F.lit(seen))
    on_time = quota.ledger_timeline(events.filter(~late)).rows().filter("kind = 1").select("event_id", "user_id", "event_at", "ok", "balance")
    assert rows(got.filter("not late").drop("late")) == rows(on_time)
    refused = got.filter("late").collect()
    assert {r["use_id"] for r in refused} == {r["event_id"] for r in events.filter(late & (F.col("kind") == 1)).collect()}
    assert refused and all(r["ok"] is None and r["balance"] is None for r in refused)


def test_held_events_are_written_once_until_some_are_due(spark, folder):
    schema = "user_id long, event_at timestamp_ntz, kind int, event_id long, delta long"
    arrived = [[(1, moment(5), 0, 1, 3)], [(1, moment(6), 1, 2, -1)], [(1, moment(30), 1, 3, -1)]]
    held = []
    for batch in arrived:
        tables.append_table(spark.createDataFrame(batch, schema), f"{folder}/landing")
        got = stateful.stream_quota_ledger(tables.stream_table(spark, f"{folder}/landing", schema), folder, moment(24) - moment(0))
        held.append([run for run, _ in StreamState.latest(spark, folder).held])
    # the second batch wrote its own event only, the third released both runs
    assert held == [["0"], ["0", "1"], ["2"]]
    assert rows(got.select("use_id", "ok", "balance")) == [(2, True, 2)]
    # nothing came due in the first two, so they left no balances
    assert [run for _, run in StreamState.latest(spark, folder).logs["balances"]] == ["2"]
    ended = stateful.stream_quota_ledger(tables.stream_table(spark, f"{folder}/landing", schema), folder, moment(24) - moment(0), final=True)
    assert rows(ended.select("use_id", "ok", "balance")) == [(2, True, 2), (3, True, 1)]


def test_an_end_is_taken_back_by_a_later_arrival(spark, folder):
    g, u = frames(spark, *timelines(53, n=60))
    events, delay = quota.quota_events(g, u), timedelta(days=10_000)
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        tables.append_table(events.filter(part), f"{folder}/landing")
        got = stateful.stream_quota_ledger(tables.stream_table(spark, f"{folder}/landing", events.schema), folder, delay, final=True)
    assert rows(got.drop("late")) == rows(quota.quota_ledger(g, u))


def test_a_batch_of_one_user_reads_and_writes_one_row_of_state(spark, folder):
    events = "user_id long, event_at timestamp_ntz, kind int, event_id long, delta long"
    many = [(i, moment(1), 0, i, 3) for i in range(500)]
    for batch in (many, [(7, moment(5), 1, 1000, -1)]):
        tables.append_table(spark.createDataFrame(batch, events), f"{folder}/landing")
        stateful.stream_quota_ledger(tables.stream_table(spark, f"{folder}/landing", events), folder)
    written = spark.read.parquet(f"{folder}/state/balances")
    assert {r["_version"]: r["count"] for r in written.groupBy("_version").count().collect()} == {0: 500, 1: 1}
    balances = {r["user_id"]: r["balance"] for r in stateful.quota_balances(spark, folder).collect()}
    assert len(balances) == 500 and balances[7] == 2 and balances[8] == 3
    one = StreamState.latest(spark, folder).log("balances", ["user_id"], "user_id long, balance long").lookup(
        spark.createDataFrame([(7,)], "user_id long"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan) and one.count() == 1


def test_redeeming_reads_no_earlier_verdict(spark, folder):
    r, c, held = redemption_frames(spark, *redemption(59))
    cut = r.agg(F.percentile_approx("requested_at", 0.5)).first()[0]
    tables.append_table(r.filter(F.col("requested_at") <= F.lit(cut)), f"{folder}/landing")
    stateful.stream_redeem(tables.stream_table(spark, f"{folder}/landing", r.schema), c, held, folder)
    first = spark.read.parquet(f"{folder}/verdicts/batch=0").collect()
    os.rename(f"{folder}/verdicts", f"{folder}/away")
    tables.append_table(r.filter(F.col("requested_at") > F.lit(cut)), f"{folder}/landing")
    second = stateful.stream_redeem(tables.stream_table(spark, f"{folder}/landing", r.schema), c, held, folder)
    columns = second.columns
    both = [tuple(x[k] for k in columns) for x in first] + [tuple(x) for x in second.collect()]
    assert sorted(both, key=str) == rows(codes.redeem_codes(r, c, held).verdicts)


def log_of(spark, folder, batch_id):
    state = StreamState(spark, folder, batch_id)
    return state, state.log("t", ["k"], "k long, v long")


def test_runs_are_merged_and_old_ones_removed(spark, folder):
    expected, n = {}, 2 * FAN + 5
    for batch_id in range(n):
        state, log = log_of(spark, folder, batch_id)
        changed = {batch_id % 7: batch_id, 100 + batch_id: batch_id, None: -batch_id}
        log.put(spark.createDataFrame(list(changed.items()), "k long, v long"))
        state.commit()
        expected.update(changed)
    state, log = log_of(spark, folder, n)
    assert {r["k"]: r["v"] for r in log.read().collect()} == expected
    wanted = spark.createDataFrame([(3,), (None,), (777,)], "k long")
    assert {r["k"]: r["v"] for r in log.lookup(wanted).collect()} == {3: expected[3], None: expected[None]}
    assert [level for level, _ in log.runs] == [1, 1, *[0] * 5]
    kept = {f for f in os.listdir(f"{folder}/state/t") if f.startswith("_run=")}
    assert len(kept) <= 2 * FAN and {f"_run={run}" for _, run in log.runs} <= kept
    assert len(os.listdir(f"{folder}/manifest")) <= 6     # two manifests with their checksums


def test_a_batch_that_dies_before_its_manifest_leaves_the_old_state(spark, folder):
    for batch_id, value in ((0, 1), (1, 2)):
        state, log = log_of(spark, folder, batch_id)
        log.put(spark.createDataFrame([(5, value)], "k long, v long"))
        if batch_id == 0:
            state.commit()
    assert [tuple(r) for r in StreamState.latest(spark, folder).log("t", ["k"], "k long, v long").read().collect()] == [(5, 1)]
    state, log = log_of(spark, folder, 1)
    log.put(spark.createDataFrame([(5, 3)], "k long, v long"))
    state.commit()
    assert [tuple(r) for r in StreamState.latest(spark, folder).log("t", ["k"], "k long, v long").read().collect()] == [(5, 3)]
