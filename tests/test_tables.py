"""Readers, sinks, conforming and migrations."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fieldloom import dimensions, schemas, session
from fieldloom.functions import documents as docs
from fieldloom.operators import accounts, integrity, lookup, resumes
from fieldloom.sources import tables

AT = dt.datetime(2024, 1, 1, 10)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def log_frame(spark, rows):
    return spark.createDataFrame(rows, "request_id long, user_id long, website_url string, total_fields long, "
                                       "success_count int, requested_at timestamp_ntz")


def test_log_rows_default_their_url(spark):
    rows = tables.usage_log_rows(log_frame(spark, [
        (1, 7, None, 3, 2, AT), (2, 7, "", 3, 0, AT), (3, 7, "https://a", 3, 4, AT)])).orderBy("log_id").collect()
    assert [r.website_url for r in rows] == ["unknown", "unknown", "https://a"]
    assert [r.success_count for r in rows] == [2, 0, 4]


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_append_and_read_back(spark, folder, format):
    logs = tables.usage_log_rows(log_frame(spark, [(1, 7, "u", 3, 2, AT), (2, 8, "v", 3, 2, AT)]))
    for _ in range(2):
        tables.append_table(logs, f"{folder}/logs", format=format)
    back = tables.usage_logs(tables.read_table(spark, f"{folder}/logs", logs.schema, format))
    assert back.columns == [f.name for f in schemas.USAGE_LOGS]
    assert sorted(map(tuple, back.collect())) == sorted(2 * [tuple(r) for r in logs.collect()])


def test_partitioned_append_prunes_folders(spark, folder):
    logs = tables.usage_log_rows(log_frame(spark, [(i, i, "u", 3, 2, AT + dt.timedelta(days=i)) for i in range(4)]))
    tables.append_table(logs.withColumn("day", F.to_date("used_at")), f"{folder}/logs", ["day"])
    one_day = tables.read_table(spark, f"{folder}/logs").filter("day = date '2024-01-02'")
    assert [r.log_id for r in one_day.collect()] == [1]
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_version_is_overwritten(spark, folder):
    for n in (3, 2):
        tables.write_version(spark.range(n), f"{folder}/state/1")
    assert tables.read_table(spark, f"{folder}/state/1").count() == 2


def test_users_are_public_and_normalised(spark):
    raw = spark.createDataFrame([(1, "a@x", "secret", "ACTIVE")], "user_id int, email string, password_hash string, status string")
    got = tables.users(raw)
    assert "password_hash" not in got.columns
    assert got.first().asDict() == {"user_id": 1, "email": "a@x", "status": "active"}


def test_insert_if_absent(spark):
    existing = spark.createDataFrame([("A", 10), ("B", 1)], "code string, total_uses int")
    seed = spark.createDataFrame([("NEW", 12), ("NEW", 10), ("A", 99), (None, 1), (None, 1)], "code string, total_uses int")
    assert sorted(map(tuple, tables.insert_if_absent(existing, seed, "code", ["total_uses"]).collect()), key=str) == [
        ("A", 10), ("B", 1), ("NEW", 10), (None, 1), (None, 1)]


def test_login_gate(spark):
    users = spark.createDataFrame([(1, "a@x", "active"), (2, "b@x", "banned")], "user_id long, email string, status string")
    requests = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, "A@x")], "request_id long, email string")
    got = {r.request_id: r.gate for r in lookup.login_gate(requests, users).collect()}
    assert got == {1: "pass", 2: "invalid_credentials", 3: "invalid_credentials"}


def test_cascade_of_one_parent_only(spark):
    grants = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 2, 6)], "activation_id long, user_id long, code_id long")
    logs = spark.createDataFrame([(1, 1), (2, 2)], "log_id long, user_id long")
    docs_ = spark.createDataFrame([(1, 1)], "resume_id long, user_id long")
    children = {"user_activations": grants, "usage_logs": logs, "resumes": docs_}
    gone = spark.createDataFrame([(5,), (5,)], "code_id long")
    left = integrity.cascade_delete(children, deleted_codes=gone)
    assert [r.activation_id for r in left["user_activations"].collect()] == [3]
    assert left["usage_logs"].count() == 2 and left["resumes"].count() == 1


def test_timestamps_are_read_in_the_session_zone(spark):
    df = spark.sql("SELECT timestamp '2024-01-01 00:00:00Z' AS at")
    assert accounts.migrate_timestamps(df, "at").first()[0] == dt.datetime(2024, 1, 1)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert accounts.migrate_timestamps(df, "at").first()[0] == dt.datetime(2024, 1, 1, 8)
    finally:
        session.configure(spark)


def test_legacy_documents(spark):
    legacy = spark.createDataFrame(
        [(1, 7, '{"name":"a","x":"1"}', None, '{}', '{"x":"2","y":"3"}')],
        "resume_id long, user_id long, personal_info string, education string, experience string, skills string")
    plain = resumes.migrate_resumes(legacy)
    assert plain.columns == ["resume_id", "user_id", "title", "fields"] and plain.first().fields == {}
    filled = resumes.migrate_resumes(legacy, backfill=True).select(docs.resume_text(F.col("fields"))).first()[0]
    assert filled == "name: a\nx: 2\ny: 3"


def test_preset_groups(spark):
    groups = {r.group: [f.key for f in r.fields] for r in dimensions.preset_fields_by_group(spark).collect()}
    assert {g: len(keys) for g, keys in groups.items()} == {"personal": 7, "education": 7, "experience": 6, "skills": 5}
    assert groups["personal"][:3] == ["name", "email", "phone"]


def test_durable_folder(spark):
    folder = session.durable_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert session.work_dir(spark, "a").startswith(os.path.join(folder, "a-"))
    assert session.work_dir(spark, "a") != session.work_dir(spark, "a")
