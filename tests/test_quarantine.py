"""Broken documents stay as they are."""

from datetime import datetime

from fieldloom.operators import integrity, resumes
from fieldloom.sources import derived
from small_data import SMALL

TEXTS = {1: '{"a":"1","b":null}', 2: '{"a": ', 3: "", 4: "[1]", 5: None, 6: "null", 7: "plain é\ttext", 8: '{"a":"x"} '}
BROKEN = {2, 3, 4, 7}


def stored(spark):
    return spark.createDataFrame([(i, 9, t) for i, t in TEXTS.items()], "resume_id long, user_id long, fields string")


def edits(spark, *rows):
    schema = "request_id long, resume_id long, user_id long, patch map<string,string>, field_key string, requested_at timestamp_ntz"
    return spark.createDataFrame([(*r, datetime(2024, 1, 1)) for r in rows], schema)


def test_broken_documents_survive_edits(spark):
    asked = [(i, i, 9, {"c": "3"}, None) for i in TEXTS] + [(11, 2, 9, None, "a"), (12, 2, 8, {"c": "3"}, None), (13, 2, 9, {}, None)]
    changes = resumes.edit_stored(stored(spark), edits(spark, *asked))
    assert {r["resume_id"]: r["fields"] for r in changes.resumes.collect()} == {
        1: '{"a":"1","b":null,"c":"3"}', 5: '{"c":"3"}', 6: '{"c":"3"}', 8: '{"a":"x","c":"3"}', **{i: TEXTS[i] for i in BROKEN}}
    assert {r["request_id"]: r["verdict"] for r in changes.verdicts.collect()} == {
        **{i: "corrupt_document" if i in BROKEN else "ok" for i in TEXTS}, 11: "corrupt_document", 12: "not_found", 13: "empty_patch"}


def test_broken_documents_are_counted(spark):
    found = integrity.check_lengths({"resumes": stored(spark)}).filter("rule = 'json_object'").first()
    assert found["violations"] == len(BROKEN)


def test_empty_tables(spark):
    changes = resumes.edit_stored(stored(spark).limit(0), edits(spark, (1, 1, 9, {"c": "3"}, None)))
    assert changes.resumes.count() == 0 and changes.verdicts.first()["verdict"] == "not_found"


def test_check_rule_is_the_report_on_one_rule(spark):
    stored = derived.view(spark, SMALL, "stored_resumes")
    for df in (stored, stored.limit(0)):
        whole = integrity.check_lengths({"resumes": df}).filter("rule = 'json_object'").collect()
        one = integrity.check_rule("resumes", df, "json_object")
        assert one.columns == ["table_name", "column_name", "rule", "violations"]
        assert one.collect() == whole and len(whole) == 1
