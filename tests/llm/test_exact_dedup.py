import hashlib
from collections import defaultdict

import pytest
from llm_helpers import DOC_SCHEMA, documents, frame, lower

from fieldloom.llm.exact_dedup import digest_verdicts, exact_dedup, tree_shape

CASES = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "other"), (5, None), (6, ""), (7, "ÉCOLE"), (8, "école"),
    (9, "repeat"), (9, "repeat"), (None, "same text"), (None, "alone"), (10, "long " * 50_000), (11, "LONG " * 50_000),
]


def verdicts(df, keep):
    return [r.asDict() for r in digest_verdicts(df, keep=keep).collect()]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_special_cases(spark, keep):
    got = verdicts(frame(spark, *CASES), keep)
    assert len(got) == len(CASES)
    by_text = defaultdict(list)
    for i, text in CASES:
        by_text[hashlib.sha256(lower(text).encode()).digest()].append(i)
    for r in got:
        members = by_text[bytes(r["digest"])]
        known = [i for i in members if i is not None]
        choice = (max if keep == "largest" else min)(known) if known else None
        assert r["group_size"] == len(members)
        assert r["keep_id"] == choice
        if r["kept"]:
            assert r["id"] == choice
    for digest, members in by_text.items():
        assert sum(r["kept"] for r in got if bytes(r["digest"]) == digest) == 1


def test_rows_that_stay_keep_their_columns(spark):
    out = exact_dedup(frame(spark, *CASES), keep="largest")
    assert out.columns == DOC_SCHEMA.names
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert got == [(False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (False, 9), (False, 11), (True, 0)]


def test_empty_table(spark):
    assert digest_verdicts(frame(spark)).count() == 0
    assert exact_dedup(frame(spark)).count() == 0


def test_one_hot_text_over_many_partitions(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 700)) as text").repartition(13)
    by_text = df.groupBy("text").agg({"doc_id": "min", "*": "count"}).collect()
    got = {(r["keep_id"], r["group_size"]) for r in digest_verdicts(df).collect()}
    assert got == {(r["min(doc_id)"], r["count(1)"]) for r in by_text}


def test_tree_shape_covers_the_tasks():
    for tasks in (1, 2, 7, 12, 51, 211, 5000):
        rounds, k = tree_shape(tasks)
        assert k ** rounds >= tasks and k <= 8


def test_documents(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    best = defaultdict(int)
    for r in rows:
        best[lower(r["text"])] = max(best[lower(r["text"])], r["doc_id"])
    got = {r["id"]: r["keep_id"] for r in digest_verdicts(documents(spark), keep="largest").collect()}
    assert got == {r["doc_id"]: best[lower(r["text"])] for r in rows}


def test_one_task_reads_runs_of_one_text_in_descending_order(spark):
    limits = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        # the larger file, which is read first, holds the larger ids
        df = spark.range(0, 12_000, 1, 2).filter("id < 10 or id >= 6000").selectExpr("id as doc_id", "'hot' as text")
        for keep, best in (("largest", 11_999), ("smallest", 0)):
            got = digest_verdicts(df, keep=keep).groupBy("keep_id", "group_size").agg({"kept": "count"}).collect()
            assert [tuple(r) for r in got] == [(best, 6010, 6010)]
            assert [r["id"] for r in digest_verdicts(df, keep=keep).filter("kept").collect()] == [best]
    finally:
        for name in limits:
            spark.conf.unset(name)
