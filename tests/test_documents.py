"""Document expressions and edits, with the carried-over 18-key resume."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

import simulation
from fieldloom.functions import documents as docs
from fieldloom.functions import text
from fieldloom.functions.numbers import round2
from fieldloom.operators import resumes
from fieldloom.sources import tables

RESUME = {
    "name": "张三", "email": "zhangsan@example.com", "phone": "13800138000", "address": "北京市朝阳区",
    "self_introduction": "具有5年Python开发经验的软件工程师", "university": "清华大学", "degree": "本科",
    "major": "计算机科学与技术", "education_start_date": "2015-09", "education_end_date": "2019-07",
    "current_company": "阿里巴巴", "current_position": "Python开发工程师", "work_start_date": "2019-07",
    "work_end_date": "2024-01", "responsibilities": "开发Web应用，优化数据库性能",
    "achievements": "提升系统性能30%", "programming_languages": "Python", "frameworks": "Django",
}


def documents_frame(spark, rows, schema, *columns):
    """A frame whose document columns go in as JSON text, which keeps their key order."""
    at = [s.split()[0] for s in schema.split(", ")]
    coded = [tuple(json.dumps(v) if n in columns and v is not None else v for n, v in zip(at, row)) for row in rows]
    df = spark.createDataFrame(coded, schema)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), docs.parse_document(F.col(c))) for c in columns})


def one(spark, fields):
    return documents_frame(spark, [(1, 7, fields)], "resume_id long, user_id long, fields string", "fields")


def items(df):
    """Owner to the document's entries in order."""
    rows = df.select("resume_id", "user_id", F.map_entries("fields").alias("e")).collect()
    return {(r.resume_id, r.user_id): [tuple(e) for e in r.e] for r in rows}


def test_text_keeps_document_order(spark):
    got = one(spark, RESUME).select(docs.resume_text(F.col("fields"))).first()[0]
    assert got == "\n".join(f"{k}: {v}" for k, v in RESUME.items())


@pytest.mark.parametrize("fields,expected", [
    ({"a": " ", "b": "　\t", "c": "x "}, "c: x "), ({}, ""), (None, "")])
def test_blank_values_drop_out(spark, fields, expected):
    assert one(spark, fields).select(docs.resume_text(F.col("fields"))).first()[0] == expected


def test_categories(spark):
    df = one(spark, RESUME).select(resumes.categorised(F.col("fields")).alias("c"))
    got = df.first()[0]
    assert df.select(F.map_keys("c")).first()[0] == ["personal", "education", "experience", "skills", "其他"]
    assert set(got["skills"]) == {"programming_languages", "frameworks"}
    assert sum(map(len, got.values())) == 18 and len(got["其他"]) == 7
    bare = one(spark, {"name": "x"}).select(resumes.categorised(F.col("fields"))).first()[0]
    assert bare == {"personal": {"name": "x"}, "education": {}, "experience": {}, "skills": {}}
    assert one(spark, {}).select(resumes.categorised(F.col("fields"))).first()[0] == {}


def test_search(spark):
    df = one(spark, {"hobby": "100%_Sure"})
    assert resumes.search_resumes(df, "hobby", "%_SURE").count() == 1
    assert resumes.search_resumes(df, "hobby", "1_0").count() == 0
    assert resumes.search_resumes(df, "absent", "").count() == 0


EDITS = ("request_id long, resume_id long, user_id long, patch string, field_key string, "
         "requested_at timestamp_ntz")


def test_patch_and_delete_of_the_fixture(spark):
    patch = {"skills": "Python, Django, FastAPI, Vue.js", "hobby": "阅读, 旅行, 编程"}
    at = dt.datetime(2024, 1, 1)
    edits = documents_frame(
        spark,
        [(1, 1, 7, patch, None, at), (2, 1, 7, None, "hobby", at), (3, 1, 8, patch, None, at), (4, 1, 7, {}, None, at)],
        EDITS, "patch")
    changes = resumes.edit_fields(one(spark, RESUME), edits)
    assert items(changes.resumes)[1, 7] == [*RESUME.items(), ("skills", patch["skills"])]
    assert {r.request_id: r.verdict for r in changes.verdicts.collect()} == {
        1: "ok", 2: "ok", 3: "not_found", 4: "empty_patch"}


def check_edits(spark, seed):
    rng = random.Random(seed)
    keys = "abcdefg"
    documents = {(i, i % 5): {k: f"{k}{i}" for k in rng.sample(keys, rng.randrange(5))} for i in range(12)}
    edits = []
    for i in range(220):
        resume = 0 if rng.random() < 0.4 else rng.randrange(13)
        user = resume % 5 if rng.random() < 0.9 else 9
        merge = rng.random() < 0.6
        patch = {k: f"{k}-{i}" for k in rng.sample(keys, rng.randrange(4))} if merge else None
        edits.append((i, resume, user, patch, None if merge else rng.choice(keys),
                      dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(30))))
    df = documents_frame(spark, [(r, u, d) for (r, u), d in documents.items()],
                         "resume_id long, user_id long, fields string", "fields")
    ef = documents_frame(spark, edits, EDITS, "patch")
    changes = resumes.edit_fields(df, ef)
    state, verdicts = simulation.edit(documents, edits)
    assert items(changes.resumes) == {owner: list(doc.items()) for owner, doc in state.items()}
    assert {r.request_id: r.verdict for r in changes.verdicts.collect()} == verdicts


@pytest.mark.parametrize("seed", range(3))
def test_edits(spark, seed):
    check_edits(spark, seed)


def test_edits_of_hot_resumes(spark, tiny_limits):
    check_edits(spark, 5)


def test_stamps_of_edits_that_change_nothing(spark):
    at = {y: dt.datetime(y, 1, 1) for y in range(2019, 2025)}
    df = spark.createDataFrame([(r, 1, {"a": "1"}, at[2019]) for r in range(5)],
                               f"resume_id long, user_id long, fields {docs.DOCUMENT}, updated_at timestamp_ntz")
    edits = [(1, 0, 1, {"b": "2"}, None, at[2021]), (2, 0, 1, None, "x", at[2022]),     # absent key: no stamp
             (3, 1, 1, None, "a", at[2021]), (4, 1, 1, None, "a", at[2023]),            # gone already
             (5, 2, 1, None, "x", at[2022]),                                            # never there
             (6, 3, 1, {"n": "1"}, None, at[2020]), (7, 3, 1, None, "n", at[2021]), (8, 3, 1, None, "n", at[2022]),
             (9, 4, 1, {}, None, at[2024])]                                             # empty patch
    ef = spark.createDataFrame(edits, f"request_id long, resume_id long, user_id long, patch {docs.DOCUMENT}, "
                                      "field_key string, requested_at timestamp_ntz")
    got = {r["resume_id"]: (r["fields"], r["updated_at"].year) for r in resumes.edit_fields(df, ef).resumes.collect()}
    assert got == {0: ({"a": "1", "b": "2"}, 2021), 1: ({}, 2021), 2: ({"a": "1"}, 2019), 3: ({"a": "1"}, 2021),
                   4: ({"a": "1"}, 2019)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pages_of_any_depth_and_type(spark, tiny_limits, kind):
    rng = random.Random(3)
    order = "seq" if kind == "long" else "title"
    rows = [(i, 0 if i % 3 else i % 7, rng.choice([None, *"abcdefgh"]), {"a": "1"}, rng.choice([None, -(2**63), 2**63 - 1, *range(9)]))
            for i in range(120)]
    df = spark.createDataFrame(rows, f"resume_id long, user_id long, title string, fields {docs.DOCUMENT}, seq long")
    at = 4 if kind == "long" else 2
    for skip, limit in ((0, 5), (5, 20), (50, 100)):
        expected = set()
        for user in {r[1] for r in rows}:
            own = [r for r in rows if r[1] == user]
            newest = sorted((r for r in own if r[at] is not None), key=lambda r: r[0])
            newest = sorted(newest, key=lambda r: r[at], reverse=True) + [r for r in own if r[at] is None]
            expected |= {(r[0], n) for n, r in enumerate(newest, 1) if skip < n <= skip + limit}
        page = resumes.resume_page(df, skip=skip, limit=limit, newest_by=order)
        assert {(r["resume_id"], r["position"]) for r in page.collect()} == expected
    with pytest.raises(ValueError):
        resumes.resume_page(df, limit=101)


def test_repeated_json_keys_keep_the_first_place_and_the_last_value(spark):
    texts = ['{"a":"1","b":"2","a":"3"}', '{"a":"1"}', '{}', 'null', None, '{"x":null,"x":"y","z":"w","x":null}']
    df = tables.resumes(spark.createDataFrame(list(enumerate(texts)), "resume_id long, fields string"))
    got = {r["resume_id"]: list(r["fields"].items()) for r in df.collect()}
    assert got == {0: [("a", "3"), ("b", "2")], 1: [("a", "1")], 2: [], 3: [], 4: [], 5: [("x", None), ("z", "w")]}
    merged = df.select(docs.merged(df["fields"], docs.parse_document(F.lit('{"a":"9","a":"8"}'))).alias("m")).collect()
    assert merged[0]["m"] == {"a": "8", "b": "2"}


def test_update_and_delete(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    state = spark.createDataFrame(
        [(1, 7, "old", {"a": "1"}, at[0]), (2, 7, "keep", {"b": "2"}, at[0])],
        f"resume_id long, user_id long, title string, fields {docs.DOCUMENT}, updated_at timestamp_ntz")
    requests = spark.createDataFrame(
        [(1, 1, 7, True, None, False, None, at[1]), (2, 1, 7, False, "x", True, {"c": "3"}, at[2]),
         (3, 2, 8, True, "stolen", True, {}, at[3])],
        "request_id long, resume_id long, user_id long, has_title boolean, title string, has_fields boolean, "
        f"fields {docs.DOCUMENT}, requested_at timestamp_ntz")
    changes = resumes.update_resumes(state, requests)
    got = {r.resume_id: (r.title, r.fields, r.updated_at) for r in changes.resumes.collect()}
    assert got == {1: (None, {"c": "3"}, at[2]), 2: ("keep", {"b": "2"}, at[0])}
    assert {r.request_id: r.verdict for r in changes.verdicts.collect()} == {1: "ok", 2: "ok", 3: "not_found"}
    gone = resumes.delete_resumes(state, requests)
    assert [r.resume_id for r in gone.resumes.collect()] == [2]
    assert {r.request_id: r.verdict for r in gone.verdicts.collect()} == {1: "ok", 2: "not_found", 3: "not_found"}


def test_strip_blank_and_literal(spark):
    values = ["it's", "a\"b'c", "tab\t nl\n 　x\xa0\U0001f600\x01 \\", "  　 ", "\x1c a \n", "", "\x85é "]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    s = F.col("s")
    for row in df.select(s, text.strip(s).alias("p"), text.is_blank(s).alias("b"), text.quoted(s).alias("q")).collect():
        assert row.p == row.s.strip() and row.b == (not row.s.strip()) and row.q == repr(row.s)
    lists = spark.createDataFrame([(["高中", "it's"],), ([],)], "o array<string>")
    assert [r[0] for r in lists.select(text.list_literal(F.col("o"))).collect()] == [repr(["高中", "it's"]), "[]"]


def test_rounding(spark):
    ratios = sorted({a / b for b in range(1, 201) for a in range(0, b + 20)})
    rows = spark.createDataFrame([(x,) for x in ratios], "x double").select("x", round2(F.col("x")).alias("y")).collect()
    assert all(round(r.x, 2) == r.y for r in rows)
