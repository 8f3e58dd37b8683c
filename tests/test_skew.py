"""Hot keys take the split paths and give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import skew
from fieldloom.operators.skew import Running, Timeline, hot_keys, skew_join


def skewed_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else None if rng.random() < 0.2 else rng.randrange(1, 40)
        rows.append((i, key, rng.randrange(20), rng.randrange(-3, 5)))
    return rows


@pytest.fixture
def left(spark):
    return spark.createDataFrame(skewed_rows(), "id long, k long, t int, v int")


@pytest.fixture
def right(spark):
    return spark.createDataFrame([(k, f"n{k}") for k in range(0, 30)] + [(None, "null")], "k long, name string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_compressed_hot_key_is_split_at_the_default_limits(spark, tmp_path):
    # 20 million equal keys in a few kilobytes: only the rows tell
    path = str(tmp_path / "hot")
    spark.range(20_000_000).select(F.lit(7).alias("k"), (F.col("id") % 3).alias("t")).repartition(2).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "hot").glob("*.parquet"))
    assert size < 20_000_000
    table = spark.read.parquet(path)
    hot = hot_keys(table, ["k"])
    assert (hot.n_keys, hot.n_rows) == (1, 20_000_000)
    assert hot_keys(table.limit(1000), ["k"]) is None
    timeline = Timeline(table, ["k"], ["t"], hot)
    assert timeline.plain.isEmpty() and timeline.n_totals == 21


def test_hot_keys(left, tiny_limits):
    hot = {r["k"]: r["_key_rows"] for r in hot_keys(left, ["k"]).table.collect()}
    expected = {}
    for _, k, _, _ in skewed_rows():
        expected[k] = expected.get(k, 0) + 1
    assert hot == {k: n for k, n in expected.items() if n > 12}
    assert None in hot and 0 in hot


@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_more_hot_keys_than_a_broadcast_holds_are_all_split(spark, left, right, how, tiny_limits):
    spark.conf.set("spark.fieldloom.skew.broadcastRows", "0")
    try:
        split = skew_join(left, right, ["k"], how, ["id"])
        assert rows(split.select(*left.columns)) == rows(left.join(right, ["k"], how).select(*left.columns))
        assert sorted(map(tuple, running(left).rows().select("id", "s").collect())) == sorted(
            map(tuple, running(left.coalesce(1)).rows().select("id", "s").collect()))
    finally:
        spark.conf.unset("spark.fieldloom.skew.broadcastRows")


def test_numbered_descending_by_any_type(left, tiny_limits):
    named = left.withColumn("name", F.concat(F.lit("n"), "t"))
    got = Timeline(named, ["k"], [F.desc_nulls_last("name"), F.col("id")]).numbered("place").rows().collect()
    expected, seen = set(), {}
    for r in sorted(named.collect(), key=lambda r: ([-ord(c) for c in r["name"]] + [0], r["id"])):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        expected.add((r["id"], seen[r["k"]]))
    assert {(r["id"], r["place"]) for r in got} == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join(left, right, how, tiny_limits):
    split = skew_join(left, right, ["k"], how, ["id"])
    plain = left.join(right, ["k"], how)
    assert rows(split.select(*plain.columns)) == rows(plain)
    if how in ("inner", "left"):
        assert "_salt" in split._jdf.queryExecution().toString()


def test_join_rejects_right_driven_types(left, right):
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "full", ["id"])


def running(df):
    timeline = Timeline(df, ["k"], ["t", "id"])
    timeline.running(Running("s", F.sum, F.col("v")), Running("before", F.sum, F.col("v"), inclusive=False)).keep()
    return timeline.running(
        Running("low", F.min, F.col("s"), inclusive=False), Running("top", F.max, F.struct("v", "id")))


def test_running_aggregates(spark, left, tiny_limits):
    split = running(left)
    assert split.blocks is not None
    expected, sums, lows, tops = [], {}, {}, {}
    for i, k, t, v in sorted(skewed_rows(), key=lambda r: (r[2], r[0])):
        before, low = sums.get(k), lows.get(k)
        sums[k] = (before or 0) + v
        tops[k] = max(tops.get(k, (v, i)), (v, i))
        expected.append((i, k, t, v, sums[k], before or 0, low, tops[k]))
        lows[k] = sums[k] if low is None else min(low, sums[k])
    got = [(*r[:5], r[5] or 0, r[6], tuple(r[7])) for r in split.rows().collect()]
    assert sorted(got) == sorted(expected, key=lambda r: r[0])


def test_blocks_are_small(left, tiny_limits):
    timeline = Timeline(left, ["k"], ["t", "id"])
    sizes = timeline.blocks.groupBy("k", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] < 60  # key 0 alone has about 160 rows
    assert timeline.plain.filter("k = 0 OR k IS NULL").isEmpty()


@pytest.mark.parametrize("many", [0, 256])
def test_hot_keys_are_those_with_too_many_rows(spark, tiny_limits, monkeypatch, many):
    """Buckets that keys share in the first count add no key and lose none."""
    monkeypatch.setattr(skew, "PROBES", 5)
    monkeypatch.setattr(skew, "MANY", many)
    df = spark.createDataFrame([(k,) for k in [*range(40), *[7] * 30, *[None] * 20, *[9] * 11]], "k long")
    hot = skew.hot_keys(df, ["k"])
    assert {(r["k"], r[skew.ROWS]) for r in hot.table.collect()} == {(7, 31), (None, 20)} and hot.n_rows == 51
    assert skew.hot_keys(df.filter("k < 7"), ["k"]) is None
