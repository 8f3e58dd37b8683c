import itertools

import pytest
from llm_helpers import DOC_SCHEMA, documents, frame
from pyspark.sql import functions as F

from fieldloom.llm.sharding import byte_shards, histogram_splitters


def check(df, n_shards, spread=None):
    out = byte_shards(df, n_shards).collect()
    assert len(out) == df.count()
    sizes = [0] * n_shards
    slots = {}
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if spread:
        assert max(sizes) - min(sizes) <= spread
    return out


def test_documents_are_balanced_and_in_order(spark):
    out = check(documents(spark), 8, spread=2 * 40_000)
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert ids == sorted(ids)


def test_special_cases(spark):
    out = byte_shards(frame(spark, (1, None), (None, "é"), (2, ""), (2, ""), (3, "z" * 100_000), (4, "x")), 3)
    assert out.columns == [c for c in DOC_SCHEMA.names if c != "slot"] + ["size", "shard", "slot"]
    check(frame(spark, (1, None), (None, "é"), (2, ""), (2, ""), (3, "z" * 100_000), (4, "x")), 3)
    assert byte_shards(frame(spark), 3).count() == 0
    check(frame(spark, (7, "one row")), 5)


def test_a_key_with_a_third_of_all_rows_is_divided(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    check(df, 10, spread=300)


@pytest.mark.parametrize("values", [[-(1 << 63), (1 << 63) - 1], [5], list(range(100)), [0] * 50 + [1]])
def test_splitters_count_exactly(spark, values):
    table = spark.createDataFrame([(v, 0, 10) for v in values], "_major long, _minor long, _size long")
    found = histogram_splitters(table, 4)
    assert found.total_rows == len(values)
    below = lambda k: sum(((v + (1 << 63)) << 64) + (1 << 63) < k for v in values)
    assert found.rows == [below(k) for k in found.keys]
    assert all(a <= b for a, b in itertools.pairwise(found.keys))
