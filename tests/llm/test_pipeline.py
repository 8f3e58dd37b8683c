"""The pipeline against plain-Python versions of its stages."""

from collections import Counter

from llm_helpers import frame, groups, lower, shingle_set
from test_decontaminate import verdict

import corpus_pipeline as p
from fieldloom.llm.tokens import load_tokenizer, tokenizer_path

SMALL = "/root/testdata/sf0.001"


def expected(docs, items):
    """Ids of the documents that reach packing."""
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    last = {}
    for i, t in docs:
        last[lower(t)] = max(i, last.get(lower(t), i))
    docs = [(i, t) for i, t in docs if last[lower(t)] == i]
    sets = [shingle_set(t, 5) for _, t in docs]
    root = groups(len(docs), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[a]))
    first = {}
    for k, (i, _) in enumerate(docs):
        first[root[k]] = min(i, first.get(root[k], i))
    docs = [(i, t) for k, (i, t) in enumerate(docs) if first[root[k]] == i]
    return {i: t for i, t in docs if not any(verdict(t, item) for item in items)}


def test_run(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = expected(docs, items)
    got = p.run(spark, SMALL).collect()
    tokenizer = load_tokenizer(tokenizer_path())
    tokens = Counter()
    for r in got:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {i: len(tokenizer.encode(t, allowed_special="all")) + 1 for i, t in kept.items()}


def test_stages(spark):
    assert [name for name, _ in p.STAGES] == ["language", "exact", "near", "benchmarks", "packing"]
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    docs = frame(spark, (1, None, "en", "s"), (2, "123", "en", "s"), (3, "Good words here", None, "s"), (4, "good WORDS here", "en", None),
                 (5, f"before {benchmark} after", "en", "s"), (None, "without an id", None, None))
    for name, stage in p.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["4", "None"]
    assert {r["doc_id"] for r in p.STAGES[-1][1](spark, docs, SMALL).collect()} == {4, None}


def test_no_documents(spark):
    empty = frame(spark)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0
