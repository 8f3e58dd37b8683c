import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from llm_helpers import documents, frame

from fieldloom.llm.materialize import feistel, materialise, read_slots, training_order
from fieldloom.llm.tokens import load_tokenizer, tokenizer_path
from fieldloom.session import work_dir


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    a, b = feistel(np.arange(n), n, 7), feistel(np.arange(n), n, 8)
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    if n >= 17:
        assert (a != b).any() and (a != np.arange(n)).any()
    # a slot depends on the number alone, not on its neighbours
    assert feistel(np.array([n - 1]), n, 7)[0] == a[n - 1]


def sequences(docs, length):
    tokenizer = load_tokenizer(tokenizer_path())
    out = Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", allowed_special="all"), 0]
        for s in range(0, len(ids), length):
            piece = ids[s:s + length]
            out[(i, s // length, len(piece), np.array(piece + [0] * (length - len(piece)), "<u2").tobytes())] += 1
    return out


def check(spark, df, length, per_shard):
    folder = work_dir(spark, "order-test")
    manifest = materialise(df, folder, 11, length=length, per_shard=per_shard).collect()
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    wanted = sequences(docs, length)
    n = sum(wanted.values())
    assert sum(m["sequences"] for m in manifest) == n
    held = {}
    for m in manifest:
        with open(f"{folder}/{m['file']}", "rb") as f:
            data = f.read()
        assert len(data) == m["sequences"] * 2 * length and hashlib.sha256(data).hexdigest() == m["sha256"]
        for k in range(m["sequences"]):
            held[m["first_slot"] + k] = data[k * 2 * length:(k + 1) * 2 * length]
    assert sorted(held) == list(range(n))
    index = spark.read.parquet(f"{folder}/_index").collect()
    assert Counter((r["id"], r["sequence"], r["tokens"], held[r["slot"]]) for r in index) == wanted
    half = n // 2
    rest = {r["slot"]: r["ids"] for r in read_slots(spark, folder, length, per_shard, from_slot=half).collect()}
    assert rest == {s: d for s, d in held.items() if s >= half}
    assert not [f for f in os.listdir(folder) if f.startswith("_writing")]


def test_special_cases(spark):
    cases = [(1, None), (2, ""), (3, "word " * 5_000), (4, "x"), (4, "x"), (None, "no id"), (5, "é ü 日本")]
    check(spark, frame(spark, *cases), 16, 10)
    assert training_order(frame(spark), 1).count() == 0


def test_documents(spark):
    check(spark, documents(spark), 512, 64)
