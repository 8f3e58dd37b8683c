import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import documents, frame

from fieldloom.llm.packing import pack
from fieldloom.llm.tokens import load_tokenizer, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer(tokenizer_path())


def check(df, tokenizer, length, **options):
    """Every token is in exactly one piece, sequences are full, ids and checksums are right."""
    docs = [(r["doc_id"], tokenizer.encode(r["text"] or "", allowed_special="all") + [0]) for r in df.collect()]
    got = [r.asDict() for r in pack(df, length=length, **options).collect()]
    stream = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:
        assert r["sequence_id"] * length + r["offset"] == at and r["offset"] + r["length"] <= length and r["length"] > 0
        at += r["length"]
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert at == sum(len(ids) for _, ids in docs)
    pieces = Counter((r["id"], r["start"], r["length"], r["ids"]) for r in got)
    by_id = defaultdict(list)
    for (i, start, n, ids), times in pieces.items():
        by_id[i] += [(start, n, ids)] * times
    wanted = Counter((i, tuple(ids)) for i, ids in docs)
    for i in {i for i, _ in docs}:
        total = sum(len(ids) * n for (j, ids), n in wanted.items() if j == i)
        assert sum(n for _, n, _ in by_id[i]) == total
        for start, n, ids in by_id[i]:
            piece = tuple(np.frombuffer(ids, "<u4").tolist())
            assert any(doc[start:start + n] == piece for (j, doc) in wanted if j == i)
    return got


def test_special_cases(spark, tokenizer):
    cases = [(1, None, None, None), (2, "", None, "a"), (3, "word " * 20_000, None, "a"), (4, "x", None, "b"),
             (5, "same", None, "b"), (5, "same", None, "b"), (None, "no id", None, "c"), (6, "é ü", None, None)]
    check(frame(spark, *cases), tokenizer, 64, window=256, unit=16)
    check(frame(spark, *cases), tokenizer, 64, window=256, unit=16, weights={"a": 2.0, "b": 1.0, "rest": 1.0})
    assert pack(frame(spark)).count() == 0


def share(got, source):
    windows = defaultdict(Counter)
    for r in got:
        windows[r["window"]][r["source"]] += r["length"]
    return [w[source] / sum(w.values()) for _, w in sorted(windows.items())]


def test_every_window_has_the_corpus_shares(spark, tokenizer):
    got = check(documents(spark), tokenizer, 1024, window=16_384, unit=64)
    total = sum(r["length"] for r in got)
    for source in {r["source"] for r in got}:
        mean = sum(r["length"] for r in got if r["source"] == source) / total
        # a deficit is less than one unit, at either end of the window
        assert all(abs(s - mean) <= 2 * 64 / 14_000 for s in share(got, source)[:-1])


def test_weights_hold_until_a_queue_runs_dry(spark, tokenizer):
    docs = [(i, "token " * 50, None, "small" if i % 5 == 0 else "large") for i in range(300)]
    got = check(frame(spark, *docs), tokenizer, 128, window=1024, unit=16, weights={"small": 1.0, "large": 1.0})
    small = share(got, "small")
    assert all(abs(s - 0.5) < 0.05 for s in small[:5]) and all(s == 0 for s in small[8:])
