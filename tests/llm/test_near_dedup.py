import numpy as np
import pytest
from llm_helpers import DOC_SCHEMA, documents, frame, groups, shingle_set

from fieldloom.llm.near_dedup import near_dedup, near_duplicates, sketch


def expected(docs, width, percent=80):
    sets = [shingle_set(t, width) for _, t in docs]

    def linked(i, j):
        common = len(sets[i] & sets[j])
        return bool(common) and 100 * common >= percent * len(sets[i] | sets[j])

    root = groups(len(docs), linked)
    smallest = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            smallest[root[k]] = min(i, smallest.get(root[k], i))
    return sorted(((i, len(sets[k]), smallest.get(root[k])) for k, (i, _) in enumerate(docs)), key=str)


def family(seed, n, words=60, edits=3):
    """Texts that differ in a few words each, so that most links are between changed copies."""
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            copy[at] = f"e{rng.integers(0, 4)}"
        out.append(" ".join(copy))
    return out


def check(df, docs, width):
    got = near_duplicates(df, width=width).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == expected(docs, width)
    return got


def test_special_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "a b c d e f g h"),
            (8, "a b c d e f g h"), (8, "a b c d e f g h"), (None, "a b c d e f g H"), (None, "x y z"),
            (9, " ".join(f"v{i}" for i in range(30_000))), (10, " ".join(f"v{i}" for i in range(30_001))),
            (11, "É b c d e f"), (12, "é b c d e f")]
    got = check(frame(spark, *docs), docs, 4)
    by_component = {}
    for r in got:
        by_component.setdefault((r["component_id"], r["n_shingles"], r["id"] is None and r["component_id"] is None), []).append(r)
    out = near_dedup(frame(spark, *docs), width=4)
    assert out.columns == DOC_SCHEMA.names
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(
        ["1", "2", "3", "4", "6", "7", "9", "11", "12", "None"])


def test_empty_table(spark):
    assert near_duplicates(frame(spark)).count() == 0


@pytest.mark.parametrize("edits", [3, 6])
def test_large_groups_of_changed_copies(spark, edits):
    texts = [t for seed in range(3) for t in family(seed, 150, edits=edits)]
    docs = list(enumerate(texts))
    check(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), docs, 4)


def test_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    check(documents(spark), docs, 5)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 40, 3000):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        one = rng.integers(0, 1 << 63, max(1, n // 4), dtype=np.uint64)
        a, b = sketch(both), sketch(np.concatenate((both, one)))
        assert (a != ~np.uint64(0)).all()
        assert abs((a == b).mean() - n / (n + len(one))) < 0.2
