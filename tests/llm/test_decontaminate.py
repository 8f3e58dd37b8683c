import random
import re
from itertools import combinations

import pytest
from llm_helpers import DOC_SCHEMA, documents, frame

from fieldloom.llm import decontaminate as d

ITEMS = [(1, " ".join(f"q{i}" for i in range(40))), (2, "Short one, only six words here"), (3, None), (4, ""),
         (5, " ".join(f"r{i}" for i in range(9))), (6, " ".join(f"q{i}" for i in range(40))), (None, " ".join(f"n{i}" for i in range(20)))]


def tokens(text):
    spaced = re.sub(r"([\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", (text or "").lower())
    return [t for t in re.split(r"[^\w]+|_+", spaced) if t]


def verdict(text, item):
    """Whether any alignment has a stretch with enough equal tokens."""
    a, b = tokens(text), tokens(item)
    if not b:
        return False
    need = min(d.OVERLAP, len(b))
    held = set(a)
    if sum(word in held for word in b) * 100 < need * d.PERCENT:
        return False
    for shift in range(-len(b) + 1, len(a)):
        equal = {j: a[shift + j] == b[j] for j in range(len(b)) if 0 <= shift + j < len(a)}
        if sum(equal.values()) * 100 >= need * d.PERCENT and any(sum(equal.get(s + i, -99) for i in range(need)) * 100 >= need * d.PERCENT for s in equal):
            return True
    return False


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def hidden(rng, item, every):
    words = item.split()
    for i in range(every - 1, len(words), every):
        words[i] = f"sub{rng.randrange(99)}"
    return words


@pytest.mark.parametrize("limit", [d.BROADCAST_SEEDS, 0])
def test_special_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_SEEDS", limit)
    rng = random.Random(2)
    filler = [f"f{i}" for i in range(50)]
    texts = [None, "", "!!", ITEMS[0][1], ITEMS[0][1].upper().replace(" ", ", "), " ".join(filler),
             " ".join([*filler, *hidden(rng, ITEMS[0][1], 7), *filler]), " ".join([*filler, *hidden(rng, ITEMS[0][1], 3), *filler]),
             ITEMS[1][1], ITEMS[4][1], " ".join(["x", *ITEMS[0][1].split()[20:34]]), " ".join(ITEMS[0][1].split()[:8]),
             ITEMS[6][1], "word " * 60_000 + ITEMS[0][1]]
    cases = [*enumerate(texts), (3, texts[3]), (None, texts[3]), (None, None)]
    df = frame(spark, *cases)
    got = sorted(((r["id"], r["contaminated"]) for r in d.contamination(df, benchmark(spark)).collect()), key=str)
    assert got == sorted(((i, any(verdict(t, item) for _, item in ITEMS)) for i, t in cases), key=str)
    clean = d.decontaminate(df, benchmark(spark))
    assert clean.columns == DOC_SCHEMA.names
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, c in got if not c)


def test_items_are_named_once(spark):
    row = d.contamination(frame(spark, (1, ITEMS[0][1] + " . " + ITEMS[4][1])), benchmark(spark)).first()
    assert row["items"] == [1, 5] and row["share"] == 1.0


def test_masks_meet_every_allowed_substitution():
    def meets(masks, at, size, changed):
        return any(not any(bit == "1" and p + i in changed for i, bit in enumerate(m))
                   for m in masks for p in at if p + len(m) <= size)

    for size in range(1, d.OVERLAP + 1):
        may = size - -(-size * d.PERCENT // 100)
        short = [masks for first, end, masks in d._short_classes() if first <= size < end]
        masks, at = (short[0], [0]) if short else (d.MASKS, range(size))
        assert all(len(m) <= size for m in masks)
        for n in range(may + 1):
            assert all(meets(masks, at, size, set(c)) for c in combinations(range(size), n))


def test_short_items(spark):
    """Items of 1 to 14 tokens between other words, with every number of substitutions up to one too many."""
    rng = random.Random(5)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(1, 15)]
    items += [(20, "\u4eca\u65e5\u306f\u3068\u3066\u3082\u826f\u3044\u5929\u6c17\u3067\u3059"), (21, "\u0e20\u0e32\u0e29\u0e32")]
    cases = [(0, "none of them")]
    for _, item in items:
        words = tokens(item)
        for changed in range(min(4, len(words) + 1)):
            for _ in range(6):
                inside = list(words)
                for at in rng.sample(range(len(words)), changed):
                    inside[at] = "other"
                cases.append((len(cases), " ".join(["before", *inside, "after"])))
    cases.append((len(cases), "\u6587" + items[-2][1] + "\u6587" * 40))
    cases.append((len(cases), "\u6587" + items[-2][1][:9]))
    found = d.contamination(frame(spark, *cases), benchmark(spark, items)).collect()
    assert {r["id"]: r["items"] for r in found} == {
        i: [n for n, item in items if verdict(text, item)] for i, text in cases}
    assert 40 < sum(r["contaminated"] for r in found) < len(cases) - 40


def test_repeated_tokens(spark):
    """A long repetitive text beside a repetitive item."""
    cases = [(1, "la " * 30_000), (2, "la lo " * 9_000), (3, "lo " * 12)]
    found = d.contamination(frame(spark, *cases), benchmark(spark, [(1, "la " * 20), (2, "lo " * 12)]))
    assert {r["id"]: (r["items"], r["share"]) for r in found.collect()} == {1: ([1], 1.0), 2: ([], 0.0), 3: ([2], 1.0)}


def test_empty_tables(spark):
    assert d.contamination(frame(spark), benchmark(spark)).count() == 0
    assert not d.contamination(frame(spark, (1, ITEMS[0][1])), benchmark(spark, [])).first()["contaminated"]


def test_documents(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = documents(spark)
    got = {r["id"] for r in d.contamination(docs, items).filter("contaminated").collect()}
    texts = [" ".join(tokens(r["text"])) for r in items.collect()]
    planted = {r["doc_id"] for r in docs.collect() if any(f" {t} " in f" {' '.join(tokens(r['text']))} " for t in texts)}
    assert planted and planted <= got and len(got - planted) <= 2
