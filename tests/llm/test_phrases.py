import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import documents, frame, lower

from fieldloom.llm.phrases import collocations, frequent_phrases


def counted(docs, longest=5):
    """Occurrences of all phrases of each group by plain Python, and the words of each group."""
    found, total = {}, Counter()
    for _, text, lang, *_ in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    found.setdefault(lang, Counter())[tuple(words[i:i + m])] += 1
    return found, total


def ranked(docs, support, top=2000):
    found, total = counted(docs)
    out = []
    for lang, f in found.items():
        rows = []
        often = {w: a for w, a in f.items() if a >= support}
        for w, a in often.items():
            if len(w) == 1:
                continue
            longer = [x for x in often if len(x) > len(w) and any(x[i:i + len(w)] == w for i in range(len(x)))]
            if any(often[x] >= a for x in longer):
                continue
            score, k = min((1000 * a * total[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def check(spark, docs, support, **options):
    got = collocations(frame(spark, *docs), support=support, **options)
    assert got.columns == ["group", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == ranked(docs, support, options.get("top", 2000))


@pytest.mark.parametrize("shard", [1 << 20, 4000, 300])
def test_documents(spark, shard):
    """Few shards and many: the lowered support goes from the support itself down to 1."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark).orderBy("doc_id").limit(40).collect()]
    check(spark, docs, 12, shard=shard)


def test_random_words_over_shards(spark):
    rng = np.random.default_rng(9)
    docs = [(i, "".join(rng.choice(list("abc") + ["A", "é"] + list("    .\n\t"), rng.integers(0, 90))), "xy"[i % 2]) for i in range(150)]
    check(spark, docs, 9, shard=500)
    check(spark, docs, 4, shard=64, top=7)


def test_special_cases(spark):
    docs = [(1, None, "en"), (2, "", "en"), (3, "one two three.one two\nThree one TWO", None), (3, "one two", None), (4, "one two", "und"),
            (5, "one\ttwo  one two,one,two", "und"), (None, "ha ha ha ha ha ha", "x"), (6, ".,;:!?\r\n\x0b\x0c", "y"),
            (7, "l'été l'été l'ÉTÉ naïve", "fr"), (7, "l'été l'été l'ÉTÉ naïve", "fr"),
            (8, "very long. " * 5000 + "much too long " * 4000, "z")]
    for shard in (1 << 20, 100):
        check(spark, docs, 2, shard=shard)
    assert collocations(frame(spark)).count() == 0


def test_a_third_of_all_rows_in_one_text(spark):
    docs = [(i, "same old story told again" if i % 3 == 0 else f"text {i} of its own {i % 5}", "en") for i in range(300)]
    check(spark, docs, 50, shard=900)


def test_counts_are_exact_beyond_64_bits(spark, monkeypatch):
    import fieldloom.llm.phrases as module

    big = 3_000_000_000_000
    counts = spark.createDataFrame([("g", "a", 2 * big), ("g", "b", 3 * big), ("g", "a b", big)], "group string, phrase string, f long")
    totals = spark.createDataFrame([("g", 4_000_000_000_000_000)], "group string, n long")
    monkeypatch.setattr(module, "frequent_phrases", lambda *a: (counts, totals))
    row = collocations(counts).collect()[0]
    assert row["score"] == 1000 * big * 4_000_000_000_000_000 // (2 * big * 3 * big)


def test_all_locally_frequent_phrases_are_found(spark):
    """Every phrase with the support comes out of the counts, whatever its spread over shards."""
    docs = [(i, "p q r " * (1 + i % 4) + f"u{i} v{i}", "g") for i in range(60)]
    counts, totals = frequent_phrases(frame(spark, *docs), support=20, shard=128)
    found, total = counted(docs)
    assert {tuple(r["phrase"].split(" ")): r["f"] for r in counts.collect()} == {w: a for w, a in found["g"].items() if a >= 20}
    assert {r["group"]: r["n"] for r in totals.collect()} == dict(total)


@pytest.mark.parametrize("start", [0.01, 10])
def test_only_what_decides_the_top_is_counted(spark, monkeypatch, start):
    """The ranking is whole however few words are counted first, and phrases that cannot reach it are not handed on."""
    import fieldloom.llm.phrases as module

    monkeypatch.setattr(module, "START", start)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    often = 1 / np.arange(1, 61)
    docs = [(i, " ".join(rng.choice(words, 60, p=often / often.sum())), "xyz"[i % 3]) for i in range(240)]
    docs += [(1000 + i, f"rare{i % 12} pair{i % 12}. the rare{i % 12} pair{i % 12} end", "xyz"[i % 3]) for i in range(96)]
    docs += [(2000 + i, "few words here", "few") for i in range(9)]
    check(spark, docs, 8, shard=3000, top=4)
    every, few = (frequent_phrases(frame(spark, *docs), support=8, shard=3000, top=n)[0] for n in (None, 4))
    assert not few.exceptAll(every).count()
    if start == 10:
        assert 2 * few.count() < every.count()
