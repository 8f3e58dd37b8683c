import re

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import DOC_SCHEMA, documents, frame
from pyspark.sql import functions as F

from fieldloom.llm.quality import COUNTS, FEATURES, boost, judge, measure, train

DIRECTIONS = [d for _, d in FEATURES]


def counted(text):
    """COUNTS by plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def judged(df):
    return [(tuple(r[c] for c in COUNTS), r) for r in df.collect()]


def test_counts_of_special_texts():
    texts = [None, "", "\n\n", " a\nb \na\nb ", "a b c a b c", "a a a a", "x\n\nx\ny", "x\n", "x\ny\nx", "é#<ü> 𐐀|",
             "one two", "A a A a A a", "w\r\nw\r\nw\n", "\x0b\x0c", "a b c\nd a b c"]
    counts, features = measure(pa.array(texts))
    assert [tuple(c) for c in counts.tolist()] == [counted(t) for t in texts]
    assert np.isfinite(features).all()
    assert measure(pa.array([], pa.string()))[0].shape == (0, 5)


def test_counts_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab \n#"), rng.integers(0, 60))) for _ in range(300)]
    together = measure(pa.array(texts))
    assert together[0].tolist() == [list(counted(t)) for t in texts]
    for i in (0, 7, 299):
        alone = measure(pa.array([texts[i]]))
        assert np.allclose(alone[1][0], together[1][i])


def test_documents_against_plain_counts(spark):
    docs = documents(spark)
    model = train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    out = judged(judge(docs.select("doc_id", "text", "lang"), model))
    assert len(out) == docs.count() and list(out[0][1].asDict())[:3] == ["doc_id", "text", "lang"]
    for counts, r in out:
        if len(r["text"]) < 6000:
            assert counts == counted(r["text"])
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(docs, labels.filter("doc_id % 4 > 0"))
    held = judge(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id"), model).filter("n_words >= 50").collect()
    right = [(r["score"] >= 0.5) == bool(r["quality"]) for r in held]
    assert len(held) > 60 and np.mean(right) > 0.95
    good = [r["score"] >= 0.5 for r in held if r["quality"]]
    assert np.mean(good) > 0.97


def test_scores_follow_the_stated_directions():
    """Labels that say the opposite cannot bend a constrained feature; flat scoring equals walking the trees."""
    rng = np.random.default_rng(6)
    x = rng.random((2000, len(FEATURES)))
    y = (x[:, 2] + 0.6 * x[:, 0] * x[:, 5] + 0.2 * rng.random(2000) > 0.8).astype(float)
    model = boost(x, y, DIRECTIONS, trees=25)
    for f, direction in enumerate(DIRECTIONS):
        if direction:
            probe = np.repeat(x[:50], 30, axis=0)
            probe[:, f] = np.tile(np.linspace(0, 1, 30), 50)
            assert (np.diff(model.score(probe).reshape(50, 30), axis=1) * direction >= -1e-12).all()

    def walk(row):
        total = model.start
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] + int(row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:200]), [walk(r) for r in x[:200]])
    free = boost(x, y, [0] * len(FEATURES), trees=25)
    assert np.mean((free.score(x) >= 0.5) == y) > 0.9


def test_special_cases(spark):
    good, bad = "some plain{0} words of{0} text number{0} ", "# $$${0} %%%{0} word{0} &&&{0} ***{0} <<<{0} | "
    fine = [(i, " ".join(good.format(i * 100 + j) for j in range(12)), "en", "s") for i in range(40)]
    junk = [(100 + i, " ".join(bad.format(i * 100 + j) for j in range(12)), "en", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
                                   + [(1, 1, 1), (2, None, 0), (None, 0, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(frame(spark, *fine, *junk), labels)
    cases = [(1, None), (2, ""), (3, "short"), (4, fine[0][1]), (4, fine[0][1]), (None, junk[0][1]),
             (5, "same again " * 60_000), (6, " ".join(f"w{i}" for i in range(200_000)))]
    out = judge(frame(spark, *cases), model)
    assert out.columns == [c for c in DOC_SCHEMA.names if c != "kept"] + [*COUNTS, "score", "base_failed", "kept"]
    rows = out.collect()
    assert [(r["doc_id"], r["base_failed"], r["kept"]) for r in rows][:7] == [
        (1, True, False), (2, True, False), (3, True, False), (4, False, True), (4, False, True),
        (None, False, False), (5, True, False)]
    assert rows[7]["n_words"] == 200_000 and rows[0]["a.b"] == "dot"
    assert judge(frame(spark), model).count() == 0
    # nothing to learn from: only the rules decide
    blank = train(frame(spark, *fine), labels.filter("quality = 1"))
    assert [r["kept"] for r in judge(frame(spark, *cases), blank).collect()][3:6] == [True, True, True]


@pytest.mark.parametrize("parts", [1, 7])
def test_the_fit_is_bounded_and_does_not_depend_on_the_partitions(spark, parts):
    docs = spark.range(900).select(
        (F.col("id") % 300).alias("doc_id"), F.repeat(F.concat(F.lit("# "), F.col("id") % 7, F.lit(" ")), 60).alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    one = train(docs.repartition(parts), labels, training=100)
    two = train(docs, labels, training=100)
    assert np.array_equal(one.threshold, two.threshold) and np.array_equal(one.value, two.value)
