import zlib

import numpy as np
from llm_helpers import DOC_SCHEMA, documents, frame
from pyspark.sql import functions as F

from fieldloom.llm.langid import DIMENSIONS, KernelModel, identify, in_fold, presence, train


def test_held_out_accuracy(spark):
    docs = documents(spark)
    model = train(docs.filter(~in_fold("doc_id")), "doc_id", "text", "lang")
    said = identify(docs, model).select("doc_id", "lang", "lang_pred", "score", in_fold("doc_id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in said)
    held = [r for r in said if r["h"]]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in said)


def test_special_cases(spark):
    learn = frame(spark, *[(i, f"der die das und nicht {i}", "de", "s") for i in range(20)],
                  *[(100 + i, f"the and with not {i}", "en", "s") for i in range(20)],
                  (300, "nothing learned", None, "s"), (301, None, "xx", "s"), (302, "123 !", "yy", "s"))
    model = train(learn, "doc_id", "text", "lang")
    assert model.languages == ["de", "en"]
    cases = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the and"), (5, "der und die"), (5, "der und die"), (None, "THE AND WITH"),
             (6, "the and with not " * 30_000), (7, "日本"), (8, "𐐀𐐁")]
    out = identify(frame(spark, *cases), model)
    assert out.columns == [*DOC_SCHEMA.names, "lang_pred", "score"]
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert [g for g in got if g[0] not in (7, 8)] == [
        (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"), (None, "en"), (6, "en")]
    assert {lang for i, lang in got if i in (7, 8)} <= {"de", "en"}
    assert identify(frame(spark), model).count() == 0
    nothing = train(frame(spark), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in identify(frame(spark, *cases), nothing).collect()} == {"und"}


def test_a_large_class_is_sampled_by_hash_alone(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abc "), "id").alias("text"), F.lit("q").alias("lang"))
    model = train(many, "doc_id", "text", "lang", landmarks=4, training=8)
    again = train(many.repartition(9), "doc_id", "text", "lang", landmarks=4, training=8)
    assert np.array_equal(model.landmarks, again.landmarks)


def test_scores_equal_kernels_with_the_landmarks():
    rng = np.random.default_rng(3)
    texts = ["ab cd", "the cat sat", "wort um wort", "x"]
    marks = np.zeros((DIMENSIONS, 2), np.float32)
    for j, t in enumerate(texts[1:3]):
        marks[presence(t, np.zeros(DIMENSIONS, bool)), j] = 1
    marks /= np.sqrt(marks.sum(axis=0))
    coefficients = rng.normal(size=(2, 2)).astype(np.float32)
    out = KernelModel(["a", "b"], marks, coefficients).scores(texts)
    for t, row in zip(texts, out, strict=True):
        mine = set(presence(t, np.zeros(DIMENSIONS, bool)).tolist())
        kernels = []
        for m in texts[1:3]:
            other = set(presence(m, np.zeros(DIMENSIONS, bool)).tolist())
            kernels.append(len(mine & other) / np.sqrt(len(mine) * len(other)))
        assert np.allclose(row, np.array(kernels) @ coefficients, atol=1e-5)


def test_repeated_ids_and_rows_are_learned_at_any_size(spark):
    """Rows that share an id, or are equal, are ranked like others: neither language is lost."""
    shared = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("abc abd "), "id").alias("text"), F.lit("p").alias("lang"))
    nulls = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("xyz xyw "), "id").alias("text"), F.lit("q").alias("lang"))
    equal = spark.range(3000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("mno mnp").alias("text"), F.lit("r").alias("lang"))
    model = train(shared.unionByName(nulls).unionByName(equal), "doc_id", "text", "lang", landmarks=4, training=8)
    assert model.languages == ["p", "q", "r"] and model.landmarks.shape[1] == 12
    out = identify(frame(spark, (1, "abc abd"), (2, "xyz xyw"), (3, "mno mnp")), model)
    assert [r["lang_pred"] for r in out.orderBy("doc_id").collect()] == ["p", "q", "r"]


def test_the_most_frequent_labels_are_learned(spark):
    rows = [(i, f"word{lang} {i}", lang, "s") for n, lang in ((5, "a"), (3, "b"), (9, "c"), (3, "d")) for i in range(n)]
    assert train(frame(spark, *rows), "doc_id", "text", "lang", most=3).languages == ["a", "b", "c"]
