"""Small inputs with every special case, and plain-Python versions of the operators' rules."""

import re

from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # names that the operators use inside or return
    T.StructField("uid", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("slot", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("_id", T.StringType()),
])


def rows(*docs):
    """(doc_id, text, lang, source) padded with columns of clashing names."""
    return [(*d, *([None] * (4 - len(d))), "u", "r", "s", "k", "dot", "i") for d in docs]


def frame(spark, *docs):
    return spark.createDataFrame(rows(*docs), DOC_SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def groups(n, linked):
    """Smallest member of each of 0..n-1's groups under linked(i, j)."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def documents(spark, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet")
