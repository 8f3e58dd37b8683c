"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i every shingle is placed by one hash into
one bin with the value i + v, v in [0, 1) from the same hash; a bin keeps its
smallest value. Rounds go on until every bin is filled; from round T on, round
T + j places every shingle into bin j, so 2T rounds always suffice and about
T ln(T) / n are needed for n shingles. Two sketches agree in a coordinate with
the probability of their sets' similarity, with concentration bounds as if the
coordinates were independent.

Bands of ROWS coordinates make candidates: sets of similarity s share a band
with probability 1 - (1 - s^ROWS)^BANDS; for s = 0.8 all but 5 in 10^8.

Documents with equal sets form a class, of which one member goes on. No bucket
is expanded into pairs:

1. In every bucket each class is compared with the bucket's smallest class.
   Compared means: full sets, exactly.
2. Components of the links so far. Buckets whose classes are all in one
   component are settled: further links could change nothing.
3. Of every other bucket the classes outside its largest component are compared
   with all classes of other components, piece by piece inside a task. A pair
   belongs to the first band both share, and must agree in as many coordinates
   as a similar pair does but for one in 10^6. First each class's most alike
   partners are verified and components renewed. Then the classes that still
   have such partners are given their full sets, and all pairs that are left
   are verified inside the tasks; only links come out.

Results in special cases: a null text or one without words has an empty set and
is linked with nothing; a text with fewer words than a shingle has its whole
sequence as one shingle; rows are told apart by the number they get when the
sketches are written, so repeated rows are linked like any copies; a null id is
never a component's name unless all its ids are null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.arrays import LOWER, flat, mix, piece_hashes, shingles, words
from fieldloom.llm.common import numbered, prepare, private, retain, stored
from fieldloom.llm.graph import merged, open_pieces, pairs_in_pieces, roots, rows_in_pairs

COORDINATES = 128
BANDS, ROWS = 32, 4
# similarity 0.8 gives 102 equal coordinates of 128 on average, sigma 4.5; 79 is 5.1 sigma below
AGREEING = 79
BEST = 4                # partners of a class in a piece of a bucket that are verified first

_SKETCH = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("sketch", T.BinaryType())])


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of a non-empty set of 64-bit hashes: the round in the top byte, v below."""
    out = np.full(t, ~np.uint64(0))
    at, step = 0, max(1, int(1.3 * t * np.log(t) / len(elements)) + 1)
    while at < t and (out == ~np.uint64(0)).any():
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
        h = mix(elements[None, :] ^ mix(rounds + np.uint64(0x5EED))[:, None])
        value = (rounds[:, None] << np.uint64(56)) | (h >> np.uint64(8))
        # the bin comes from the low bits, the value from the high ones
        np.minimum.at(out, (h & np.uint64(t - 1)).ravel().astype(np.int64), value.ravel())
        at += step
    for j in np.flatnonzero(out == ~np.uint64(0)).tolist():
        h = mix(elements ^ mix(np.uint64([t + j + 0x5EED])))
        out[j] = (np.uint64(t + j) << np.uint64(56)) | (h >> np.uint64(8)).min()
    return out


def text_shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Distinct shingles of each text: words of other than white space, A-Z lower-cased."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, counts = words(data, offsets)
    return shingles(piece_hashes(data, starts, ends), counts, width)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(BANDS, dtype=np.uint64))
        for batch in batches:
            n, keys, bands, codes = [], [], [], []
            for s in text_shingles(batch.column(2), width):
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), codes.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                c = sketch(s)
                h = seeds.copy()
                for column in c.reshape(BANDS, ROWS).T:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
                bands.append(h.view(np.int64))
                codes.append((mix(c) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(codes, pa.binary())], names=_SKETCH.names)

    return run


def _sets(width: int):
    """(uid, text) to (uid, set): the full shingle sets of the documents to be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in text_shingles(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["uid", "set"])

    return run


class _Verifier:
    """Full sets of classes, and the exact similarity of pairs of them."""

    def __init__(self, texts: DataFrame, classes: DataFrame, width: int, percent: int):
        self.texts, self.classes, self.width, self.percent = texts, classes, width, percent
        self.sets = None

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """The sets(uid, set) known so far, with those of wanted(uid); each is made once."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("uid"), "uid", "left_anti")
        keyed = wanted.join(self.classes.select("uid", "id", "text_key"), "uid")
        # texts are looked up by id and hash of the text
        found = (self.texts.join(keyed, self.texts["_id"].eqNullSafe(keyed["id"])
                                 & (self.texts["_text_key"] == keyed["text_key"]))
                 .select("uid", "_text").dropDuplicates(["uid"]))
        made = stored(found.mapInArrow(_sets(self.width), "uid long, set array<long>"), "sets", compression="zstd")
        self.sets = made if self.sets is None else self.sets.unionByName(made)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs(a, b) whose sets have intersection / union of at least percent / 100."""
        sets = self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
        right = pairs.join(sets.select(F.col("uid").alias("b"), F.col("set").alias("sb")), "b")
        both = right.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.filter((100 + self.percent) * common >= self.percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs(a, na, b, nb) whose sizes allow the similarity."""
    return (pairs.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of docs: id, text_key, uid, n_shingles, component_id, kept.

    Rows are linked when 100 * intersection >= percent * union of their sets of
    shingles of ``width`` words. component_id is the smallest id reachable, and
    kept marks one row of each component.
    """
    spark = prepare(docs.sparkSession)
    texts = private(docs, id=F.col(id_col).cast("long"), text_key=F.xxhash64(F.col(text_col)), text=F.col(text_col))
    rows = stored(numbered(texts.mapInArrow(_sketches(width), _SKETCH), "uid"), "sketches")

    # classes of equal sets: the smallest row number stands for the class
    sets = rows.filter("n > 0")
    classes = stored(sets.groupBy("set_key").agg(
        F.min(F.struct("uid", "id", "text_key", "n", "bands", "sketch")).alias("c"))
        .select("set_key", "c.*"), "classes")
    members = classes.select("uid", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("bucket").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # only rows of shared buckets go on; AQE splits the join where a bucket is very large
    shared = stored(members.join(buckets, "bucket").join(
        classes.select(F.col("uid").alias("first"), F.col("n").alias("n_first")), "first"), "buckets")

    star = shared.filter("uid <> first").select(
        F.col("first").alias("a"), F.col("n_first").alias("na"), F.col("uid").alias("b"), F.col("n").alias("nb"))
    verifier = _Verifier(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_key"),
                    F.col(text_col).alias("_text")), classes, width, percent)
    tested = stored(_possible(star, percent), "pairs")
    links = stored(verifier.links(tested), "links")

    known = roots(shared.select("uid").distinct(), links)
    open_rows, facts = shared.select("bucket", "band", "uid"), classes.select("uid", "n", "bands", "sketch")
    best = stored(pairs_in_pieces(open_pieces(open_rows, facts, known), _alike(percent, BEST))
                  .join(tested, ["a", "b"], "left_anti"), "pairs")
    known = merged(known, stored(verifier.links(best), "links"))
    left = stored(rows_in_pairs(open_pieces(open_rows, facts, known), _alike(percent, None)), "open-classes")
    full = left.join(verifier.fetch(left.select("uid").distinct()), "uid")
    known = merged(known, stored(pairs_in_pieces(full, _linked(percent)), "links"))

    by_class = (classes.select("set_key", "uid").join(known, "uid", "left")
                .select("set_key", F.coalesce("root", "uid").alias("component")))
    named = rows.join(by_class, "set_key", "left").select(
        "id", "text_key", "uid", F.col("n").alias("n_shingles"),
        F.coalesce("component", "uid").alias("component"))
    named = stored(named, "components")
    best = (named.groupBy("component").agg(
        F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("k"),
        F.count(F.lit(1)).alias("size")).filter("size > 1")
        .select("component", "component_id", F.col("k.uid").alias("keep_uid")))
    return named.join(best, "component", "left").select(
        "id", "text_key", "uid", "n_shingles",
        F.when(F.col("keep_uid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("keep_uid").isNull() | (F.col("uid") == F.col("keep_uid"))).alias("kept"))


def _alike(percent: int, best: int | None):
    """Pairs of a piece that may be similar: by size, by equal coordinates, and in the first band they share."""
    def near(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        root, band, n = rows["root"], rows["band"], np.array(rows["n"], np.int64)
        bands = np.array(rows["bands"], np.int64)
        codes = np.frombuffer(b"".join(rows["sketch"]), "<u2").reshape(len(n), -1)
        left, right = np.flatnonzero(rows["left"]), np.flatnonzero(~rows["left"])
        a, b = [left[:0]], [left[:0]]
        for i in left.tolist():
            r = right[root[right] != root[i]]
            r = r[100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i])]
            r = r[(bands[r] == bands[i]).argmax(axis=1) == band[i]] if len(r) else r
            equal = (codes[r] == codes[i]).sum(axis=1)
            r, equal = r[equal >= AGREEING], equal[equal >= AGREEING]
            if best is not None and len(r) > best:
                r = r[np.argpartition(-equal, best)[:best]]
            a.append(np.full(len(r), i)), b.append(r)
        return np.concatenate(a), np.concatenate(b)

    return near


def _linked(percent: int):
    """Links of a piece: one to each component for each left row, found by full sets, the most alike first."""
    alike = _alike(percent, None)

    def near(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.sort(np.asarray(s, np.int64)) for s in rows["set"]]
        codes = np.frombuffer(b"".join(rows["sketch"]), "<u2").reshape(len(sets), -1)
        a, b = alike(rows)
        order = np.lexsort((-(codes[a] == codes[b]).sum(axis=1), a))
        done, out = set(), []
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if (i, rows["root"][j]) not in done:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if (100 + percent) * common >= percent * (len(sets[i]) + len(sets[j])):
                    done.add((i, rows["root"][j]))
                    out.append((i, j))
        return np.array([i for i, _ in out], int), np.array([j for _, j in out], int)

    return near


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
               percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    verdicts = near_duplicates(docs, id_col, text_col, width, percent)
    keepers = verdicts.filter("kept").select(F.col("id").alias("_id"), F.col("text_key").alias("_text_key"))
    return retain(docs, id_col, text_col, keepers)
