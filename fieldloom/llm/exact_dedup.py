"""Exact deduplication by a tree merge of sorted digest runs.

Every partition sorts its digests into a run. In each round a partition
exchanges with the k - 1 partners that differ from it in one base-k digit of
their number: an entry moves to the partner whose digit equals that digit of
the entry's digest. The receiver merges k sorted runs and keeps one entry per
text. After log_k(P) rounds partition p holds the merged run of the p-th range
of digests. Of a text that a third of all rows share, a partition receives at
most k entries in a round, whatever the number of copies.

An entry is a SHA-256 digest with an independent 64-bit hash and the byte
length of the normalised text; entries merge only when all three agree.

Results in special cases: a null text counts as empty; a null id is smaller
than any other (and larger when the smallest id is kept); rows that repeat id
and text are copies of each other, and one of them stays; an empty table gives
an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import partitions, prepare, private, retain, stored

MERGE_WIDTH = 8     # runs merged at once, at most
_HOME_BITS = 31

_RUN = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("text_key", T.LongType()),
    T.StructField("digest", T.BinaryType()), T.StructField("check", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("home", T.LongType()),
    T.StructField("part", T.IntegerType()), T.StructField("uid", T.LongType()),
])
_ENTRY = T.StructType([*[f for f in _RUN.fields if f.name not in ("text_key", "part")],
                       T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())])
_SAME = ["digest", "check", "size"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the texts with A-Z lower-cased (bytes.lower changes nothing else)."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n, digest, check, size = batch.num_rows, [], [], []
        for text in batch.column(1).cast(pa.binary()):
            data = (text.as_py() or b"").lower()
            digest.append(hashlib.sha256(data).digest())
            check.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
            size.append(len(data))
        home = [int.from_bytes(d[:4], "big") >> (32 - _HOME_BITS) for d in digest]
        uid = np.arange(seen, seen + n, dtype=np.int64) + (part << 33)
        seen += n
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(check, pa.int64()),
            pa.array(size, pa.int64()), pa.array(home, pa.int64()),
            pa.array(np.full(n, part, np.int32)), pa.array(uid)], names=_RUN.names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse neighbours with one text in sorted entries to the last of them, adding up n."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # names only: whether a field may be null differs between batches
        batch = pa.RecordBatch.from_arrays(batch.columns, names=_ENTRY.names)
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        digest = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        differs = (digest[1:] != digest[:-1]).any(axis=1)
        for name in ("check", "size"):
            column = table.column(name).to_numpy()
            differs |= column[1:] != column[:-1]
        first = np.flatnonzero(np.concatenate(([True], differs)))
        last = np.append(first[1:], table.num_rows) - 1
        n = np.add.reduceat(table.column("n").to_numpy(), first)
        merged = table.take(pa.array(last)).set_column(_ENTRY.names.index("n"), "n", pa.array(n))
        merged = merged.combine_chunks().to_batches()[0]
        yield merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield held


def tree_shape(tasks: int, width: int = MERGE_WIDTH) -> tuple[int, int]:
    """Rounds and merge width of a tree with at least ``tasks`` leaves."""
    rounds = 1
    while width ** rounds < tasks:
        rounds += 1
    k = 2
    while k ** rounds < tasks:
        k += 1
    return rounds, k


def digest_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: str = "smallest") -> DataFrame:
    """One row per row of docs: id, text_key, uid, digest, keep_id, group_size, kept.

    ``keep`` is ``smallest`` or ``largest``: which id of each text stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = prepare(docs.sparkSession)
    # a merge keeps the last entry of a text, so the id to keep is sorted last
    by_id = (F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first())
    order = [*_SAME, by_id, F.col("uid")]
    texts = private(docs, id=F.col(id_col).cast("long"), text=F.col(text_col), text_key=F.xxhash64(text_col))
    runs = stored(texts.mapInArrow(_digests, _RUN).sortWithinPartitions(*order), "digest-runs")

    rounds, k = tree_shape(partitions(spark))
    leaves = k ** rounds
    # a task may read several stored runs, in any order, so they are merged into one first
    entries = (runs.withColumns({"slot": F.pmod("part", F.lit(leaves)).cast("long"), "n": F.lit(1).cast("long")})
               .select(*_ENTRY.names).sortWithinPartitions(*order).mapInArrow(_merge, _ENTRY))
    home = F.floor(F.col("home") * leaves / (1 << _HOME_BITS))
    for r in range(rounds):
        step = k ** r
        digit = lambda c: F.floor(c / step) % k
        entries = (
            entries.withColumn("slot", (F.col("slot") + (digit(home) - digit(F.col("slot"))) * step).cast("long"))
            .repartitionById(leaves, F.col("slot").cast("int")).sortWithinPartitions(*order)
            .mapInArrow(_merge, _ENTRY))
    groups = stored(entries.filter("n > 1").select(
        *_SAME, F.col("id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size")),
        "digest-groups")

    # back down: each run learns the group's choice once, and its rows from the run
    told = runs.select("part", *_SAME).distinct().join(groups, _SAME)
    single = F.col("keep_uid").isNull()
    return runs.join(told, ["part", *_SAME], "left").select(
        "id", "text_key", "uid", "digest",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("uid") == F.col("keep_uid"))).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    verdicts = digest_verdicts(docs, id_col, text_col, keep)
    keepers = verdicts.filter("kept").select(F.col("id").alias("_id"), F.col("text_key").alias("_text_key"))
    return retain(docs, id_col, text_col, keepers)
