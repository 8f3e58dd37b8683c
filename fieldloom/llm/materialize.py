"""Training-order materialisation: token sequences written in a keyed random order.

Every document is cut into sequences of ``length`` tokens, the last one padded.
All N sequences are numbered in the order of the input; a keyed Feistel
permutation of the numbers gives each its slot. Where the permutation of the
enclosing power of four leaves 0..N-1 it is applied again (cycle-walking), so
the slots are exactly 0..N-1. Slot ranges are dealt to tasks and written as
shards of fixed stride: sequence ``slot`` lies in shard slot // per_shard at
byte (slot % per_shard) * stride, so a reader can resume anywhere by arithmetic.

Token ids are moved once and never written but in the shards: a first pass
counts the sequences of every input task, a second one numbers and sends them.
Both read the input in the same splits, which are pinned for the session; a
task of the second pass that does not see exactly what the first one counted
raises an error. A shard is written under a temporary name and renamed; a
repeated task writes the same bytes.

Results in special cases: a null or empty text has one sequence with the
separator alone; rows that repeat id and text are sequences of their own; a
null id is kept; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.arrays import mix
from fieldloom.llm.common import partitions, prepare, private, stored
from fieldloom.llm.packing import SEPARATOR
from fieldloom.llm.tokens import encoder, tokenizer_path
from fieldloom.session import work_dir

LENGTH = 512
PER_SHARD = 4096
PADDING = 0
ROUNDS = 6

_MANIFEST = "file string, shard long, first_slot long, sequences long, sha256 string"
_INDEX = "slot long, id long, sequence long, tokens long, shard long, sha256 string"
_COUNTS = "part int, sequences long, documents long, check long"


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each number 0..n-1 in a keyed permutation of 0..n-1."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % (1 << 64)) * np.uint64(ROUNDS))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


class _Seen:
    """What a task has read: documents, sequences, and a checksum of the texts in their order."""

    def __init__(self):
        self.part = TaskContext.get().partitionId()
        self.documents = self.sequences = self.check = 0

    def add(self, text_keys: pa.Array, counts: np.ndarray) -> None:
        self.documents += len(counts)
        self.sequences += int(counts.sum())
        self.check = zlib.crc32(text_keys.to_numpy(zero_copy_only=False).tobytes(), self.check)

    def row(self) -> tuple[int, int, int, int]:
        return self.part, self.sequences, self.documents, self.check


def _ids(code, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit ids of all texts with a separator after each, and the offsets between texts."""
    ids, at = code.encode(texts)
    return np.insert(ids.astype("<u2"), at[1:], SEPARATOR), at + np.arange(len(at))


def _counted(path: str, length: int):
    """mapInArrow function over (id, text_key, text): one row per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = encoder(path), _Seen()
        for batch in batches:
            _, at = _ids(code, batch.column(2))
            seen.add(batch.column(1), -(-np.diff(at) // length))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(seen.row(), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            names=[f.split()[0] for f in _COUNTS.split(", ")])

    return run


def _sequences(path: str, length: int, key: int, n: int, counted: dict[int, tuple], first: dict[int, int]):
    """mapInArrow function over (id, text_key, text): one row per sequence with its slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = encoder(path), _Seen()
        for batch in batches:
            ids, at = _ids(code, batch.column(2))
            counts = -(-np.diff(at) // length)
            row = np.repeat(np.arange(len(counts)), counts)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            slots = feistel(first[seen.part] + seen.sequences + np.arange(len(row)), n, key)
            seen.add(batch.column(1), counts)
            begin = at[row] + sequence * length
            end = np.minimum(begin + length, at[row + 1])
            raw = ids.tobytes()
            data = [raw[2 * a:2 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), batch.column(0).take(pa.array(row)), pa.array(sequence), pa.array(end - begin),
                 pa.array(data, pa.binary())], names=["slot", "id", "sequence", "tokens", "ids"])
        if seen.row() != counted[seen.part]:
            raise RuntimeError(f"input task {seen.part} read {seen.row()}, but {counted[seen.part]} was counted")

    return run


def _writer(folder: str, length: int, per_shard: int):
    """mapInArrow function over sequences in slot order: writes shards, returns the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        attempt = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        pad = PADDING.to_bytes(2, "little")
        shard, out, rows = None, None, []

        def close():
            out.close()
            where.move(temporary, posixpath.join(top, f"shard-{shard:08d}.bin"))
            # the shard's digest stands at its last sequence
            rows[-1] = (*rows[-1][:5], sha.hexdigest())

        for batch in batches:
            for slot, i, sequence, tokens, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if slot // per_shard != shard:
                    if out is not None:
                        close()
                    shard, count, sha = slot // per_shard, 0, hashlib.sha256()
                    temporary = posixpath.join(top, f"_writing-{attempt}-{shard}")
                    out = where.open_output_stream(temporary, compression=None)
                if slot != shard * per_shard + count:
                    raise ValueError(f"slot {slot} is missing or repeated")
                row = data + pad * (length - tokens)
                out.write(row)
                sha.update(row)
                count += 1
                rows.append((slot, i, sequence, tokens, shard, None))
            # all but the last row, which may still get the digest
            if len(rows) > 1:
                yield _index_rows(rows[:-1])
                del rows[:-1]
        if out is not None:
            close()
            yield _index_rows(rows)

    return run


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)],
                                      names=[f.split()[0] for f in _INDEX.split(", ")])


def materialise(docs: DataFrame, folder: str, key: int, id_col: str = "doc_id", text_col: str = "text",
                length: int = LENGTH, per_shard: int = PER_SHARD, path: str | None = None) -> DataFrame:
    """Write the shards, the index (which sequence is in which slot) and the manifest under folder; returns the manifest."""
    spark = prepare(docs.sparkSession)
    path = path or tokenizer_path()
    where, top = fs.FileSystem.from_uri(folder)
    where.create_dir(top, recursive=True)
    # splits follow from the files and this setting alone, not from the cores of the moment
    spark.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", str(partitions(spark))))
    texts = private(docs, id=F.col(id_col).cast("long"), text_key=F.xxhash64(F.col(text_col)), text=F.col(text_col))
    counts = stored(texts.mapInArrow(_counted(path, length), _COUNTS), "sequence-counts").collect()
    counted, first, n = {}, {}, 0       # one entry per input task
    for c in sorted(counts, key=lambda c: c["part"]):
        counted[c["part"]], first[c["part"]] = tuple(c), n
        n += c["sequences"]
    placed = texts.mapInArrow(_sequences(path, length, key, n, counted, first),
                              "slot long, id long, sequence long, tokens long, ids binary")
    # the permutation spreads every document evenly, so equal slot ranges are equal work
    shards = max(1, -(-n // per_shard))
    tasks = min(shards, 4 * partitions(spark))
    task = F.floor(F.floor(F.col("slot") / per_shard) * tasks / shards).cast("int")
    index = posixpath.join(folder, "_index")
    (placed.repartitionById(tasks, task).sortWithinPartitions("slot")
     .mapInArrow(_writer(folder, length, per_shard), _INDEX).write.mode("overwrite").parquet(index))
    (spark.read.schema(_INDEX).parquet(index).groupBy("shard").agg(
        F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("sequences"), F.max("sha256").alias("sha256"))
     .select(F.format_string("shard-%08d.bin", "shard").alias("file"), "shard", "first_slot", "sequences", "sha256")
     .write.mode("overwrite").parquet(posixpath.join(folder, "_manifest")))
    return spark.read.schema(_MANIFEST).parquet(posixpath.join(folder, "_manifest"))


def _reader(folder: str, length: int, per_shard: int, from_slot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        stride = 2 * length
        for batch in batches:
            for name, first, count in zip(*[batch.column(c).to_pylist() for c in ("file", "first_slot", "sequences")],
                                          strict=True):
                skip = max(0, from_slot - first)
                with where.open_input_file(posixpath.join(top, name)) as f:
                    for at in range(skip, count, 1024):
                        take = min(1024, count - at)
                        data = f.read_at(take * stride, at * stride)
                        rows = [data[i * stride:(i + 1) * stride] for i in range(take)]
                        slots = np.arange(first + at, first + at + take)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slots), pa.array([first // per_shard] * take, pa.int64()),
                             pa.array(np.arange(at, at + take) * stride), pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                             pa.array(rows, pa.binary())], names=["slot", "shard", "byte_offset", "crc32", "ids"])

    return run


def read_slots(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD,
               from_slot: int = 0) -> DataFrame:
    """Sequences from ``from_slot`` on: slot, shard, byte_offset, crc32 of the padded bytes, ids."""
    prepare(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(posixpath.join(folder, "_manifest"))
    files = manifest.filter(F.col("first_slot") + F.col("sequences") > from_slot).select("file", "first_slot", "sequences")
    return files.repartition(partitions(spark), "file").mapInArrow(
        _reader(folder, length, per_shard, from_slot), "slot long, shard long, byte_offset long, crc32 long, ids binary")


def training_order(docs: DataFrame, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, **columns) -> DataFrame:
    """Write docs to a fresh folder and read all slots back, with the sequence each one holds."""
    spark = docs.sparkSession
    folder = work_dir(spark, "training-order")
    materialise(docs, folder, key, length=length, per_shard=per_shard, **columns)
    index = spark.read.schema(_INDEX).parquet(posixpath.join(folder, "_index")).drop("shard", "sha256")
    # the planner cannot know how many rows the shards hold: neither side may be broadcast
    return index.join(read_slots(spark, folder, length, per_shard).drop("ids").hint("merge"), "slot")
