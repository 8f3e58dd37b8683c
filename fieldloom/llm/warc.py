"""Deterministic sharded WARC archives.

Records are put in order of their id by histogram sort (exact splitters, so
the shards do not depend on sampling), written shard by shard as gzip members
of one record each, and rolled to the next file when the compressed size
reaches a limit. Headers, lengths and SHA-256 digests are made anew from the
payload; ids and dates are derived from the record, so that the same table
gives the same bytes. A task writes under a temporary name and renames the
finished file; the files of a run count only once its manifest, a table with
one row per file, is complete. A repeated task writes the same file again.

Of records with equal payloads of ``revisit_from`` bytes or more, the one with
the smallest id is the response; the others are revisits that name it.

Results in special cases: a null payload or url is empty; a record with a null
id is a response and never referred to, and its header carries no id; rows
that repeat the smallest id with the same payload are all responses; an empty
table gives an archive without files; other columns are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import partitions, prepare, stored
from fieldloom.llm.sharding import histogram_splitters, order_columns, piece_of
from fieldloom.session import work_dir

ROLL_BYTES = 64 << 20
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"   # the tables carry no crawl time
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # fixed value: the URL namespace of RFC 4122

_MANIFEST = "file string, shard int, roll int, records long, bytes long, sha256 string, first_id long, last_id long"
_RECORD = ("id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary, file string, file_offset long")


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload and digest of every page, with its place in the order of records."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    return (pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(url_col, F.lit("")).alias("url"),
                         payload.alias("payload"))
            .withColumn("digest", F.sha2("payload", 256)).withColumns(order_columns(F.col("id"), F.col("url"))))


def _revisits(keys: DataFrame, revisit_from: int) -> DataFrame:
    """keys of the records that repeat an earlier payload, with the id they refer to; payloads are not moved."""
    large = keys.filter((F.col("bytes") >= revisit_from) & F.col("id").isNotNull())
    first = (large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n"))
    return large.join(first, "digest").filter("id > refers_to")


def _record_uri(record_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(record_id))}>"


def _member(record_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_uri(record_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if record_id is not None:
        head.append(f"X-Source-ID: {record_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_uri(refers_to)}", f"X-Refers-To-ID: {refers_to}"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        attempt = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        done, out, state, announced = [], None, {}, (None, None, None)

        def close():
            out.close()
            name = f"part-{state['shard']:06d}-{state['roll']:04d}.warc.gz"
            where.move(state["temporary"], posixpath.join(top, name))
            done.append((name, state["shard"], state["roll"], state["records"], state["bytes"],
                         state["sha"].hexdigest(), state["first"], state["last"]))

        for batch in batches:
            shards, ids, urls, digests, refers = (
                batch.column(name).to_pylist() for name in ("_shard", "id", "url", "digest", "refers_to"))
            for i, payload in enumerate(batch.column("payload")):
                if payload.as_py() is None:     # announces that the record that follows is a revisit
                    announced = (ids[i], digests[i], refers[i])
                    continue
                refers_to = announced[2] if announced[:2] == (ids[i], digests[i]) else None
                full = out is not None and state["bytes"] >= roll_bytes
                if out is not None and (full or shards[i] != state["shard"]):
                    close()
                    out = None
                if out is None:
                    roll = state["roll"] + 1 if full and shards[i] == state["shard"] else 0
                    state = {"shard": shards[i], "roll": roll, "records": 0, "bytes": 0, "sha": hashlib.sha256(),
                             "first": ids[i], "temporary": posixpath.join(top, f"_writing-{attempt}-{shards[i]}-{roll}")}
                    out = where.open_output_stream(state["temporary"], compression=None)
                data = _member(ids[i], urls[i], payload.as_py(), digests[i], refers_to)
                out.write(data)
                state["records"] += 1
                state["bytes"] += len(data)
                state["sha"].update(data)
                state["last"] = ids[i]
            if done:
                yield _manifest_rows(done)
                done.clear()
        if out is not None:
            close()
            yield _manifest_rows(done)

    return write


def _manifest_rows(done: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=_names(_MANIFEST))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", shards: int | None = None, roll_bytes: int = ROLL_BYTES,
               revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write the archives under folder; returns the manifest, itself a table in folder/_manifest."""
    spark = prepare(pages.sparkSession)
    where, top = fs.FileSystem.from_uri(folder)
    where.create_dir(top, recursive=True)
    rows = _records(pages, id_col, url_col, payload_col)
    keys = stored(rows.select("id", "digest", "_major", "_minor", F.length("payload").cast("long").alias("bytes")),
                  "warc-keys")
    n = shards or partitions(spark)
    found = histogram_splitters(keys.select("_major", "_minor", (F.col("bytes") + 512).alias("_size")), n, tolerance=0.02)
    columns = ["_major", "_minor", "id", "url", "digest", "refers_to", "payload"]
    # a revisit is announced by a row without payload, so that the payloads move once
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(
        _revisits(keys, revisit_from).withColumns({"url": F.lit(""), "payload": F.lit(None).cast("binary")}).select(columns))
    ordered = (both.withColumn("_shard", piece_of(found.keys)("_major", "_minor"))
               .repartitionById(n, "_shard")
               .sortWithinPartitions("_shard", "_major", "_minor", "digest", F.col("payload").isNotNull())
               .select("_shard", "id", "url", "digest", "refers_to", "payload"))
    manifest = posixpath.join(folder, "_manifest")
    ordered.mapInArrow(_writer(folder, roll_bytes), _MANIFEST).write.mode("overwrite").parquet(manifest)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(posixpath.join(folder, "_manifest"))


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream, one at a time."""
    offset, pending = 0, b""
    while True:
        unpacker, start, parts = zlib.decompressobj(31), offset, []
        while not unpacker.eof:
            if not pending:
                pending = stream.read(1 << 18)
                if not pending:
                    if parts:
                        raise ValueError(f"archive ends inside the record at byte {start}")
                    return
            parts.append(unpacker.decompress(pending))
            offset += len(pending) - len(unpacker.unused_data)
            pending = unpacker.unused_data
        yield start, b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return headers, rest[:int(headers["Content-Length"])]


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        schema = pa.schema([
            ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
            ("file", pa.string()), ("file_offset", pa.int64())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(posixpath.join(top, name), compression=None) as stream:
                    for offset, data in _members(stream):
                        h, block = parse_record(data)
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        length = int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            if hashlib.sha256(block).hexdigest() != digest or len(block) != length:
                                raise ValueError(f"{name}: the record at byte {offset} does not match its digest")
                        source, refers = h.get("X-Source-ID"), h.get("X-Refers-To-ID")
                        rows.append((None if source is None else int(source), h["WARC-Target-URI"], h["WARC-Type"],
                                     None if refers is None else int(refers), length, digest,
                                     block if h["WARC-Type"] == "response" else None, name, offset))
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files in the manifest; digests are checked against the payloads.

    A revisit has no payload of its own: payload is null, payload_bytes and
    payload_digest tell of the record it refers to.
    """
    prepare(spark)
    manifest = read_manifest(spark, folder)
    files = manifest.select("file").repartition(max(1, partitions(spark)), "file")
    return files.mapInArrow(_reader(folder), _RECORD)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to a fresh folder and read them back."""
    folder = work_dir(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)
