import gzip
import hashlib
import os

from llm_helpers import DOC_SCHEMA, rows

from fieldloom.llm.warc import archive_round_trip, read_manifest, read_warc, write_warc
from fieldloom.session import work_dir

BIG = "<p>" + "x" * 200
CASES = [(5, BIG), (3, BIG), (8, BIG), (1, "small"), (2, "small"), (4, None), (6, ""), (7, "ü" * 49), (9, "ü" * 50),
         (10, "ü" * 50), (None, BIG), (11, "y" * 300_000), (12, "a\r\n\r\nWARC/1.1\r\n" * 20), (13, BIG + "z"), (13, BIG + "z")]


def pages(spark, cases):
    df = spark.createDataFrame(rows(*cases), DOC_SCHEMA)
    return df.toDF("page_id", "html", "url", *df.columns[3:])


def expected(cases):
    out = []
    for i, html in cases:
        data = (html or "").encode()
        same = [j for j, h in cases if (h or "") == (html or "") and j is not None]
        first = min(same) if same else None
        revisit = len(data) >= 100 and i is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = archive_round_trip(pages(spark, CASES)).collect()
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got),
                  key=str) == expected(CASES)
    for r in got:
        assert r["payload"] is None or hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]


def test_empty_table(spark):
    assert archive_round_trip(pages(spark, [])).count() == 0


def test_same_bytes_every_time_and_rolled_files(spark):
    cases = [(i, f"{i} " * (50 + i % 7)) for i in range(200)]
    folders = [work_dir(spark, "warc-test") for _ in range(2)]
    for folder, n in zip(folders, (1, 9), strict=True):
        write_warc(pages(spark, cases).repartition(n), folder, shards=3, roll_bytes=2000)
    names = [sorted(n for n in os.listdir(f) if n.endswith(".gz")) for f in folders]
    assert names[0] == names[1] and len(names[0]) > 6
    for name in names[0]:
        with open(f"{folders[0]}/{name}", "rb") as a, open(f"{folders[1]}/{name}", "rb") as b:
            data = a.read()
            assert data == b.read()
        # plain gzip readers see whole records
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    manifest = read_manifest(spark, folders[0]).collect()
    assert sum(m["records"] for m in manifest) == 200 and {m["file"] for m in manifest} == set(names[0])
    ids = [r["id"] for r in read_warc(spark, folders[0]).orderBy("file", "file_offset").collect()]
    assert ids == list(range(200))
    assert not [n for n in os.listdir(folders[0]) if n.startswith("_writing")]
