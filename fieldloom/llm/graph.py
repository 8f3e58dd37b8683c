"""Connected components of link tables, without holding a component in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored

BLOCK = 512                 # rows of a bucket compared at once
LINKS_PER_TASK = 500_000    # links that a task may hold in memory


def components(links: DataFrame) -> DataFrame:
    """links(a, b), either direction, to (node, root): the smallest node of each component.

    Tasks of at most LINKS_PER_TASK links first join what they hold to stars.
    Where there are several tasks, large stars (every larger neighbour is
    linked to the smallest neighbour) and small stars (every smaller neighbour
    as well) then alternate until nothing changes. They only compare a node
    with the smallest of its neighbours, which is pre-aggregated; a hub is
    joined, never collected. Nodes without a link to another node do not
    appear. Nulls are ignored.
    """
    edges = stored(links.filter("a is not null and b is not null and a <> b")
                   .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = max(1, -(-edges.count() // LINKS_PER_TASK))
    edges = stored(edges.repartition(tasks).mapInArrow(_stars_of_task, "a long, b long"), "edges")
    seen = None
    while tasks > 1:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        edges = stored(_star(large, larger=False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                        F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as links of each node with the smallest node it reaches."""
    parent: dict[int, int] = {}

    def find(node: int) -> int:
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[up]
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    stars = [(node, root) for node in parent if (root := find(node)) != node]
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges(a, b) to links of a's neighbours, and of a itself, with the smallest of them."""
    if larger:
        smallest = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        out = edges.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()
    # here b < a in every row: the neighbours of a node are the smaller ones
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(smallest, "a")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        smallest.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(uid) with a root that tells their component under links(a, b)."""
    linked = components(links)
    return stored(nodes.join(linked, nodes["uid"] == linked["node"], "left").select(
        "uid", F.coalesce("root", "uid").alias("root")), "roots")


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """known(uid, root) after further links(a, b); only the components that links join are worked on."""
    root_of = lambda c: known.select(F.col("uid").alias(c), F.col("root").alias(f"root_{c}"))
    between = (links.join(root_of("a"), "a").join(root_of("b"), "b")
               .select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    joined = components(between).withColumnRenamed("root", "_root")
    return stored(known.join(joined, known["root"] == joined["node"], "left").select(
        "uid", F.coalesce("_root", "root").alias("root")), "roots")


PIECE = ["bucket", "lp", "rp"]


def open_pieces(rows: DataFrame, facts: DataFrame, known: DataFrame) -> DataFrame:
    """Rows(bucket, band, uid) of buckets that a star around their smallest uid has not settled, dealt into pieces.

    ``known`` has the root of each uid so far. A bucket is settled when all its
    uids are in one component: further links inside it could change nothing. In
    the others, uids outside the bucket's largest component (left) have to meet
    those of other components. The rows of a bucket are cut into blocks; a piece
    (bucket, lp, rp) holds one block of left rows and one of all rows.
    """
    rooted = stored(rows.join(known, "uid"), "rooted")
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    unsettled = (sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
        # of two uids the star has compared the only pair
        .filter("parts > 1 and size > 2").select("bucket", F.col("top.root").alias("main"), "size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    open_ = (rooted.join(unsettled, "bucket").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).join(facts, "uid"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = [*PIECE, "left", "band", "root", *facts.columns]
    right = open_.withColumns({"rp": F.col("block"), "left": F.lit(False)}).withColumn("lp", every).select(columns)
    left = (open_.filter("root <> main").withColumns({"lp": F.col("block"), "left": F.lit(True)})
            .withColumn("rp", every).select(columns))
    return right.unionByName(left)


def _columns(table: pa.Table) -> dict:
    rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "uid", "root", "band")}
    return rows | {c: table.column(c).to_pylist() for c in table.column_names if c not in rows}


def _index_pairs(table: pa.Table, near) -> tuple[dict, np.ndarray, np.ndarray]:
    """near(columns) of a piece, which returns index pairs (left row, other row); none where one side is empty."""
    rows = _columns(table)
    a, b = near(rows) if rows["left"].any() and not rows["left"].all() else (np.zeros(0, int),) * 2
    return rows, a, b


def pairs_in_pieces(pieces: DataFrame, near) -> DataFrame:
    """The pairs(a, b) that ``near`` finds in each piece."""
    def compare(table):
        rows, a, b = _index_pairs(table, near)
        a, b = rows["uid"][a], rows["uid"][b]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return pieces.groupBy(*PIECE).applyInArrow(compare, "a long, b long").distinct()


def rows_in_pairs(pieces: DataFrame, near) -> DataFrame:
    """The rows of each piece that are in any pair ``near`` finds: rows are returned, not pairs."""
    def compare(table):
        _, a, b = _index_pairs(table, near)
        return table.take(pa.array(np.unique(np.concatenate((a, b)))))

    return pieces.groupBy(*PIECE).applyInArrow(compare, pieces.schema)
