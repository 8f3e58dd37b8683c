"""Byte-balanced shards by histogram sort.

The splitters between shards are found without sampling: each round counts the
exact bytes below a few candidate keys inside every open interval, over all
partitions at once, and narrows the interval around the target. A splitter is
done when the bytes below it are within the tolerance of its target or one row
at most lies between its bounds. Then every row moves once, to its final piece.

Rows are ordered by (key, hash of the text), so the rows of a key that owns a
third of the table are divided as well. Only rows equal in both stay together.

Results in special cases: a null text has no bytes; a null key sorts first and
counts as the smallest long; equal rows are all placed, next to each other; an
empty table gives an empty result; other columns pass through unchanged, but
input columns called like the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import partitions, prepare, stored

PROBES = 15         # candidate keys per open splitter and round
TOLERANCE = 0.001   # of a piece's bytes, by which a splitter may miss its target
ROW_OVERHEAD = 16
_SIGN = 1 << 63


@dataclass(frozen=True)
class Splitters:
    """Piece p holds the keys k with keys[p-1] <= k < keys[p]; keys are 128-bit integers."""

    keys: list[int]
    rows: list[int]         # exact rows below each splitter
    sizes: list[int]        # exact bytes below each splitter
    total_rows: int
    total_size: int
    rounds: int


def order_columns(key: Column, text: Column) -> dict[str, Column]:
    """The order of rows: the key, null first, then the hash of the text."""
    return {"_major": F.coalesce(key.cast("long"), F.lit(-_SIGN)), "_minor": F.xxhash64(text)}


def _packed(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Two longs as one 16-byte string that compares like the pair."""
    pair = np.empty((len(major), 2), ">u8")
    pair[:, 0] = major.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    pair[:, 1] = minor.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return pair.view("S16").ravel()


def _as_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def piece_of(keys: list[int]):
    """A column function: how many of the ascending keys are at or below the row's (major, minor)."""
    fences = _as_bytes(keys)

    @F.pandas_udf("int")
    def place(major: pd.Series, minor: pd.Series) -> pd.Series:
        at = np.searchsorted(fences, _packed(major.to_numpy(), minor.to_numpy()), side="right")
        return pd.Series(at.astype(np.int32))

    return place


def _counted(table: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact rows and bytes below each ascending probe: one pass, one row per probe comes back."""
    counts = (table.groupBy(piece_of(probes)("_major", "_minor").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")).collect())
    rows, sizes = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for c in counts:
        rows[c["bin"]], sizes[c["bin"]] = c["n"], c["s"]
    return np.cumsum(rows)[:-1].tolist(), np.cumsum(sizes)[:-1].tolist()


def histogram_splitters(table: DataFrame, pieces: int, tolerance: float = TOLERANCE) -> Splitters:
    """Splitters that cut table(_major, _minor, _size) into pieces of nearly equal size."""
    low, high, n, total = table.agg(F.min("_major"), F.max("_major"), F.count(F.lit(1)), F.sum("_size")).first()
    if not n or pieces < 2:
        return Splitters([], [], [], n or 0, total or 0, 0)
    targets = [total * i // pieces for i in range(1, pieces)]
    slack = tolerance * total / pieces
    # per splitter the closest known keys at or below and above its target: (key, rows, bytes)
    under = [((low + _SIGN) << 64, 0, 0)] * len(targets)
    over = [((high + _SIGN + 1) << 64, n, total)] * len(targets)
    rounds = 0
    while True:
        probes = set()
        for t, u, o in zip(targets, under, over, strict=True):
            if min(t - u[2], o[2] - t) > slack and o[1] - u[1] > 1 and o[0] - u[0] > 1:
                probes |= {u[0] + (o[0] - u[0]) * j // (PROBES + 1) for j in range(1, PROBES + 1)} - {u[0]}
        if not probes:
            break
        found = sorted(probes)
        found = list(zip(found, *_counted(table, found), strict=True))
        sizes = np.array([f[2] for f in found])
        for i, t in enumerate(targets):
            at = int(np.searchsorted(sizes, t, side="right"))   # the first probe with more bytes below it
            if at and found[at - 1][0] > under[i][0]:
                under[i] = found[at - 1]
            if at < len(found) and found[at][0] < over[i][0]:
                over[i] = found[at]
        rounds += 1
    best = [u if t - u[2] <= o[2] - t else o for t, u, o in zip(targets, under, over, strict=True)]
    top = (1 << 128) - 1    # a key that no row reaches stands for "above all rows"
    return Splitters([min(b[0], top) for b in best], [b[1] for b in best], [b[2] for b in best], n, total, rounds)


def place_in_shards(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """rows(_major, _minor, _size, ...) with shard and slot; one exchange of the rows."""
    # a shard is cut into pieces of its own, so tasks do not grow with the shards
    per_shard = max(1, -(-partitions(rows.sparkSession) // n_shards))
    table = stored(rows.select("_major", "_minor", "_size"), "shard-keys")
    found = histogram_splitters(table, n_shards * per_shard, tolerance)
    # rows below each piece, less those below its shard
    below = [0, *found.rows]
    offsets = [b - below[p // per_shard * per_shard] for p, b in enumerate(below)]
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_piece") + 1)
    inside = Window.partitionBy("_piece").orderBy("_major", "_minor")
    return (rows.withColumn("_piece", piece_of(found.keys)("_major", "_minor"))
            .repartitionById(len(below), "_piece")
            .withColumn("slot", F.row_number().over(inside) - 1 + offset)
            .withColumn("shard", F.floor(F.col("_piece") / per_shard).cast("int")).drop("_piece"))


def byte_shards(docs: DataFrame, n_shards: int, key_col: str = "doc_id", text_col: str = "text",
                tolerance: float = TOLERANCE) -> DataFrame:
    """docs with ``size`` (bytes of the text + 16), ``shard`` (from 0) and ``slot`` (gapless from 0 in a shard)."""
    prepare(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot")]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD).cast("long")
    order = order_columns(F.col(key_col), F.col(text_col))
    rows = docs.select(F.struct(*kept).alias("_row"), size.alias("_size"), *[c.alias(n) for n, c in order.items()])
    placed = place_in_shards(rows, n_shards, tolerance)
    return placed.select("_row.*", F.col("_size").alias("size"), "shard", "slot")
