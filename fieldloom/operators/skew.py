"""Joins and running aggregates that hold when one key owns much of the table.

Keys are counted first, pre-aggregated before the shuffle. Keys above the row
limit are salted (joins) or cut into ordered blocks (running aggregates); when
there are none, the plain Spark operator is used. Only row counts decide.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.session import durable

ROWS = "_key_rows"
PROBES, MANY = 1 << 14, 256     # buckets that keys are counted in first, and how many are named in a filter
SALT = "_salt"
SALTS = "_salts"
BLOCK = "_block"
# "find the hot keys yourself"; None means that there are none
PROBE = object()


@dataclass(frozen=True)
class SkewPolicy:
    """Limits, each read from ``spark.fieldloom.skew.<name>`` when set."""

    groupRows: int = 4_000_000     # a key with more rows is split
    pieceRows: int = 1_000_000     # rows per salt or block of a split key
    broadcastRows: int = 50_000    # more hot keys or block totals than this are joined with a shuffle

    @classmethod
    def of(cls, spark: SparkSession) -> SkewPolicy:
        base = cls()
        return replace(base, **{
            name: int(spark.conf.get(f"spark.fieldloom.skew.{name}", str(getattr(base, name))))
            for name in base.__dataclass_fields__
        })


@dataclass(frozen=True)
class HotKeys:
    """Keys with too many rows for one task, materialised, with their row counts."""

    table: DataFrame    # the keys and ROWS
    n_keys: int
    n_rows: int         # of all hot keys together


def shared(df: DataFrame) -> DataFrame:
    """A result that several outputs read: computed once and kept."""
    return durable(df)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> HotKeys | None:
    """The keys of df with more than ``groupRows`` rows, or None when there are none."""
    policy = SkewPolicy.of(df.sparkSession)
    rows, bucket = F.count(F.lit(1)), F.pmod(F.xxhash64(*keys), F.lit(PROBES))
    # a bucket without too many rows holds no such key; so few rows are shuffled where keys are many
    full = [r[0] for r in df.groupBy(bucket.alias("_probe")).agg(rows.alias(ROWS)).filter(F.col(ROWS) > policy.groupRows)
            .select("_probe").collect()]        # PROBES numbers at most
    if not full:
        return None
    suspects = df if len(full) > MANY else df.filter(bucket.isin(full))
    counts = suspects.groupBy(*keys).agg(rows.alias(ROWS)).filter(F.col(ROWS) > policy.groupRows)
    # the counting job itself is the probe; only a non-empty result is written
    n_keys, n_rows = counts.agg(F.count(F.lit(1)), F.sum(ROWS)).first()
    return HotKeys(durable(counts), n_keys, n_rows) if n_keys else None


def _bounded(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast df while it is small; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if n_rows <= SkewPolicy.of(df.sparkSession).broadcastRows else df


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & left[key].eqNullSafe(right["_hot_" + key])
    return match


def _marked(df: DataFrame, hot: DataFrame, n_rows: int, keys: Sequence[str], how: str) -> DataFrame:
    """Join df with a table about hot keys of n_rows rows, null keys included."""
    renamed = hot.select(*[F.col(k).alias("_hot_" + k) for k in keys],
                         *[c for c in hot.columns if c not in keys])
    joined = df.join(_bounded(renamed, n_rows), _same_key(df, renamed, keys), how)
    return joined.drop(*["_hot_" + k for k in keys])


def _splits_itself(spark: SparkSession) -> bool:
    adaptive = all(spark.conf.get(f"spark.sql.adaptive.{name}", "true") == "true" for name in ("enabled", "skewJoin.enabled"))
    return adaptive and spark.conf.get("spark.fieldloom.skew.groupRows", None) is None


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
              spread_by: Sequence[str], hot=PROBE) -> DataFrame:
    """``left.join(right, keys, how)`` where left may hold hot keys.

    Rows of a hot key are spread over several tasks by a hash of spread_by, and
    the matching right rows are repeated once per salt. Left drives the result,
    so ``how`` is inner, left, left_semi or left_anti. Pass ``hot`` when the
    hot keys are known from a cheaper table. Adaptive execution splits the left
    side of such joins by itself, so nothing is counted in front of them where
    it is on, unless the session sets a limit of its own.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} is not driven by the left side")
    keys = list(keys)
    if hot is PROBE:
        hot = None if _splits_itself(left.sparkSession) else hot_keys(left, keys)
    if hot is None:
        joined = left.join(right, keys, how)
    else:
        piece = SkewPolicy.of(left.sparkSession).pieceRows
        salts = hot.table.select(*keys, F.ceil(F.col(ROWS) / piece).cast("int").alias(SALTS))
        salted_left = _marked(left, salts, hot.n_keys, keys, "left").withColumn(
            SALT, F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col(SALTS)).cast("int"), F.lit(0)),
        ).drop(SALTS)
        salted_right = _marked(right, salts, hot.n_keys, keys, "left").withColumn(
            SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(SALTS) - 1, F.lit(0)))),
        ).drop(SALTS)
        joined = salted_left.join(salted_right, [*keys, SALT], how).drop(SALT)
    if how in ("left_semi", "left_anti"):
        return joined.select(*left.columns)
    return joined.select(*left.columns, *[c for c in right.columns if c not in keys])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key. Each map task forwards one row per key."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


_COMBINE = {
    F.sum: lambda local, carried: F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)),
    F.min: lambda local, carried: F.least(local, carried),
    F.max: lambda local, carried: F.greatest(local, carried),
}


class Running(NamedTuple):
    """A running sum, min or max: of the rows up to this one, or of those before it."""

    name: str
    fn: Callable[[Column], Column]
    value: Column
    inclusive: bool = True


class Timeline:
    """Rows in a total order within each key, ready for running aggregates.

    A key with too many rows is range-partitioned by (key, order) into blocks.
    A running value is then the running value inside the block combined with
    the totals of the key's earlier blocks, so no task ever holds a whole hot
    key. The block totals number at most blocks + hot keys. As in a join,
    ``hot`` may come from another table that holds at least the rows of df.
    ``order`` takes columns or sort expressions of any sortable type.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], hot=PROBE):
        self.keys, self.order = list(keys), list(order)
        self.hot = hot_keys(df, self.keys) if hot is PROBE else hot
        self.plain, self.blocks = df, None
        if self.hot is None:
            return
        n_blocks = -(-self.hot.n_rows // SkewPolicy.of(df.sparkSession).pieceRows)
        self.n_totals = n_blocks + self.hot.n_keys
        hot_only = self.hot.table.select(*self.keys)
        self.plain = _marked(df, hot_only, self.hot.n_keys, self.keys, "left_anti")
        self.blocks = durable(
            _marked(df, hot_only, self.hot.n_keys, self.keys, "left_semi")
            .repartitionByRange(n_blocks, *self.keys, *self.order)
            .withColumn(BLOCK, F.spark_partition_id())
        )

    def derive(self, **columns: Column) -> Timeline:
        """Add row-level columns."""
        self.plain = self.plain.withColumns(columns)
        if self.blocks is not None:
            self.blocks = self.blocks.withColumns(columns)
        return self

    def keep(self) -> Timeline:
        """Materialise the blocks, where later running values would compute them again."""
        if self.blocks is not None:
            self.blocks = durable(self.blocks)
        return self

    def running(self, *wanted: Running) -> Timeline:
        """Add running values; null where no row has counted yet."""
        self.plain = self._within(self.plain, self.keys, wanted)
        if self.blocks is not None:
            groups = [*self.keys, BLOCK]
            carried = self._carried(groups, wanted)
            joined = _marked(self._within(self.blocks, groups, wanted), carried, self.n_totals, groups, "left")
            self.blocks = joined.withColumns({
                w.name: _COMBINE[w.fn](F.col(w.name), F.col("_carried_" + w.name)) for w in wanted
            }).drop(*["_carried_" + w.name for w in wanted])
        return self

    def numbered(self, name: str) -> Timeline:
        """Add the row's number in its key, from 1; a filter on it prunes plain keys in the map tasks."""
        ordered = Window.partitionBy(*self.keys).orderBy(*self.order)
        self.plain = self.plain.withColumn(name, F.row_number().over(ordered).cast("long"))
        if self.blocks is not None:
            plain, self.plain = self.plain, self.plain.drop(name)
            self.running(Running(name, F.sum, F.lit(1).cast("long")))
            self.plain = plain
        return self

    def _within(self, df: DataFrame, groups: Sequence[str], wanted: Sequence[Running]) -> DataFrame:
        ordered = Window.partitionBy(*groups).orderBy(*self.order)
        return df.withColumns({
            w.name: w.fn(w.value).over(ordered.rowsBetween(
                Window.unboundedPreceding, Window.currentRow if w.inclusive else -1)) for w in wanted})

    def _carried(self, groups: Sequence[str], wanted: Sequence[Running]) -> DataFrame:
        """Per block the totals of the key's earlier blocks."""
        earlier = (Window.partitionBy(*self.keys).orderBy(BLOCK)
                   .rowsBetween(Window.unboundedPreceding, -1))
        totals = self.blocks.groupBy(*groups).agg(*[w.fn(w.value).alias(w.name) for w in wanted])
        return totals.select(*groups, *[
            w.fn(F.col(w.name)).over(earlier).alias("_carried_" + w.name) for w in wanted])

    def rows(self) -> DataFrame:
        if self.blocks is None:
            return self.plain
        return self.plain.unionByName(self.blocks.drop(BLOCK))
