"""Quota and redemption over streams whose events may arrive out of order.

Events are held until the watermark (the latest event time less ``delay``) has
passed them, and released in order of time; a batch is then a bulk run of the
batch operator on the released events with the state of their users or codes
as its input. An event at or behind a watermark that has already passed comes
out as late and changes nothing.

State is kept in logs (see ``state``): a balance per user, the codes, and the
pairs of user and code that hold a grant. A batch reads the buckets of its own
keys and writes the rows it changed. With ``final`` the held events are released
as if the stream ended now; a later arrival takes that back.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import codes as code_ops
from fieldloom.operators import quota
from fieldloom.sources.tables import write_version
from fieldloom.streaming import runs
from fieldloom.streaming.state import StateLog, StreamState

_OPENING = "timestamp_ntz '0001-01-01 00:00:00'"
AT_ONCE = timedelta(0)


def _advance(stream: DataFrame, folder: str, step: Callable[[DataFrame, StreamState, bool], None], final: bool) -> None:
    """Run step on every micro-batch, and on no rows at all to end the stream."""
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int, last: bool = False) -> None:
        state = StreamState(spark, folder, batch_id)
        step(batch, state, last)
        state.commit()

    runs.each_batch(stream, folder, run)
    if final:
        state = StreamState.latest(spark, folder, ended=False)
        if state.held:
            run(spark.createDataFrame([], stream.schema), state.batch_id, True)


def _balances(state: StreamState) -> StateLog:
    return state.log("balances", ["user_id"], "user_id long, balance long")


def stream_quota_ledger(events: DataFrame, folder: str, delay: timedelta = AT_ONCE, final: bool = False) -> DataFrame:
    """The ledger of a stream of quota events, uses only, with ``late`` (then ok and balance are null).

    A user's balance opens the next batch as a grant before all its events.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, state: StreamState, last: bool) -> None:
        rows = f"{folder}/rows/batch={state.batch_id}"
        due, late = state.release(batch, "event_at", None if last else delay)
        balances = _balances(state)
        opening = balances.lookup(due).select(
            "user_id", F.expr(_OPENING).alias("event_at"), F.lit(quota.GRANT).alias("kind"),
            F.lit(-1).cast("long").alias("event_id"), F.col("balance").alias("delta"))
        ledger = quota.ledger_timeline(due.unionByName(opening)).rows()
        columns = ledger.columns
        refused = late.withColumns({c: F.lit(None).cast(ledger.schema[c].dataType) for c in columns if c not in late.columns})
        write_version(ledger.withColumn("late", F.lit(False)).unionByName(refused.withColumn("late", F.lit(True))), rows)
        if state.released:
            balances.put(quota.closing_balances(spark.read.parquet(rows).filter("not late")))

    _advance(events, folder, step, final)
    return spark.read.parquet(f"{folder}/rows").filter(F.col("kind") == quota.USE).select(
        F.col("event_id").alias("use_id"), "user_id", F.col("event_at").alias("used_at"), "ok", "balance", "late")


def quota_balances(spark: SparkSession, folder: str) -> DataFrame:
    """Every user's balance after the released events."""
    return _balances(StreamState.latest(spark, folder)).read()


def stream_redeem(requests: DataFrame, codes: DataFrame, grants: DataFrame, folder: str,
                  delay: timedelta = AT_ONCE, final: bool = False) -> DataFrame:
    """Verdicts for a stream of redeem requests; ``late`` is one of them.

    The first batch takes codes and grants over as state; afterwards only the
    state is read.
    """
    spark = requests.sparkSession

    def step(batch: DataFrame, state: StreamState, last: bool) -> None:
        verdicts = f"{folder}/verdicts/batch={state.batch_id}"
        table = state.log("codes", ["code"], codes.schema)
        held = state.log("held", ["user_id", "code_id"], grants.select("user_id", "code_id").schema)
        if state.batch_id == 0:
            table.put(codes, seed=True)
            held.put(grants.select("user_id", "code_id").distinct(), seed=True)
        due, late = state.release(batch, "requested_at", None if last else delay)
        now = table.lookup(due)
        pairs = due.join(now.select("code", "code_id"), "code").select("user_id", "code_id")
        judged = code_ops.redeem_codes(due, now, held.lookup(pairs)).verdicts
        refused = late.withColumns({"code_id": F.lit(None).cast("long"), "verdict": F.lit("late")})
        write_version(judged.unionByName(refused), verdicts)
        if state.released:
            accepted = spark.read.parquet(verdicts).filter(F.col("verdict") == "ok")
            table.put(code_ops.codes_after(now.join(accepted.select("code").distinct(), "code", "left_semi"), accepted))
            held.put(accepted.select("user_id", "code_id"))

    _advance(requests, folder, step, final)
    return spark.read.parquet(f"{folder}/verdicts").select(*requests.columns, "code_id", "verdict")
