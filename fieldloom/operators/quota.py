"""Use quotas: grants add uses, each use takes one from the oldest grant that has any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.skew import PROBE, Running, Timeline, shared

GRANT, USE = 0, 1
ORDER = ["event_at", "kind", "event_id"]


def grant_events(grants: DataFrame) -> DataFrame:
    return grants.select(
        "user_id", F.col("activated_at").alias("event_at"), F.lit(GRANT).alias("kind"),
        F.col("activation_id").alias("event_id"), F.col("remaining_uses").cast("long").alias("delta"))


def quota_events(grants: DataFrame, uses: DataFrame) -> DataFrame:
    """Grants and uses as one timeline; at equal times grants come first, then ids decide."""
    return grant_events(grants).unionByName(uses.select(
        "user_id", F.col("used_at").alias("event_at"), F.lit(USE).alias("kind"),
        F.col("use_id").alias("event_id"), F.lit(-1).cast("long").alias("delta")))


def ledger_timeline(events: DataFrame, hot=PROBE) -> Timeline:
    """Events with ``ok`` and the running ``balance``.

    Let S be the running sum of deltas and L the lowest S before the row, at
    most 0. Every failed use has lowered L by one, so a use fails exactly when
    S drops below L, and the balance is S less the lower of the two.
    """
    timeline = Timeline(events, ["user_id"], ORDER, hot)
    timeline.running(Running("running_sum", F.sum, F.col("delta"))).keep()
    timeline.running(Running("running_low", F.min, F.col("running_sum"), inclusive=False))
    low = F.least(F.lit(0), F.coalesce("running_low", F.lit(0)))
    return timeline.derive(
        ok=F.col("running_sum") >= low,
        balance=F.col("running_sum") - F.least(low, F.col("running_sum")),
    )


def quota_ledger(grants: DataFrame, uses: DataFrame) -> DataFrame:
    """Every use with whether it was covered and the balance after it."""
    return (ledger_timeline(quota_events(grants, uses)).rows().filter(F.col("kind") == USE)
            .select(F.col("event_id").alias("use_id"), "user_id",
                    F.col("event_at").alias("used_at"), "ok", "balance"))


def closing_balances(ledger_rows: DataFrame) -> DataFrame:
    """Each user's balance after all rows of a ledger timeline."""
    return ledger_rows.groupBy("user_id").agg(
        (F.sum("delta") - F.least(F.lit(0), F.min("running_sum"))).alias("balance"))


@dataclass(frozen=True)
class Attribution:
    uses: DataFrame     # use_id, user_id, activation_id of each covered use
    grants: DataFrame   # grants with the uses left after all of them


def quota_attribution(grants: DataFrame, uses: DataFrame) -> Attribution:
    """Which grant each covered use drew from, and what each grant has left.

    A user's grants in order cover the ordinals of that user's covered uses in
    consecutive stretches. Each grant is placed at the first ordinal it covers;
    sorted by ordinal, a use belongs to the last grant at or before it. This
    takes running aggregates only: no pairs of grants and uses are formed.
    """
    covered = F.when((F.col("kind") == USE) & F.col("ok"), 1).otherwise(0)
    granted = F.when(F.col("kind") == GRANT, F.col("delta")).otherwise(F.lit(0))
    ledger = ledger_timeline(quota_events(grants, uses)).keep()
    ledger.running(Running("_uses", F.sum, covered), Running("_granted", F.sum, granted)).keep()
    placed = (
        ledger.rows()
        .filter(F.when(F.col("kind") == USE, F.col("ok")).otherwise(F.col("delta") > 0))
        .select("user_id", "kind", "event_id",
                F.when(F.col("kind") == USE, F.col("_uses"))
                .otherwise(F.col("_granted") - F.col("delta") + 1).alias("ordinal"))
    )
    latest = F.when(F.col("kind") == GRANT, F.struct("ordinal", "event_id"))
    drawn = shared(
        Timeline(placed, ["user_id"], ["ordinal", "kind", "event_id"], ledger.hot)
        .running(Running("_grant", F.max, latest)).rows().filter(F.col("kind") == USE)
        .select(F.col("event_id").alias("use_id"), "user_id", F.col("_grant.event_id").alias("activation_id"))
    )
    counts = drawn.groupBy("activation_id").agg(F.count(F.lit(1)).alias("_drawn"))
    left = grants.join(counts, "activation_id", "left").withColumn(
        "remaining_uses", F.col("remaining_uses") - F.coalesce("_drawn", F.lit(0))).select(*grants.columns)
    return Attribution(drawn, left)


def first_available_grant(grants: DataFrame) -> DataFrame:
    """Per user the oldest grant with uses left; ambiguous when there are several."""
    oldest = F.min(F.struct("activated_at", "activation_id", "code_id", "remaining_uses"))
    return (
        grants.filter(F.col("remaining_uses") > 0).groupBy("user_id")
        .agg(oldest.alias("g"), F.count(F.lit(1)).alias("n_available"))
        .select("user_id", "g.activation_id", "g.code_id", "g.remaining_uses", "g.activated_at",
                "n_available", (F.col("n_available") > 1).alias("ambiguous"))
    )
