"""The active-user gate in front of a batch of changes, as of the time of each request.

A batch may hold the deactivations that close the gate for later requests of the
same batch. Deactivation is final, so a user's first one is all of the history
that a request has to be compared with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.lookup import gate_verdict
from fieldloom.operators.skew import PROBE, shared, skew_join


@dataclass(frozen=True)
class Gate:
    passed: DataFrame     # the requests that go on
    refused: DataFrame    # the others, with the gate's reason as their verdict

    def verdicts(self, judged: DataFrame) -> DataFrame:
        """Verdicts of the passed requests and of the refused ones."""
        return judged.unionByName(self.refused, allowMissingColumns=True).select(*judged.columns)


def gate_as_of(requests: DataFrame, users: DataFrame, deactivations: DataFrame, hot=PROBE) -> DataFrame:
    """Requests with ``gate`` by the status of their user when they come.

    A deactivation at the same time comes first. A request without a time is
    judged by the status before the batch.
    """
    closed = deactivations.groupBy("user_id").agg(F.min("requested_at").alias("_closed_at"))
    status = users.select("user_id", F.col("status").alias("_status")).join(closed, "user_id", "left")
    now = F.when(F.col("_closed_at") <= F.col("requested_at"), "inactive").otherwise(F.col("_status"))
    return (skew_join(requests, status, ["user_id"], "left", ["request_id"], hot)
            .withColumn("gate", F.when(F.col("_status").isNotNull(), gate_verdict(now)).otherwise("invalid_credentials"))
            .drop("_status", "_closed_at"))


def behind_gate(requests: DataFrame, users: DataFrame, deactivations: DataFrame) -> Gate:
    """The requests split by the gate, which is judged once."""
    judged = shared(gate_as_of(requests, users, deactivations))
    refused = judged.filter("gate <> 'pass'").withColumnRenamed("gate", "verdict")
    return Gate(judged.filter("gate = 'pass'").drop("gate"), refused)
