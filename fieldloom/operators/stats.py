"""Per-user statistics: one partial aggregation each, zeros for users without rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import dimensions
from fieldloom.functions.numbers import ratio


def _per_user(users: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals for every user; both sides hold a user once, so no key is hot."""
    return users.select("user_id").join(totals, "user_id", "left").na.fill(0)


def match_totals(logs: DataFrame) -> DataFrame:
    """Uses, fields and successes of the users that occur in the logs."""
    return logs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_uses"),
        F.sum("fields_count").alias("total_fields"),
        F.sum("success_count").alias("total_successes"),
    )


def with_success_rate(totals: DataFrame) -> DataFrame:
    return totals.withColumn("success_rate", ratio(F.col("total_successes"), F.col("total_fields")))


def match_stats(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Uses, fields, successes and success rate of every user."""
    return with_success_rate(_per_user(users, match_totals(logs)))


def usage_stats(grants: DataFrame, users: DataFrame) -> DataFrame:
    """Remaining uses and number of grants, used-up ones included, of every user."""
    return _per_user(users, grants.groupBy("user_id").agg(
        F.sum("remaining_uses").alias("remaining_uses"),
        F.count(F.lit(1)).alias("total_activations"),
    ))


def remaining_uses(grants: DataFrame, users: DataFrame) -> DataFrame:
    return _per_user(users, grants.groupBy("user_id").agg(F.sum("remaining_uses").alias("remaining_uses")))


def resume_count(resumes: DataFrame, users: DataFrame) -> DataFrame:
    return _per_user(users, resumes.groupBy("user_id").agg(F.count(F.lit(1)).alias("resume_count")))


def field_type_usage(form_fields: DataFrame) -> DataFrame:
    """Accepted field types with the number of form fields of each; counted before joining."""
    used = (form_fields.filter(F.col("type").isin(*dimensions.ACCEPTED_TYPES))
            .groupBy("type").agg(F.count(F.lit(1)).alias("n_fields")))
    return (dimensions.field_types(form_fields.sparkSession).join(F.broadcast(used), "type", "left")
            .withColumn("n_fields", F.coalesce("n_fields", F.lit(0))))
