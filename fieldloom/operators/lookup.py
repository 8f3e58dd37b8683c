"""Batch lookups, gates and verdicts: a table of requests against state tables.

Requests may repeat one key any number of times, so every lookup goes through
``skew_join``. Absent keys read as a verdict, never as a dropped request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import is_blank
from fieldloom.operators.skew import PROBE, skew_join


def lookup_one_or_none(requests: DataFrame, state: DataFrame, keys: Sequence[str],
                       request_id: str = "request_id", strict: bool = False) -> DataFrame:
    """Each request with the state row of its key, and ``n_found``.

    More than one row for a key is a violation: the request gets the count and
    null columns, or an error in strict mode.
    """
    values = [c for c in state.columns if c not in keys]
    per_key = state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_found"), *[F.first(c).alias(c) for c in values])
    single = per_key.select(
        *keys, "n_found", *[F.when(F.col("n_found") == 1, F.col(c)).alias(c) for c in values])
    found = skew_join(requests, single, keys, "left", [request_id]).withColumn(
        "n_found", F.coalesce("n_found", F.lit(0)))
    if strict:
        found = found.withColumn("n_found", F.when(F.col("n_found") <= 1, F.col("n_found")).otherwise(
            F.raise_error(F.lit("more than one row for a lookup key")).cast("long")))
    return found


def gate_verdict(status: Column) -> Column:
    return (F.when(status.isNull(), "invalid_credentials")
            .when(status != "active", "deactivated").otherwise("pass"))


def active_user_gate(requests: DataFrame, users: DataFrame, hot=PROBE) -> DataFrame:
    """Requests with ``gate``: invalid_credentials, deactivated or pass."""
    status = users.select("user_id", F.col("status").alias("_status"))
    return (skew_join(requests, status, ["user_id"], "left", ["request_id"], hot)
            .withColumn("gate", gate_verdict(F.col("_status"))).drop("_status"))


def login_gate(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Login requests by email: pass for a known active user, else invalid_credentials."""
    status = users.select("email", F.col("status").alias("_status"))
    passes = F.coalesce(F.col("_status") == "active", F.lit(False))
    return (skew_join(requests, status, ["email"], "left", ["request_id"])
            .withColumn("gate", F.when(passes, "pass").otherwise("invalid_credentials")).drop("_status"))


def rows_for(state: DataFrame, requests: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The state rows whose key some request names, each once."""
    return skew_join(state, requests.select(*keys).distinct(), keys, "left_semi", [row_id])


def owned_resumes(requests: DataFrame, resumes: DataFrame, columns: Sequence[str], hot=PROBE) -> DataFrame:
    """Requests with ``found`` and columns of the resume, when the requester owns it."""
    owned = resumes.select("resume_id", "user_id", F.lit(True).alias("found"), *columns)
    return (skew_join(requests, owned, ["resume_id", "user_id"], "left", ["request_id"], hot)
            .withColumn("found", F.coalesce("found", F.lit(False))))


def code_verdict(now: Column) -> Column:
    """The first failing check of a code, in the order the checks are made."""
    return (
        F.when(F.col("code_id").isNull(), "not_found")
        .when(F.col("status") != "active", "inactive")
        .when(F.col("expires_at") < now, "expired")
        .when(F.col("used_count") >= F.col("total_uses"), "exhausted")
        .otherwise("valid")
    )


def with_code(requests: DataFrame, codes: DataFrame, hot=PROBE) -> DataFrame:
    """Redeem requests with their code's row; unknown codes give nulls."""
    state = codes.select("code", "code_id", "total_uses", "used_count", "status", "expires_at")
    return skew_join(requests, state, ["code"], "left", ["request_id"], hot)


def validate_codes(requests: DataFrame, codes: DataFrame, now: Column) -> DataFrame:
    """Each request's verdict on its code at time now, and the uses left when valid."""
    joined = with_code(requests, codes).withColumn("verdict", code_verdict(now))
    left = F.when(F.col("verdict") == "valid", F.col("total_uses") - F.col("used_count"))
    return joined.select(*requests.columns, "verdict", left.alias("remaining_uses"))


def already_redeemed(requests: DataFrame, codes: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests with a flag: the user already holds a grant of that code."""
    held = grants.select("user_id", "code_id").distinct().withColumn("already_redeemed", F.lit(True))
    ids = codes.select("code", "code_id")
    # a code's rows are the requests' rows: counted on the table, not on the join
    joined = skew_join(requests, ids, ["code"], "left", ["request_id"])
    return (skew_join(joined, held, ["user_id", "code_id"], "left", ["request_id"])
            .withColumn("already_redeemed", F.coalesce("already_redeemed", F.lit(False))))


def new_rows(candidates: DataFrame, existing: DataFrame, key: str, candidate_id: str, hot=PROBE) -> DataFrame:
    """Candidates whose key is not in the existing table; exact, case-sensitive equality."""
    return skew_join(candidates, existing.select(key), [key], "left_anti", [candidate_id], hot)


def requests_with_resume(requests: DataFrame, resumes: DataFrame, text: Column, hot=PROBE) -> DataFrame:
    """Match requests with their resume's text, and why there is none."""
    # judged on the resume's side, so that the text moves only for those who read it
    texts = resumes.select("resume_id", "user_id", text.alias("resume_text"), is_blank(text).alias("_empty"))
    return owned_resumes(requests, texts, ["resume_text", "_empty"], hot).withColumn(
        "resume_verdict",
        F.when(~F.col("found"), "resume_not_found").when(F.col("_empty"), "resume_empty").otherwise("ok"),
    ).drop("found", "_empty")
