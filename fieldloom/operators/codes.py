"""Activation codes: redeeming under capacity and expiry, and issuing new ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.operators.lookup import new_rows, with_code
from fieldloom.operators.skew import Running, Timeline, first_rows, hot_keys, shared, skew_join

ORDER = ["requested_at", "request_id"]
# Fixed value: the characters of a code.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@dataclass(frozen=True)
class Redemption:
    verdicts: DataFrame   # requests with their verdict
    grants: DataFrame     # the new grants
    codes: DataFrame      # codes with their next counter and status


def redeem_codes(requests: DataFrame, codes: DataFrame, grants: DataFrame) -> Redemption:
    """Redeem a batch in time order, each code up to its capacity.

    Only a user's first usable request for a code can succeed, and only when no
    earlier grant exists. Those candidates are numbered per code; the one that
    takes the last place closes the code, and every later request finds it
    inactive. All other verdicts follow from the request's own row.
    """
    room = F.greatest(F.col("total_uses") - F.col("used_count"), F.lit(0))
    hot = hot_keys(requests, ["code"])
    joined = with_code(requests, codes, hot).withColumn("_room", room)
    usable = (
        (F.col("status") == "active") & (F.col("_room") > 0)
        & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("requested_at")))
    )
    held = grants.select("user_id", "code_id").distinct()
    candidates = first_rows(
        joined.filter(usable).select("request_id", "user_id", "requested_at", "code", "code_id", "_room"),
        ["user_id", "code_id"], ORDER,
    ).join(held, ["user_id", "code_id"], "left_anti")
    numbered = Timeline(candidates, ["code"], ORDER, hot).running(Running("_place", F.sum, F.lit(1))).rows()
    granted = shared(numbered.filter(F.col("_place") <= F.col("_room")))
    closings = granted.filter(F.col("_place") == F.col("_room")).select(
        "code", F.struct(*ORDER).alias("_closing"))

    closed = skew_join(joined, closings, ["code"], "left", ["request_id"], hot)
    flagged = closed.join(granted.select("request_id", F.lit(True).alias("_granted")), "request_id", "left")
    verdict = (
        F.when(F.col("code_id").isNull(), "not_found")
        .when(F.col("status") != "active", "inactive")
        .when(F.struct(*ORDER) > F.col("_closing"), "inactive")
        .when(F.col("expires_at") < F.col("requested_at"), "expired")
        .when(F.col("_room") == 0, "exhausted")
        .when(F.col("_granted"), "ok").otherwise("duplicate")
    )
    verdicts = flagged.select(*requests.columns, "code_id", verdict.alias("verdict"))
    return Redemption(verdicts, grants_of(granted), codes_after(codes, granted))


def grants_of(accepted: DataFrame) -> DataFrame:
    """The grant of each accepted request; its size does not depend on the code."""
    return accepted.select(
        F.col("request_id").alias("activation_id"), "user_id", "code_id",
        F.lit(schemas.USES_PER_REDEMPTION).alias("remaining_uses"),
        F.col("requested_at").alias("activated_at"))


def codes_after(codes: DataFrame, accepted: DataFrame) -> DataFrame:
    """Codes with their counter raised by the accepted requests; full ones become used."""
    taken = accepted.groupBy("code_id").agg(F.count(F.lit(1)).cast("int").alias("_taken"))
    used = F.col("used_count") + F.coalesce("_taken", F.lit(0))
    full = F.col("_taken").isNotNull() & (used >= F.col("total_uses"))
    return codes.join(taken, "code_id", "left").withColumns({
        "used_count": used, "status": F.when(full, "used").otherwise(F.col("status")),
    }).select(*codes.columns)


def code_text(seed: str, *parts: Column, length: int = schemas.CODE_LENGTH) -> Column:
    """A code drawn from the digest of the seed and parts, four hex digits per character.

    A digest instead of a random draw: a task that is run again issues the same
    codes. Whoever knows the seed can derive them, so keep it secret.
    """
    if not 1 <= length <= 16:
        raise ValueError("a digest holds up to 16 characters")
    digest = F.sha2(F.concat_ws(":", F.lit(seed), *parts), 256)
    return F.concat(*[
        F.substring(F.lit(ALPHABET),
                    F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("int") % len(ALPHABET) + 1, F.lit(1))
        for i in range(length)
    ])


def generate_codes(batches: DataFrame, existing: DataFrame, as_of: Column, seed: str,
                   limit: int = schemas.MAX_CODES_PER_BATCH) -> DataFrame:
    """New codes for batches (batch_id, n_codes, total_uses, expires_in_days).

    Nulls mean the defaults. A batch over the limit is rejected whole. A code
    that collides with another of the run or an existing one is skipped, not
    drawn again.
    """
    defaults = {"n_codes": schemas.DEFAULT_BATCH_CODES, "total_uses": schemas.DEFAULT_CODE_USES,
                "expires_in_days": schemas.DEFAULT_CODE_DAYS}
    drawn = (
        batches.na.fill(defaults).filter((F.col("n_codes") <= limit) & (F.col("n_codes") > 0))
        .select("batch_id", "total_uses", "expires_in_days",
                F.explode(F.sequence(F.lit(1), F.col("n_codes"))).alias("ordinal"))
        .withColumn("code", code_text(seed, F.col("batch_id"), F.col("ordinal")))
    )
    unique = first_rows(drawn, ["code"], ["batch_id", "ordinal"])
    return new_rows(unique, existing, "code", "batch_id", hot=None).select(
        "batch_id", "ordinal", "code", "total_uses", F.lit(0).alias("used_count"),
        F.lit("active").alias("status"), as_of.alias("created_at"),
        (as_of + F.make_dt_interval(days=F.col("expires_in_days"))).alias("expires_at"),
    )
