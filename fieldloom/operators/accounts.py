"""User accounts: registering, patching, deactivating; time zone migration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.lookup import new_rows
from fieldloom.operators.resumes import touched
from fieldloom.operators.skew import Running, Timeline, first_rows, hot_keys, shared, skew_join


@dataclass(frozen=True)
class AccountChanges:
    users: DataFrame      # the next state, or the new rows alone for registrations
    verdicts: DataFrame   # requests with their verdict


def register_users(users: DataFrame, requests: DataFrame) -> AccountChanges:
    """New active users for requests (request_id, email, password_hash, requested_at).

    Per email the earliest request wins, and only when the email is not taken.
    The request id becomes the user id.
    """
    fresh = shared(new_rows(
        first_rows(requests, ["email"], ["requested_at", "request_id"]), users, "email", "request_id", hot=None))
    created = fresh.select(
        F.col("request_id").alias("user_id"), "email", "password_hash", F.lit("active").alias("status"),
        F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))
    accepted = fresh.select("request_id", F.lit(True).alias("_accepted"))
    verdict = F.when(F.col("_accepted"), "registered").otherwise("email_exists")
    verdicts = requests.join(accepted, "request_id", "left").select(*requests.columns, verdict.alias("verdict"))
    return AccountChanges(created, verdicts)


_TIME = ["requested_at", "request_id"]


def _settled_claims(claims: DataFrame) -> DataFrame:
    """Email claims with ``ok``: whether the email is free, or the claimant's own, when the claim comes.

    A claim depends on earlier claims only: those of the same user (which tell
    the email that is given up) and those on the same email. So all claims are
    judged at once from the last round's outcomes until nothing changes; that is
    the outcome of judging them one by one, as each round settles at least all
    claims whose earlier ones are settled. Rounds number the longest chain of
    claims that hang on each other, not the claims.
    """
    guess = claims.withColumn("ok", F.coalesce(F.col("_holder") == F.col("user_id"), F.col("_holder").isNull()))
    by_user = hot_keys(claims, ["user_id"])
    # an email is given up at most once more than it is taken
    by_email = hot_keys(claims.unionAll(claims), ["email"])
    while True:
        moves = (Timeline(guess, ["user_id"], _TIME, by_user)
                 .running(Running("_before", F.max, F.when(F.col("ok"), F.struct(*_TIME, "email")), inclusive=False)).rows()
                 .withColumn("_own", F.coalesce("_before.email", "_current")).drop("_before"))
        moved = F.col("ok") & (F.col("email") != F.col("_own"))
        # a claim takes its email when granted; then the claimant's old email is free
        taken = moves.withColumn("_next", F.when(moved, F.struct(F.col("user_id").alias("holder"))))
        freed = moves.filter(moved).select(
            "request_id", "requested_at", F.col("_own").alias("email"), F.struct(F.lit(None).cast("long").alias("holder")).alias("_next"))
        seen = (Timeline(taken.unionByName(freed, allowMissingColumns=True), ["email"], _TIME, by_email)
                .running(Running("_last", F.max, F.when(F.col("_next").isNotNull(), F.struct(*_TIME, "_next")), inclusive=False))
                .rows().filter(F.col("user_id").isNotNull()))
        holder = F.when(F.col("_last").isNull(), F.col("_holder")).otherwise(F.col("_last._next.holder"))
        judged = shared(seen.withColumn("_ok", holder.isNull() | (holder == F.col("user_id"))).select(*claims.columns, "_own", "ok", "_ok"))
        if judged.filter(F.col("ok") != F.col("_ok")).isEmpty():
            return judged.drop("_ok")
        guess = judged.select(*claims.columns, F.col("_ok").alias("ok"))


def update_users(users: DataFrame, requests: DataFrame) -> AccountChanges:
    """Patch email and digest, request by request in order of time.

    A request for an email that another user holds at that time is refused
    whole (``email_conflict``); an email given up earlier is free again. Others
    are ``ok``, or ``not_found`` for an unknown user. Only a request that
    changes something leaves its time. A request for a null email asks for none.
    """
    current = users.select("user_id", F.col("email").alias("_current"), F.col("password_hash").alias("_digest"),
                           F.lit(True).alias("_known"))
    asked = shared(skew_join(requests, current, ["user_id"], "left", ["request_id"]))
    claims = asked.filter(F.col("_known") & F.col("has_email") & F.col("email").isNotNull()).select(
        "user_id", "request_id", "requested_at", "email", "_current")
    holders = users.select("email", F.col("user_id").alias("_holder"))
    settled = _settled_claims(shared(skew_join(claims, holders, ["email"], "left", ["request_id"])))
    outcome = settled.select("request_id", F.col("ok").alias("_granted"), F.col("_own").alias("_given"))
    ruled = asked.join(outcome, "request_id", "left").withColumn(
        "verdict", F.when(F.col("_known").isNull(), "not_found")
        .when(~F.coalesce("_granted", F.lit(True)), "email_conflict").otherwise("ok"))
    ruled = shared(ruled)
    step = F.struct(*_TIME)
    sets_digest = F.col("has_password") & F.col("password_hash").isNotNull()
    applied = (Timeline(ruled.filter("verdict = 'ok'"), ["user_id"], _TIME)
               .running(Running("_before", F.max, F.when(sets_digest, F.struct(*_TIME, "password_hash")), inclusive=False)).rows())
    changed = (F.coalesce(F.col("_granted") & (F.col("email") != F.col("_given")), F.lit(False))
               | (sets_digest & ~F.col("password_hash").eqNullSafe(F.coalesce("_before.password_hash", "_digest"))))
    last = applied.groupBy("user_id").agg(
        F.max_by(F.when(F.col("_granted"), F.col("email")), F.when(F.col("_granted"), step)).alias("_email"),
        F.max_by(F.when(sets_digest, F.col("password_hash")), F.when(sets_digest, step)).alias("_password"),
        F.max(F.when(changed, F.col("requested_at"))).alias("_at"))
    state = users.join(last, "user_id", "left").withColumns({
        "email": F.coalesce("_email", "email"), "password_hash": F.coalesce("_password", "password_hash"),
        **touched(users, F.col("_at")),
    }).select(*users.columns)
    return AccountChanges(state, ruled.select(*requests.columns, "verdict"))


def deactivate_users(users: DataFrame, requests: DataFrame) -> AccountChanges:
    """Requested users become inactive; an unknown user is a failure verdict.

    Only the first request of a user who is not inactive yet changes anything.
    """
    wanted = requests.groupBy("user_id").agg(F.min("requested_at").alias("_at"))
    changed = F.when(~F.col("status").eqNullSafe("inactive"), F.col("_at"))
    state = users.join(wanted, "user_id", "left").withColumn("_at", changed).withColumns({
        "status": F.when(F.col("_at").isNotNull(), "inactive").otherwise(F.col("status")),
        **touched(users, F.col("_at")),
    }).select(*users.columns)
    known = users.select("user_id", F.lit("ok").alias("verdict"))
    verdicts = skew_join(requests, known, ["user_id"], "left", ["request_id"]).withColumn(
        "verdict", F.coalesce("verdict", F.lit("not_found")))
    return AccountChanges(state, verdicts)


def migrate_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Zoned timestamps to naive ones, read in the session time zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
