"""Registration, patches and declared limits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import accounts, integrity, lookup

AT = [dt.datetime(2024, 1, d) for d in range(1, 9)]
USERS = "user_id long, email string, password_hash string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(i, f"u{i}@x", f"p{i}", "active", AT[0], AT[0]) for i in range(4)], USERS)


def check_registration(spark, users):
    rows = [(10, "new@x", "a", AT[2]), (11, "new@x", "b", AT[1]), (12, "u1@x", "c", AT[1]), (13, "U1@x", "d", AT[1])]
    rows += [(100 + i, "hot@x", "h", AT[3]) for i in range(40)]
    result = accounts.register_users(users, spark.createDataFrame(
        rows, "request_id long, email string, password_hash string, requested_at timestamp_ntz"))
    verdicts = {r.request_id: r.verdict for r in result.verdicts.collect()}
    assert {i for i, v in verdicts.items() if v == "registered"} == {11, 13, 100}
    assert len(verdicts) == 44
    assert {r.user_id: r.password_hash for r in result.users.collect()} == {11: "b", 13: "d", 100: "h"}


def test_registration(spark, users):
    check_registration(spark, users)


def test_registration_of_a_hot_email(spark, users, tiny_limits):
    check_registration(spark, users)


PATCHES = ("request_id long, user_id long, has_email boolean, email string, has_password boolean, "
           "password_hash string, requested_at timestamp_ntz")


def one_by_one(users, patches):
    """The requests in order of time, each judged on what the ones before have left."""
    state = {u[0]: [u[1], u[2], u[5]] for u in users}
    verdicts = {}
    for rid, user, has_email, email, has_password, digest, at in sorted(patches, key=lambda p: (p[6], p[0])):
        if user not in state:
            verdicts[rid] = "not_found"
            continue
        mine, claims = state[user], has_email and email is not None
        if claims and any(row[0] == email for other, row in state.items() if other != user):
            verdicts[rid] = "email_conflict"
            continue
        verdicts[rid] = "ok"
        fresh = [email if claims else mine[0], digest if has_password and digest is not None else mine[1]]
        if fresh != mine[:2]:
            state[user] = [*fresh, at]
    return verdicts, {u: tuple(row) for u, row in state.items()}


def check_patches(spark, users, patches):
    result = accounts.update_users(users, spark.createDataFrame(patches, PATCHES))
    verdicts, state = one_by_one([tuple(u) for u in users.collect()], patches)
    assert {r.request_id: r.verdict for r in result.verdicts.collect()} == verdicts
    assert {r.user_id: (r.email, r.password_hash, r.updated_at) for r in result.users.collect()} == state
    return verdicts


def test_patches(spark, users):
    verdicts = check_patches(spark, users, [
        (1, 0, True, "a@x", False, None, AT[1]), (2, 0, False, None, True, "q", AT[2]), (3, 0, True, "b@x", False, None, AT[3]),
        (4, 1, True, "u2@x", True, "r", AT[1]),       # taken: the digest does not change either
        (5, 2, True, "b@x", False, None, AT[4]),      # user 0 has it
        (6, 3, True, "u3@x", False, None, AT[1]),     # own email: nothing changes, no stamp
        (7, 9, True, "z@x", False, None, AT[1]),
        (8, 1, True, "u0@x", False, None, AT[5]),     # given up by user 0
        (9, 2, True, "a@x", True, "p2", AT[5]), (10, 3, False, None, False, None, AT[6]), (11, 3, True, None, True, None, AT[6])])
    assert verdicts[4] == verdicts[5] == "email_conflict" and verdicts[8] == verdicts[9] == "ok"


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_claims(spark, users, seed):
    """Few emails, many claims: each outcome hangs on others long before."""
    rng = random.Random(seed)
    check_patches(spark, users, [
        (i, rng.randrange(5), rng.random() < 0.8, f"u{rng.randrange(6)}@x", rng.random() < 0.4, rng.choice(["p1", "n", None]),
         AT[rng.randrange(8)]) for i in range(26)])


def test_chains_of_claims_of_a_hot_user(spark, users, tiny_limits):
    rng = random.Random(9)
    check_patches(spark, users, [
        (i, 0 if i % 3 else rng.randrange(4), True, f"u{rng.randrange(5)}@x", i % 2 == 0, f"d{i % 4}", AT[i % 8]) for i in range(18)])


def test_lookup_of_a_repeated_key(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "request_id long, code string")
    state = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "code string, code_id long")
    got = {r.request_id: (r.n_found, r.code_id) for r in
           lookup.lookup_one_or_none(requests, state, ["code"]).collect()}
    assert got == {1: (1, 1), 2: (2, None), 3: (0, None)}
    with pytest.raises(Exception, match="more than one row"):
        lookup.lookup_one_or_none(requests, state, ["code"], strict=True).collect()


def test_limits(spark, users):
    long = users.withColumn("email", F.when(F.col("user_id") == 1, F.repeat(F.lit("é"), 256)).otherwise(F.col("email")))
    odd = long.withColumn("status", F.when(F.col("user_id") < 2, "gone").otherwise(F.lit("BANNED")))
    got = {(r.column_name, r.rule): r.violations for r in integrity.check_lengths({"users": odd}).collect()}
    assert got[("email", "max_length_255")] == 1 and got[("status", "in_domain")] == 2
    assert got[("email", "not_null")] == 0
