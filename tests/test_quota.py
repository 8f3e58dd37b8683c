"""The window forms of quotas and redemption against one-at-a-time simulations."""

import datetime as dt
import random

import pytest

import simulation
from fieldloom.operators import codes, quota

T0 = dt.datetime(2024, 1, 1)


def moment(i):
    return T0 + dt.timedelta(hours=i)


def timelines(seed, n_users=12, n=300):
    rng = random.Random(seed)
    def user():
        return 0 if rng.random() < 0.4 else rng.randrange(n_users)
    grants = [(i, user(), rng.randrange(0, 5), moment(rng.randrange(40))) for i in range(n // 3)]
    uses = [(i, user(), moment(rng.randrange(40))) for i in range(n)]
    return grants, uses


def frames(spark, grants, uses):
    return (
        spark.createDataFrame([(i, u, 1, g, at) for i, u, g, at in grants],
                              "activation_id long, user_id long, code_id long, remaining_uses int, activated_at timestamp_ntz"),
        spark.createDataFrame(uses, "use_id long, user_id long, used_at timestamp_ntz"))


def check_quota(spark, seed):
    grants, uses = timelines(seed)
    g, u = frames(spark, grants, uses)
    expected, left = simulation.quota(grants, uses)
    ledger = {r.use_id: (r.ok, r.balance) for r in quota.quota_ledger(g, u).collect()}
    assert ledger == {i: v[:2] for i, v in expected.items()}
    attribution = quota.quota_attribution(g, u)
    assert {r.use_id: r.activation_id for r in attribution.uses.collect()} == {
        i: v[2] for i, v in expected.items() if v[0]}
    assert {r.activation_id: r.remaining_uses for r in attribution.grants.collect()} == left


@pytest.mark.parametrize("seed", range(4))
def test_quota(spark, seed):
    check_quota(spark, seed)


def test_quota_with_hot_users(spark, tiny_limits):
    check_quota(spark, 11)


def test_first_available_grant(spark):
    g, _ = frames(spark, [(1, 7, 0, moment(0)), (2, 7, 3, moment(2)), (3, 7, 1, moment(1)), (4, 8, 0, moment(0)),
                          (5, 9, 2, moment(0))], [(1, 7, moment(0))])
    got = {r.user_id: (r.activation_id, r.ambiguous) for r in quota.first_available_grant(g).collect()}
    assert got == {7: (3, True), 9: (5, False)}


def redemption(seed):
    rng = random.Random(seed)
    table = {}
    for i in range(14):
        status = "active" if rng.random() < 0.85 else rng.choice(["used", "expired"])
        expires = None if rng.random() < 0.5 else moment(rng.randrange(60))
        table[f"C{i}"] = [i, rng.randrange(0, 9), rng.randrange(0, 4), status, expires]
    table["C0"] = [0, 40, 1, "active", None]
    requests = [(i, rng.randrange(60), "C0" if rng.random() < 0.4 else f"C{rng.randrange(17)}",
                 moment(rng.randrange(50))) for i in range(400)]
    grants = {(rng.randrange(60), rng.randrange(14)) for _ in range(40)}
    return requests, table, grants


def redemption_frames(spark, requests, table, grants):
    return (
        spark.createDataFrame(requests, "request_id long, user_id long, code string, requested_at timestamp_ntz"),
        spark.createDataFrame([(r[0], c, *r[1:]) for c, r in table.items()],
                              "code_id long, code string, total_uses int, used_count int, status string, expires_at timestamp_ntz"),
        spark.createDataFrame(sorted(grants), "user_id long, code_id long"))


def check_redeem(spark, seed):
    requests, table, grants = redemption(seed)
    result = codes.redeem_codes(*redemption_frames(spark, requests, table, grants))
    verdicts, state = simulation.redeem(requests, table, grants)
    assert {r.request_id: r.verdict for r in result.verdicts.collect()} == verdicts
    assert {r.code_id: (r.used_count, r.status) for r in result.codes.collect()} == state
    assert {r.activation_id for r in result.grants.collect()} == {i for i, v in verdicts.items() if v == "ok"}
    assert {r.remaining_uses for r in result.grants.collect()} <= {5}


@pytest.mark.parametrize("seed", range(4))
def test_redeem(spark, seed):
    check_redeem(spark, seed)


def test_redeem_with_hot_codes(spark, tiny_limits):
    check_redeem(spark, 21)


def test_generated_codes(spark):
    batches = spark.createDataFrame([(1, 3, 5, 30), (2, 101, 5, 30), (3, 0, 5, 30), (4, 100, 5, 30)],
                                    "batch_id long, n_codes int, total_uses int, expires_in_days int")
    from pyspark.sql import functions as F
    as_of = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    none = spark.createDataFrame([], "code string")
    first = codes.generate_codes(batches, none, as_of, "s").collect()
    assert {b: sum(r.batch_id == b for r in first) for b in (1, 2, 3, 4)} == {1: 3, 2: 0, 3: 0, 4: 100}
    assert len({r.code for r in first}) == 103
    assert all(len(r.code) == 16 and set(r.code) <= set(codes.ALPHABET) for r in first)
    assert first[0].expires_at == dt.datetime(2024, 1, 31)
    # a collision with an existing code is skipped, not drawn again
    taken = spark.createDataFrame([(first[0].code,)], "code string")
    assert len(codes.generate_codes(batches, taken, as_of, "s").collect()) == 102
    assert {r.code for r in codes.generate_codes(batches, none, as_of, "t").collect()}.isdisjoint({r.code for r in first})
