"""The gate in front of changes, against one request at a time."""

import random
from datetime import datetime, timedelta

import pytest
import simulation

from fieldloom.operators import codes, gate

START = datetime(2024, 1, 1)


def at(step):
    return START + timedelta(minutes=step)


@pytest.fixture
def frames(spark):
    def make(users, deactivations, requests):
        return (spark.createDataFrame(requests, "request_id long, user_id long, code string, requested_at timestamp_ntz"),
                spark.createDataFrame(users, "user_id long, status string"),
                spark.createDataFrame(deactivations, "request_id long, user_id long, requested_at timestamp_ntz"))
    return make


def gates(df):
    return {r["request_id"]: r["gate"] for r in df.collect()}


def test_gate_follows_the_time_of_requests(frames):
    requests, users, off = frames(
        [(1, "active"), (2, "banned"), (3, "active"), (4, "inactive")], [(90, 1, at(5)), (91, 1, at(3)), (92, 8, at(1)), (93, None, at(1))],
        [(1, 1, "c", at(2)), (2, 1, "c", at(3)), (3, 1, "c", at(9)), (4, 2, "c", at(1)), (5, 3, "c", at(9)),
         (6, 8, "c", at(9)), (7, None, "c", at(9)), (8, 1, "c", None), (9, 4, "c", at(0))])
    assert gates(gate.gate_as_of(requests, users, off)) == {
        1: "pass", 2: "deactivated", 3: "deactivated", 4: "deactivated", 5: "pass",
        6: "invalid_credentials", 7: "invalid_credentials", 8: "pass", 9: "deactivated"}
    split = gate.behind_gate(requests, users, off)
    assert {r["request_id"] for r in split.passed.collect()} == {1, 5, 8}
    assert split.passed.columns == requests.columns


def test_empty_tables(frames):
    requests, users, off = frames([], [], [(1, 1, "c", at(2))])
    assert gates(gate.gate_as_of(requests, users, off)) == {1: "invalid_credentials"}
    assert gate.gate_as_of(requests.limit(0), users, off).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_redeeming_behind_the_gate(spark, frames, seed):
    rng = random.Random(seed)
    users = [(u, "inactive" if u % 7 == 0 else "active") for u in range(12)]
    offs = [(1000 + i, rng.randrange(14), at(rng.randrange(60))) for i in range(6)]
    # user 3 sends a third of all requests
    asked = [(i, 3 if i % 3 == 0 else rng.randrange(14), f"C{rng.randrange(6)}", at(rng.randrange(60))) for i in range(120)]
    known = {f"C{c}": [c, 3, 0, "active", None] for c in range(5)}
    requests, users_df, off = frames(users, offs, asked)
    codes_df = spark.createDataFrame(
        [(row[0], code, row[1], row[2], row[3], None) for code, row in known.items()],
        "code_id long, code string, total_uses int, used_count int, status string, expires_at timestamp_ntz")
    grants = spark.createDataFrame([], "activation_id long, user_id long, code_id long")
    status, first = dict(users), {}
    for _, user, time in offs:
        first[user] = min(time, first.get(user, time))
    refused = {i: "invalid_credentials" if u not in status else "deactivated" for i, u, _, t in asked
               if status.get(u) != "active" or (u in first and first[u] <= t)}
    expected, _ = simulation.redeem([r for r in asked if r[0] not in refused], known, set())
    split = gate.behind_gate(requests, users_df, off)
    verdicts = split.verdicts(codes.redeem_codes(split.passed, codes_df, grants).verdicts)
    assert {r["request_id"]: r["verdict"] for r in verdicts.collect()} == {**expected, **refused}
    assert len(refused) > 10 and "ok" in expected.values()
