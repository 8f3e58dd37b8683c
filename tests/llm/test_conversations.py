import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from fieldloom.llm import conversations as module
from fieldloom.llm.conversations import NOTHING, PAIRS, Spans, _row_cell, combine, damaged, repair, repair_digests

SCHEMA = "conv_id long, turn long, role string, text string, place string, `a.b` string"
FOLDER = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "d") for r in rows], SCHEMA)


def hurt(rows):
    """The stated damage by plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        if draw == 4:
            role = "user"
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen
                   else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repaired(rows, which):
    """Cheapest edits by a search over all prefixes: (cost, audit, repaired rows)."""
    # the roles so far only matter by their last, and whether there are any
    best = {"": (0, "", ())}

    def follows(state, letter):
        return letter == "u" and state in ("", "s", "a") or letter == "a" and state == "u" or letter == "s" and state == ""

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, kept) in list(out.items()):
                for role in ("user", "assistant"):
                    if follows(state, role[0]):
                        put(out, role[0], (cost + 5, audit + "I", (*kept, f"{role}:")))
        return out

    for (_, _, role, text), fault in zip(rows, which, strict=True):
        following, extra = {}, 5 if fault == "truncated" else 0
        for state, (cost, audit, kept) in inserted(best).items():
            put(following, state, (cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] and follows(state, role[0]):
                put(following, role[0], (cost + extra, audit + "K", (*kept, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if follows(state, other[0]):
                    put(following, other[0], (cost + 1 + extra, audit + "R", (*kept, f"{other}:{text}")))
        best = following
    return min(way for state, way in inserted(best).items() if state in ("", "a"))


def expected(original, rows):
    out = {}
    rows = [(c, t, *[" " if x is None else x for x in rest]) for c, t, *rest in rows]
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, digest(*r[2:])))
        which, turns = faults(mine), {r[1] for r in mine} - {None}
        cost, audit, kept = repaired(mine, which)
        initials = [r[2][:1] for r in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[which.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def check(spark, original, rows=None):
    rows = original if rows is None else rows
    got = repair_digests(table(spark, rows), table(spark, original))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = got.collect()
    assert {r[0]: tuple(r)[1:] for r in found} == expected(original, rows) and len(found) == len({r[0] for r in original})


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "well", " ", "", "Why? ", "so.\n", "é…", "end.)"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "S", ""]
    return [(int(c), int(t), str(rng.choice(roles)), str(rng.choice(texts)) + (str(t) + "." if rng.random() < 0.6 else ""))
            for c in range(convs) for t in range(rng.integers(0, most))]


def test_damage(spark):
    rows = [(c, t, ["user", "assistant", None][t % 3], ["Hi. There!", None, "no?"][c % 3]) for c in range(40) for t in range(8)]
    rows += [(None, 1, "user", "a."), (3, None, "user", "b."), (None, None, None, None)]
    got = damaged(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(hurt(rows), key=str)


def test_conversations(spark):
    raw = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in raw.collect()]
    got = repair_digests(damaged(raw), raw).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows, hurt(rows))


def test_random_conversations(spark):
    check(spark, random_rows(np.random.default_rng(12), 150, 9))


def test_special_cases(spark):
    rows = [(1, None, "user", "a."), (1, None, "assistant", "b."), (1, 5, "user", "c"), (1, 5, "user", "c"), (1, 9, None, None),
            (2, None, None, None), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (3, 1, "system", "only."),
            (4, 1, "system", "s."), (4, 2, "user", "u."), (4, 3, "assistant", "a."), (4, 4, "system", "again."),
            (5, 1, "user", "long " * 60_000 + "."), (5, 2, "assistant", " "), (6, 7, "user", "\x0b\x0c"), (6, 7, "user", ".")]
    check(spark, [*rows, (7, 1, "user", "gone")], rows)
    assert repair_digests(table(spark, []), table(spark, [])).count() == 0
    assert repair(table(spark, [])).rows.count() == 0


def test_repeated_rows_and_a_long_conversation(spark):
    """One conversation holds most rows, and one of its rows is repeated by the hundred; both lie in many ranges."""
    rng = np.random.default_rng(3)
    rows = [(9, int(t), ["user", "assistant"][int(rng.integers(2))], f"text {t % 90}" + ". "[int(rng.integers(2))]) for t in range(400)]
    rows += [(9, 50, "user", "same.")] * 300 + [(c, t, "user", "a.") for c in range(5) for t in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_of_the_repair(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "cut off"), (1, 4, "assistant", "Bye.")]
    fixed = repair(table(spark, rows))
    assert fixed.verdicts.select("cost", "audit").collect()[0] == (4, "DKDK")
    assert [tuple(r) for r in fixed.rows.orderBy("place").select("place", "role", "text", "edit").collect()] == [
        (0, "user", "Hi.", "K"), (1, "assistant", "Bye.", "K")]


def all_cuts(cells):
    """A plain CYK table: every span from the best of all its cuts."""
    n, chart = len(cells), {}
    for i, cell in enumerate(cells):
        chart[i, i + 1] = list(cell)
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            options = [combine(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
            chart[i, i + size] = [min((o[x] for o in options if o[x] is not None), default=None) for x in range(len(PAIRS))]
    return chart[0, n]


@pytest.mark.parametrize("seed", range(5))
def test_one_cut_gives_what_all_cuts_give(seed):
    rng = np.random.default_rng(seed)
    cells = [_row_cell(str(rng.choice(["s", "u", "a", ""])), bool(rng.integers(2)), bool(rng.integers(5) == 0)) for _ in range(14)]
    spans = Spans()
    for cell in cells:
        spans.add(list(cell))
    assert spans.whole() == all_cuts(cells)


def test_cells_are_closed_under_insertion():
    for initial, cut, forced in product("sua", (False, True), (False, True)):
        cell = list(_row_cell(initial, cut, forced))
        assert combine(NOTHING, cell) == cell == combine(cell, NOTHING)
    many = Spans()
    many.add_deleted(13)
    one = Spans()
    for _ in range(13):
        one.add(list(module._row_cell("", False, True)))
    assert many.whole() == one.whole()
