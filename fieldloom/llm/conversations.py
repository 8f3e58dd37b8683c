"""Conversation repair: the cheapest edits that make the roles of a conversation legal.

A weighted CYK parse over the rows of a conversation in order of turn. Roles
must spell ``(s?(ua)+)?`` by their initials. The repair grammar in Chomsky
normal form has a nonterminal <p,q> for each pair of states of that language
(0 nothing yet, 1 after system, 2 after user, 3 after assistant):

    <p,q> -> <p,r> <r,q>        for every state r between
    <p,q> -> a row              kept (0), with another role (1) or, if p = q, deleted (2)
    <p,q> -> nothing            by inserted rows (5 each)

Every cell holds per nonterminal the least (cost, audit), audit being the
initials of the edits. Cells are closed under insertion on both sides. The
nonterminals are closed under concatenation, so a span gives the same cell
wherever it is cut: one cut per span is enough, spans grow 1, 2, 4, ... rows
bottom-up, and n rows take n - 1 combinations. Equal costs mean that no audit is
the beginning of another (they differ in inserted rows, which cost), so the
least of a span stays the least in every longer span.

A long conversation is no single piece of work. Rows are range-partitioned by
(conversation, turn); a partition parses its stretch of every conversation into
one cell, and a conversation's cells are then combined in order. What one task
holds of one conversation is its audit, some ten bytes a row. Texts are not part
of the parse: they meet the edits by a key.

Equal rows (turn, role and text) are one row with a count. Results in special
cases: a null role or text is one space; null turns come first; rows of one turn
are taken in order of a digest of role and text; a null conversation id is a
conversation of its own; a role without first letter, or with another than s, u
and a, can only be changed or deleted; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldloom.llm.common import partitions, prepare, stored

# fixed values: the costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_BLANKS = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
ROLES = ("user", "assistant")

# the nonterminals <p,q>, and the pairs that make up each
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
INDEX = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [[(INDEX[p, r], INDEX[r, q]) for r in range(4) if (p, r) in INDEX and (r, q) in INDEX] for p, q in PAIRS]
ACCEPTED = (0, 3)
Cell = list     # (cost, audit) per nonterminal, None where there is none


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for rule in RULES:
        best = None
        for i, j in rule:
            a, b = left[i], right[j]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if best is None or cost < best[0]:
                best = (cost, a[1] + b[1])
            elif cost == best[0]:
                best = min(best, (cost, a[1] + b[1]))
        out.append(best)
    return out


def _cell(entries: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return [entries.get(pair) for pair in PAIRS]


# what inserted rows alone can do
NOTHING = _cell({**{(p, p): (0, "") for p in range(4)}, **{(p, 2): (INSERT, "I") for p in (0, 1, 3)},
                 (2, 3): (INSERT, "I"), **{(p, 3): (2 * INSERT, "II") for p in (0, 1)}})


@lru_cache(maxsize=64)
def _row_cell(initial: str, truncated: bool, forced: bool) -> tuple:
    """The closed cell of one row."""
    extra = TRUNCATED if truncated else 0
    entries = {(p, p): (DELETE, "D") for p in range(4)}
    if not forced:
        for p, q, letter in ((0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
            entries[p, q] = (extra, "K") if initial == letter else (REROLE + extra, "R")
        if initial == "s":
            entries[0, 1] = (extra, "K")
    return tuple(combine(combine(NOTHING, _cell(entries)), NOTHING))


class Spans:
    """Cells of a growing stretch of rows, neighbours of equal length combined as they arise."""

    def __init__(self):
        self.stack: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, size: int = 1) -> None:
        self.stack.append((size, cell))
        while len(self.stack) > 1 and self.stack[-1][0] >= self.stack[-2][0]:
            (n, right), (m, left) = self.stack.pop(), self.stack.pop()
            self.stack.append((m + n, combine(left, right)))

    def add_deleted(self, count: int) -> None:
        """So many rows that must go, by doubling."""
        one, size = list(_row_cell("", False, True)), 1
        while count:
            if count & 1:
                self.add(one, size)
            count >>= 1
            if count:
                one, size = combine(one, one), 2 * size

    def whole(self) -> Cell:
        cell = NOTHING
        for _, left in reversed(self.stack):
            cell = combine(left, cell)
        return cell


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_ROW = ("conv", "turn", "said", "kind", "copies", "initial", "blank", "truncated", "key")


def _segments(conv_type: pa.DataType, names: list[str]):
    """One record per stretch of a conversation: its cell, counts, ends, and the rows an edit may keep."""
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, now, marker = [], 0, None, None
        at = TaskContext.get().partitionId() << 33      # ranges are numbered in order
        for batch in batches:
            for conv, turn, said, kind, copies, initial, blank, truncated, key in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        done.append(_closed(now))
                        held += now["rows"]
                    at += 1
                    now = {"conv": conv, "first_at": at, "rows": 0, "spans": Spans(), "keys": [], "pattern": [],
                           "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "distinct": 0,
                           "first_turn": None, "last_turn": None, "first_initial": None, "last_initial": None}
                    if held > 100_000:
                        yield _records(done, conv_type, names)
                        done, held = [], 0
                if kind == 0:       # where a role and text first occur
                    marker = (conv, turn, said)
                    continue
                first = marker == (conv, turn, said)
                _take(now, turn, copies, initial, blank, truncated, first, key)
        if now is not None:
            done.append(_closed(now))
        yield _records(done, conv_type, names)
    return parsed


def _take(now: dict, turn, copies: int, initial: str, blank: bool, truncated: bool, first: bool, key: bytes) -> None:
    if now["last_initial"] is not None:
        now["illegal"] += now["last_initial"] + initial not in _LEGAL
    else:
        now["first_initial"] = initial
    now["illegal"] += copies - 1
    now["last_initial"] = initial
    if turn is not None:
        now["distinct"] += turn != now["last_turn"]
        now["last_turn"] = turn
        if now["first_turn"] is None:
            now["first_turn"] = turn
    now["rows"] += copies
    free = 0 if blank or not first else 1
    if free:
        now["truncated"] += truncated
        now["spans"].add(list(_row_cell(initial if initial in "sua" else "", truncated, False)))
        now["keys"].append(key)
        now["pattern"].append("s" if initial == "s" else "r")
    now["blank" if blank else "duplicate"] += copies - free
    if copies > free:
        now["spans"].add_deleted(copies - free)
        now["pattern"].append("f" * (copies - free))


def _closed(now: dict) -> dict:
    cell = now.pop("spans").whole()
    now["costs"] = [None if x is None else x[0] for x in cell]
    now["audits"] = [None if x is None else x[1] for x in cell]
    now["pattern"] = "".join(now["pattern"])
    return now


def _records(done: list[dict], conv_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = {"conv": conv_type, "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "keys": pa.list_(pa.binary()),
             "pattern": pa.string(), "first_initial": pa.string(), "last_initial": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array([d[n] for d in done], types.get(n, pa.int64())) for n in names], names)


_SEGMENT = ("conv", "first_at", "rows", *_COUNTS, "distinct", "first_turn", "last_turn", "first_initial", "last_initial",
            "costs", "audits")
_RESULT = ("conv", "gaps", *_COUNTS, "cost", "audit", "first_at", "state", "place")


def _verdicts(conv_type: pa.DataType):
    """Segments in order to one verdict per conversation, and the edits of each segment (those with first_at)."""
    types = {"conv": conv_type, "audit": pa.string()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], types.get(n, pa.int64())) for n in _RESULT], list(_RESULT))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, segments = [], []
        for b in batches:
            for row in b.to_pylist():
                if segments and segments[0]["conv"] != row["conv"]:
                    done += _verdict(segments)
                    segments = []
                    if len(done) > 5000:
                        yield batch(done)
                        done = []
                segments.append(row)
        yield batch(done + (_verdict(segments) if segments else []))
    return judged


def _verdict(segments: list[dict]) -> list[dict]:
    """Best way through a conversation's segments, and back along it for the edits of each."""
    reached = {0: (0, "")}
    back = []
    for s in segments:
        following, came = {}, {}
        for (p, q), cost, audit in zip(PAIRS, s["costs"], s["audits"], strict=True):
            if p in reached and cost is not None:
                way = (reached[p][0] + cost, reached[p][1] + audit)
                if q not in following or way < following[q]:
                    following[q], came[q] = way, (p, audit)
        reached = following
        back.append(came)
    cost, audit, state = min((*reached[q], q) for q in ACCEPTED if q in reached)
    out, place = [], 0
    steps = []
    for came in reversed(back):
        state, part = came[state]
        steps.append((state, part))
    for s, (start, part) in zip(segments, reversed(steps), strict=True):
        out.append({"conv": s["conv"], "first_at": s["first_at"], "audit": part, "state": start, "place": place})
        place += len(part) - part.count("D")
    total = {c: sum(s[c] for s in segments) for c in (*_COUNTS, "distinct")}
    last_initial = last_turn = first_turn = None
    for s in segments:
        if last_initial is not None and s["first_initial"] is not None:
            total["illegal"] += last_initial + s["first_initial"] not in _LEGAL
        if last_turn is not None and s["first_turn"] == last_turn:
            total["distinct"] -= 1
        first_turn = s["first_turn"] if first_turn is None else first_turn
        last_turn = last_turn if s["last_turn"] is None else s["last_turn"]
        last_initial = last_initial if s["last_initial"] is None else s["last_initial"]
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - total["distinct"]
    return [*out, {"conv": segments[0]["conv"], "gaps": gaps, "cost": cost, "audit": audit, **{c: total[c] for c in _COUNTS}}]


_EDIT = ("conv", "place", "edit", "new_role", "key")


def _edits(conv_type: pa.DataType):
    """The rows that remain: each kept or changed row by its place in the order, each inserted one."""
    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                state, place, keys, pattern = r["state"], r["place"], iter(r["keys"]), iter(r["pattern"])
                for edit in r["audit"]:
                    row = "" if edit == "I" else next(pattern)
                    key = next(keys) if row in ("r", "s") else None
                    if edit == "D":
                        continue
                    state = 1 if edit == "K" and row == "s" else 3 if state == 2 else 2
                    out.append((r["conv"], place, edit, None if edit == "K" else ROLES[state - 2], key))
                    place += 1
            columns = list(zip(*out, strict=True)) if out else [()] * len(_EDIT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (conv_type, pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)],
                list(_EDIT))
    return expanded


@dataclass(frozen=True)
class Repair:
    verdicts: DataFrame     # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    rows: DataFrame         # conv_id, place, role, text, edit (K, R or I): the repaired conversations


def _hex_key(*parts: Column) -> Column:
    """A digest of values that may be null, each told from all others."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("!")) for p in parts]
    return F.unhex(F.md5(F.concat_ws("\x00", *marked)))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """Verdicts and repaired rows of every conversation that has rows."""
    spark = prepare(conversations.sparkSession)
    conv_field = conversations.schema[conv_col].dataType
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    stripped = F.rtrim(text, F.lit(_BLANKS))
    plain = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("said"),
        F.substring(role, 1, 1).alias("initial"), (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    plain = plain.withColumn("key", _hex_key(F.col("conv"), F.col("turn"), F.hex("said")))
    unique = ["conv", "turn", "said", "key", "initial", "blank", "truncated"]
    # everything but the texts; equal rows are one row with a count
    small = stored(plain.groupBy(*unique).agg(F.count(F.lit(1)).alias("copies")).withColumn("kind", F.lit(1)), "conversation-rows")
    firsts = (small.groupBy("conv", "said").agg(F.min(F.struct("turn")).alias("_first"))
              .select("conv", F.col("_first.turn").alias("turn"), "said", F.lit(0).alias("kind")))
    order = ["conv", F.asc_nulls_first("turn"), "said"]
    ranged = (small.unionByName(firsts, allowMissingColumns=True).repartitionByRange(partitions(spark), *order)
              .sortWithinPartitions(*order, "kind"))

    def schema(names: tuple[str, ...]) -> T.StructType:
        kinds = {"conv": conv_field, "costs": T.ArrayType(T.LongType()), "audits": T.ArrayType(T.StringType()),
                 "keys": T.ArrayType(T.BinaryType()), "key": T.BinaryType(), **dict.fromkeys(
                     ("pattern", "first_initial", "last_initial", "audit", "edit", "new_role"), T.StringType())}
        return T.StructType([T.StructField(n, kinds.get(n, T.LongType())) for n in names])

    conv_type = to_arrow_type(conv_field)
    names = (*_SEGMENT, "pattern", "keys")
    segments = stored(ranged.select(*_ROW).mapInArrow(
        _segments(conv_type, list(names)), schema(names)), "conversation-segments")
    judged = stored(segments.select(*_SEGMENT).repartition("conv").sortWithinPartitions("conv", "first_at").mapInArrow(
        _verdicts(conv_type), schema(_RESULT)), "conversation-verdicts")
    verdicts = judged.filter("first_at is null").select(
        F.col("conv").alias("conv_id"), "gaps", *_COUNTS, "cost", "audit")

    slices = (judged.filter("first_at is not null").select("conv", "first_at", "state", "place", "audit")
              .join(segments.select("first_at", "pattern", "keys"), "first_at"))
    edits = stored(slices.mapInArrow(_edits(conv_type), schema(_EDIT)), "conversation-edits")
    # equal rows have equal texts, and one of them is enough
    texts = plain.select("key", "role", "text").dropDuplicates(["key"])
    found = edits.filter("key is not null").join(texts, "key").select("conv", "place", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    added = edits.filter("key is null").select("conv", "place", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return Repair(verdicts, found.unionByName(added).withColumnRenamed("conv", "conv_id"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Known faults for trials, chosen by crc32 of ``conv_id:turn``: rows dropped, emptied, cut, repeated, with another role."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    draw = F.crc32(F.encode(F.concat(conv, F.lit(":"), turn), "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), draw.alias("_draw"))
            .filter("_draw > 0").select(
                "conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                F.explode(F.sequence(F.lit(1), F.when(F.col("_draw") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))


def _hashed(conv_type: pa.DataType, names: list[str]):
    """Each verdict row (place -1) with the hash of the repaired rows that follow it; texts stream through."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current, digest = [], None, None

        def close():
            done.append((*current, digest.hexdigest()))

        for b in batches:
            *values, place, line = b.columns
            for value, at, text in zip(zip(*[c.to_pylist() for c in values], strict=True), place.to_pylist(),
                                       line.cast(pa.binary()).to_pylist(), strict=True):
                if at < 0:
                    if current is not None:
                        close()
                    current, digest, begun = value, hashlib.sha256(), False
                else:
                    digest.update(b"\n" + text if begun else text)
                    begun = True
        if current is not None:
            close()
        types = [conv_type, *[pa.int64()] * (len(names) - 3), pa.string(), pa.string()]
        columns = list(zip(*done, strict=True)) if done else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    return hashed


def repair_digests(conversations: DataFrame, every: DataFrame) -> DataFrame:
    """One row per conv_id of ``every``: the verdict and the hash of the repaired rows.

    A hash of one text is made in one task, so a conversation's remaining rows
    stream through one; no more than a batch of them is held.
    """
    fixed = repair(conversations)
    numbers = ["gaps", *_COUNTS, "cost"]
    known = fixed.verdicts.select(F.col("conv_id").alias("_known"), *numbers, "audit")
    ids = every.select("conv_id").distinct()
    heads = ids.join(known, F.col("conv_id").eqNullSafe(F.col("_known")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.lit(-1).cast("long").alias("place"), F.lit("").alias("line"))
    lines = fixed.rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    field = every.schema["conv_id"].dataType
    names = ["conv_id", *numbers, "audit", "repaired_sha256"]
    out = T.StructType([T.StructField("conv_id", field), *[T.StructField(n, T.LongType()) for n in numbers],
                        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return (heads.unionByName(lines, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "place")
            .mapInArrow(_hashed(to_arrow_type(field), names), out))
