"""Phrase collocation mining by SON partitioning.

A shard is a stretch of texts that a task holds at once (about SHARD bytes).
Three passes over the texts, none of which keeps a corpus-wide table in a task:

1. Words: counts per shard, summed, give the number of words of every group
   (language) and the words frequent enough to be in a phrase.
2. SON: every shard is mined completely, level by level, at a support lowered
   in proportion to its share of the group's words. A phrase that is frequent
   in all is frequent in one shard at least, so the union of the locally
   frequent phrases holds all that are sought. It also tells more: where a
   phrase is not locally frequent it occurs at most t - 1 times, t being the
   shard's support, so a phrase with f occurrences in all exceeds t - 1 by at
   least f less the sum of all t - 1, added up over the shards where it is
   locally frequent. Phrases of the union below that are out.
3. Counts: every shard counts the rest of the union, and the sums are exact.

Only the ``top`` phrases of a group are asked for, so pass 3 counts those only
that can decide them. A phrase scores at most 1000 * n / f of its first word,
and of its last (it is no more frequent than what is left without that word). So
if ``top`` phrases score above 1000 * n / (x + 1), all of the top begin and end
in words with f <= x. Their cuts begin or end in such a word, and so does each
phrase of one more word that may hold all their occurrences: pass 3 hands on the
counts of phrases that begin or end in a word with f <= x. The first x comes from
the words' counts (START). In groups where it then proves too small pass 3 runs
again with a larger one, at last with none. What a shard hands on is bounded by
``top``, however many frequent phrases the corpus has.

The union is handed to pass 3 as a table of sums by hashed slot, of fixed size
(2^BITS bytes, no sum above 255; the support less what is uncounted must stay
below that). Two phrases may share a slot: then one is counted in vain, never is
one missed, and the sums of pass 3 decide. Counting inside a shard uses numbers
given to the words, and phrases are summed by their text, so no count depends
on a hash.

Then every phrase is cut in all places, scored by its lowest-scoring cut in
exact decimal arithmetic, and dropped if a longer candidate holds all its
occurrences.

Results in special cases: a null text or one without words has none; a null
group is ``und`` (and one with the group of that name); phrases never cross a
piece's or a text's end; overlapping occurrences count each; repeated rows
count each; ties in score go to the larger count, then to the phrase's bytes;
an empty table gives an empty result; other columns are not read. A text longer
than a shard is cut where pieces end, so only a single piece must fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.arrays import LOWER, encoded, mix, piece_hashes
from fieldloom.llm.common import prepare, stored

SHARD = 32 << 20        # bytes of text mined at once
BITS = 24               # 2^24 sums of one byte are 16 MB
LONGEST = 5
SUPPORT = 100
TOP = 2000
START, WIDER = 40, 4    # occurrences of the first and last words counted first, in ``top`` times the support; the second time
THRESHOLDS = 4096       # groups whose lowered support is sent to the tasks; the others are mined at 1
_BLOCK_BITS = 14
_ROWS = 1 << 15
_EXACT = "decimal(38,0)"

_PIECE = np.zeros(256, bool)
_PIECE[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True


@dataclass
class Shard:
    """The words of a stretch of texts: numbers of (group, word), and whether the next word is in the same piece."""

    groups: list[str]
    group: np.ndarray       # of each number
    word: np.ndarray        # of each number, into words
    words: pa.Array
    ids: np.ndarray         # the number of each word in order
    times: np.ndarray       # occurrences of each number
    linked: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits of each number's group and word."""
        _, offsets, data = self.words.buffers()
        ends = np.frombuffer(offsets, np.int64)[:len(self.words) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        own = piece_hashes(raw, ends[:-1], ends[1:])
        return mix(own[self.word] + _group_hashes(self.groups)[self.group])


def _group_hashes(groups: list[str]) -> np.ndarray:
    raw = [g.encode() for g in groups]
    ends = np.cumsum([len(g) for g in raw], dtype=np.int64)
    return piece_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(g) for g in raw], np.int64), ends)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Groups, bytes and ends of texts in stretches of about ``limit`` bytes; longer texts are cut where pieces end."""
    groups, parts, size = [], [], 0

    def chunk():
        """What is held, and hold it no longer."""
        nonlocal groups, parts, size
        out = groups, np.concatenate(parts), np.cumsum([len(p) for p in parts])
        groups, parts, size = [], [], 0
        return out

    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer()
            if raw is None:
                continue
            data, at = np.frombuffer(raw, np.uint8), 0
            while at < len(data):
                end = len(data)
                if end - at > limit:
                    ends = np.flatnonzero(_mapped(_PIECE, data[at:]))
                    far = int(np.searchsorted(ends, limit))
                    if len(ends):
                        end = at + int(ends[far - 1 if far else 0]) + 1
                if size and size + end - at > limit:
                    yield chunk()
                groups.append(group)
                parts.append(data[at:end])
                size, at = size + end - at, end
    if size:
        yield chunk()


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Shard]:
    yield from (_shard(*held) for held in _chunks(batches, limit))


def _mapped(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table[data] for bytes, without an index array of eight times their size."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def _shard(of_text: list[str], data: np.ndarray, text_ends: np.ndarray) -> Shard:
    data = _mapped(LOWER, data)
    small = np.int32 if len(data) < 1 << 31 else np.int64
    gap = _mapped(_GAP, data)
    # a text's first byte may start a word, and its last end one, whatever lies beside it
    text_starts = np.append(0, text_ends[:-1])
    mark = ~gap
    mark[1:] &= gap[:-1]
    mark[text_starts] = ~gap[text_starts]
    starts = np.flatnonzero(mark).astype(small)
    np.logical_not(gap, out=mark)
    mark[:-1] &= gap[1:]
    mark[text_ends - 1] = ~gap[text_ends - 1]
    sizes = np.flatnonzero(mark).astype(small)
    sizes += small(1)
    sizes -= starts
    del mark
    of_word = np.diff(np.searchsorted(starts, text_ends), prepend=0)     # words of each text
    linked = np.ones(len(starts), bool)
    for cut in (np.searchsorted(starts, np.flatnonzero(_mapped(_PIECE, data))), np.cumsum(of_word)):
        linked[cut[cut > 0] - 1] = False
    del starts
    packed = data[~gap]
    del data, gap
    coded = encoded(packed, sizes)
    del packed, sizes
    groups = sorted(set(of_text))
    number = {g: i for i, g in enumerate(groups)}
    width = max(1, len(coded.dictionary))
    keys = np.repeat(np.array([number[g] for g in of_text], np.int64) * width, of_word)
    keys += coded.indices.to_numpy()
    if width * len(groups) < 8 * max(1 << 20, len(keys)):
        times = np.bincount(keys, minlength=width * len(groups))
        own = np.flatnonzero(times)
        times, fresh = times[own], np.cumsum(times > 0, dtype=np.int64) - 1
        ids = fresh[keys]
    else:
        own, ids, times = np.unique(keys, return_inverse=True, return_counts=True)
    return Shard(groups, own // width, own % width, coded.dictionary, ids.astype(np.int32), times, linked)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, every key's number among them, and their occurrences."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(first, dtype=np.int32) - 1
    begin = np.flatnonzero(first)
    return order[begin], number, np.diff(begin, append=len(keys))


def _levels(shard: Shard, known: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
            longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of 2, 3, ... words: (length, a place of each, its occurrences, its hash).

    Only phrases whose two halves (all but the last, all but the first word)
    were kept come up; ``keep`` gets the places, occurrences and hashes.
    """
    first = shard.hashes()
    ids, hashes = shard.ids, first
    live = known[shard.ids] if len(known) else np.zeros(0, bool)
    reach = shard.linked            # the words from here on are in one piece, as many as the level asks for
    for length in range(2, longest + 1):
        at = np.flatnonzero(live[:-1] & live[1:] & reach[:-1]).astype(np.int32)
        if not len(at):
            return
        keys = ids[at].astype(np.int64)
        keys *= len(hashes)
        keys += ids[at + 1]
        where, number, times = _numbered(keys)
        places = at[where]
        hashes = mix(hashes[ids[places]] * np.uint64(0x9E3779B97F4A7C15)
                     + first[shard.ids[places + length - 1]] + np.uint64(length))
        kept = keep(places, times, hashes)
        if kept.any():
            yield length, places[kept], times[kept], hashes[kept]
        live, ids = np.zeros(len(ids), bool), np.zeros(len(ids), np.int32)
        live[at] = kept[number]
        ids[at] = number
        reach = reach & np.append(shard.linked[length - 1:], np.zeros(length - 1, bool))[:len(reach)]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


class _Tally:
    """Sums per slot, none above 255, in blocks of which only those that are not empty take memory (16 KB each)."""

    def __init__(self):
        self.blocks: dict[int, np.ndarray] = {}

    def add(self, slots: np.ndarray, values: np.ndarray) -> None:
        slots, which = np.unique(slots, return_inverse=True)
        sums = np.bincount(which, np.minimum(values, 255), len(slots)).astype(np.int64)
        cut = np.flatnonzero(np.diff(slots >> _BLOCK_BITS, prepend=-1)) if len(slots) else np.zeros(0, np.int64)
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(slots)], strict=False):
            self._add(int(slots[i] >> _BLOCK_BITS), slots[i:j] & ((1 << _BLOCK_BITS) - 1), sums[i:j])

    def _add(self, block: int, inside: np.ndarray, sums: np.ndarray) -> None:
        counts = self.blocks.setdefault(block, np.zeros(1 << _BLOCK_BITS, np.uint8))
        counts[inside] = np.minimum(counts[inside] + sums, 255)

    def merge(self, block: int, packed: bytes) -> None:
        if len(packed) == 1 << _BLOCK_BITS:
            self._add(block, np.arange(1 << _BLOCK_BITS), np.frombuffer(packed, np.uint8).astype(np.int64))
        else:
            pairs = np.frombuffer(packed, np.uint32).astype(np.int64)
            self._add(block, pairs >> 8, pairs & 255)

    def rows(self) -> tuple[list[int], list[bytes]]:
        """Blocks, and for each its (slot, sum) pairs, or all of its sums where that is shorter."""
        packed = []
        for counts in self.blocks.values():
            inside = np.flatnonzero(counts)
            pairs = (inside << 8 | counts[inside]).astype(np.uint32)
            packed.append((pairs if pairs.nbytes < len(counts) else counts).tobytes())
        return list(self.blocks), packed


_TALLY_ROWS = "block long, packed binary, group string, lowered long"


def _tally_batch(tally: _Tally, lowered: dict[str, int] | None = None) -> pa.RecordBatch:
    """A task's sums, and what the lowered supports of its shards leave uncounted."""
    (blocks, packed), lowered = tally.rows(), lowered or {}
    return pa.RecordBatch.from_arrays([
        pa.array([*blocks, *[None] * len(lowered)], pa.int64()), pa.array([*packed, *[None] * len(lowered)], pa.binary()),
        pa.array([*[None] * len(blocks), *lowered], pa.string()),
        pa.array([*[None] * len(blocks), *lowered.values()], pa.int64())], ["block", "packed", "group", "lowered"])


def _table(rows: DataFrame) -> np.ndarray:
    """The sums of (block, packed) rows; executors add up blocks, the driver gets 2^BITS bytes at most."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for block, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tally.merge(block, packed)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(tally.rows(), (pa.int64(), pa.binary()), strict=True)],
                                         ["block", "packed"])

    out = np.zeros(1 << BITS, np.uint8)
    whole = _Tally()
    summed = rows.filter("block is not null").select("block", "packed").repartition("block")
    for row in summed.mapInArrow(merged, "block long, packed binary").toLocalIterator():
        whole.merge(row["block"], row["packed"])
    for block, counts in whole.blocks.items():
        out[block << _BLOCK_BITS:(block + 1) << _BLOCK_BITS] = counts
    return out


def _count_words(limit: int):
    """Pass 1: (group, word, count) of every shard; the row without a word counts all."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, limit):
            groups = pa.array(shard.groups, pa.string())
            every = np.bincount(shard.group, shard.times, len(shard.groups)).astype(np.int64)
            words = shard.words.take(pa.array(shard.word)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([groups.take(pa.array(shard.group)), groups]),
                pa.concat_arrays([words, pa.nulls(len(groups), pa.string())]),
                pa.array(np.concatenate((shard.times, every)).astype(np.int64))], ["group", "word", "n"])
    return counted


def _word_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of (group, word) rows."""
    tally = _Tally()
    for batch in batches:
        raw = [w.encode() for w in batch.column(1).to_pylist()]
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        starts = ends - np.array([len(w) for w in raw], np.int64)
        own = piece_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
        groups = batch.column(0).to_pylist()
        names = sorted(set(groups))
        number = {g: i for i, g in enumerate(names)}
        if raw:
            slots = _slots(mix(own + _group_hashes(names)[[number[g] for g in groups]]))
            tally.add(slots, np.ones(len(slots)))
    yield _tally_batch(tally)


def _mine(words: np.ndarray, totals: dict[str, int], support: int, longest: int, limit: int):
    """Pass 2: how far the phrases frequent in a shard exceed what a phrase that is not may have there."""
    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, uncounted = _Tally(), {}
        for shard in _shards(batches, limit):
            mine = np.bincount(shard.group, shard.times, len(shard.groups)).astype(np.int64)
            lowered = np.array([max(1, -(-support * int(w) // totals[g])) if totals.get(g) else 1
                                for g, w in zip(shard.groups, mine, strict=True)], np.int64)
            for g, n in zip(shard.groups, lowered.tolist(), strict=True):
                if n > 1:
                    uncounted[g] = uncounted.get(g, 0) + n - 1

            def keep(places, times, hashes, shard=shard, lowered=lowered):
                return times >= lowered[shard.group[shard.ids[places]]]

            for _, places, times, hashes in _levels(shard, words[_slots(shard.hashes())] > 0, keep, longest):
                tally.add(_slots(hashes), times - lowered[shard.group[shard.ids[places]]] + 1)
        yield _tally_batch(tally, uncounted)
    return mined


def _count_phrases(words: np.ndarray, phrases: np.ndarray, ends: np.ndarray, needed: dict[str, int], support: int,
                   longest: int, limit: int):
    """Pass 3: (group, phrase, count) of every shard for the phrases whose sum in pass 2 leaves them a chance.

    They begin or end in one of the words in ``ends``.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, limit):
            least = np.array([min(255, needed.get(g, support)) for g in shard.groups], np.int64)

            def keep(places, times, hashes, shard=shard, least=least):
                return phrases[_slots(hashes)] >= least[shard.group[shard.ids[places]]]

            spelled, groups, slots = shard.words, np.array(shard.groups, object), _slots(shard.hashes())
            end = ends[slots] > 0
            for length, places, times, _ in _levels(shard, words[slots] > 0, keep, longest):
                wanted = end[shard.ids[places]] | end[shard.ids[places + length - 1]]
                places, times = places[wanted], times[wanted]
                numbers = shard.word[shard.ids[places[:, None] + np.arange(length)]]
                used, inside = np.unique(numbers, return_inverse=True)
                text = [w.decode() for w in spelled.take(pa.array(used)).to_pylist()]
                inside, of = inside.reshape(numbers.shape), groups[shard.group[shard.ids[places]]]
                for i in range(0, len(places), _ROWS):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(of[i:i + _ROWS], pa.string()),
                        pa.array([" ".join([text[j] for j in row]) for row in inside[i:i + _ROWS].tolist()], pa.string()),
                        pa.array(times[i:i + _ROWS].astype(np.int64))], ["group", "word", "n"])
    return counted


def frequent_phrases(docs: DataFrame, text_col: str = "text", group_col: str = "lang", support: int = SUPPORT,
                     longest: int = LONGEST, shard: int = SHARD, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(group, phrase, f) of all phrases of 1 to ``longest`` words with ``support`` occurrences, and (group, n).

    With ``top``, of longer phrases those only that decide the ``top`` collocations of each group.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("group"),
                        F.col(text_col).cast("string").alias("text"))
    schema = "group string, word string, n long"
    one = stored(texts.mapInArrow(_count_words(shard), schema).groupBy("group", "word").agg(F.sum("n").alias("n"))
                 .filter(F.col("word").isNull() | (F.col("n") >= support)), "phrase-words")
    totals = one.filter("word is null").select("group", "n")
    words = one.filter("word is not null")
    # a bounded table: groups beyond it are mined at the lowest support
    largest = {r["group"]: r["n"] for r in totals.orderBy(F.desc("n"), "group").limit(THRESHOLDS).collect()}
    slots_of = lambda some: spark.sparkContext.broadcast(
        _table(some.select("group", "word").mapInArrow(_word_slots, _TALLY_ROWS)))
    known = slots_of(words)

    def local(batches):
        return _mine(known.value, largest, support, longest, shard)(batches)

    mined = stored(texts.mapInArrow(local, _TALLY_ROWS), "phrase-tallies")
    # only groups whose support was lowered to more than 1, so THRESHOLDS rows at most
    uncounted = mined.filter("group is not null").groupBy("group").agg(F.sum("lowered").alias("n")).collect()
    needed = {r["group"]: support - r["n"] for r in uncounted}
    sums = spark.sparkContext.broadcast(_table(mined))

    def counted(ends):
        def exact(batches):
            return _count_phrases(known.value, sums.value, ends.value, needed, support, longest, shard)(batches)

        more = stored(texts.mapInArrow(exact, schema).groupBy("group", "word").agg(F.sum("n").alias("n"))
                      .filter(F.col("n") >= support), "phrases")
        return more.select("group", F.col("word").alias("phrase"), F.col("n").alias("f"))

    single = words.select("group", F.col("word").alias("phrase"), F.col("n").alias("f"))
    if top is None:
        return single.unionByName(counted(known)), totals

    counts, todo = single, totals
    for mass in (START * top * support, WIDER * START * top * support):
        limits = stored(_limits(words.join(todo.select("group"), "group", "left_semi"), todo, mass), "phrase-limits")
        rare = words.join(limits, "group").filter(F.col("most").isNull() | (F.col("n") <= F.col("most")))
        more = counted(slots_of(rare.select("group", "word")))
        more = more.join(limits, "group", "left_semi")
        left = stored(_unsettled(_free(single.unionByName(more), totals), totals.join(limits, "group"), top), "phrase-groups")
        counts = counts.unionByName(more.join(left, "group", "left_anti"))
        todo = totals.join(left, "group", "left_semi")
        if left.isEmpty():
            return counts, totals
    last = counted(slots_of(words.join(todo, "group", "left_semi"))).join(todo, "group", "left_semi")
    return counts.unionByName(last), totals


def _limits(words: DataFrame, groups: DataFrame, mass: int) -> DataFrame:
    """(group, most): up to which f a group's words have ``mass`` occurrences together; null if all have less."""
    steps = words.groupBy("group", F.floor(8 * F.log2("n")).alias("step")).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("group").orderBy("step"))
    reached = steps.withColumn("sum", so_far).filter(F.col("sum") >= mass).groupBy("group").agg(F.min("most").alias("most"))
    return groups.select("group").join(reached, "group", "left")


def _unsettled(free: DataFrame, limits: DataFrame, top: int) -> DataFrame:
    """The groups of limits(group, n, most) with fewer than ``top`` phrases above what any other phrase can score."""
    bound = F.expr(f"cast(1000 * cast(n as decimal(19,0)) as {_EXACT}) div cast(most + 1 as {_EXACT})")
    limits = limits.filter("most is not null").select("group", bound.alias("bound"))
    settled = (free.select("group", F.col("cut.score").alias("score")).join(limits, "group").filter("score > bound")
               .groupBy("group").count().filter(F.col("count") >= top))
    return limits.join(settled, "group", "left_anti").select("group")


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", support: int = SUPPORT,
                 longest: int = LONGEST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """The ``top`` phrases of each group: group, rank, phrase, a, l, r, n, score."""
    counts, totals = frequent_phrases(docs, text_col, group_col, support, longest, shard, top)
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return _free(counts, totals).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select(
        "group", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))


def _free(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """group, phrase, a, n and lowest-scoring cut of the phrases whose parts are all counted and that no longer one holds."""
    split = F.split("phrase", " ")
    candidates = counts.filter(F.contains("phrase", F.lit(" "))).withColumn("words", split)
    cuts = candidates.select(
        "group", "phrase", F.col("f").alias("a"), "words",
        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "group", "phrase", "a", "k", _joined(F.col("words"), F.lit(1), F.col("k")).alias("first"),
        _joined(F.col("words"), F.col("k") + 1, F.size("words")).alias("rest"))
    left = counts.select("group", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("group", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = [F.col(c).cast("decimal(19,0)").alias(f"_{c}") for c in ("a", "l", "r", "n")]
    scored = (cuts.join(left, ["group", "first"]).join(right, ["group", "rest"]).join(totals, "group")
              .select("*", *wide)
              .withColumn("score", F.expr(f"cast(cast(1000 * _a as decimal(19,0)) * _n as {_EXACT}) div cast(_l * _r as {_EXACT})")))
    lowest = scored.groupBy("group", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"),
        F.count(F.lit(1)).alias("cuts")).filter(F.col("cuts") == F.size(split) - 1)

    # every shorter phrase inside a candidate, with the occurrences of the longer one
    size = F.size("words")
    inner = candidates.filter(size > 2).select(
        "group", "words", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).select(
        "group", "words", "f", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i")).select(
        "group", _joined(F.col("words"), F.col("i"), F.col("m")).alias("phrase"), "f")
    holders = inner.groupBy("group", "phrase").agg(F.max("f").alias("_longer"))
    return lowest.join(holders, ["group", "phrase"], "left").filter(
        F.col("_longer").isNull() | (F.col("_longer") < F.col("a")))
