"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. In each window every source
may send its quantum, its share of the window, in whole units of tokens; what
it could not send stays as a deficit and is added to its next quantum. After k
windows a source with share p has therefore sent the whole units among its
first floor(k * window * p) tokens. That closed form is what carries deficits
across windows and partitions: the window of a token follows from its place in
its own queue alone, so queues are worked off in parallel and one source may
own any part of the rows. With given weights a queue that runs dry leaves its
share to the others: the shares then hold from one such moment to the next.

The tokens in order of (window, source, place in the queue) form one stream;
it is cut every ``length`` tokens into sequences. Only the last is padded.

Results in special cases: a null text is empty and gives its separator alone;
a null source is a queue of its own; documents of a queue are ordered by a
hash of id and text, rows that repeat both by the number they got when the
token table was written; an empty table gives no pieces; other columns are not
read. Sources not named in the weights share the weight named ``rest``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import numbered, prepare, private, running_total, stored
from fieldloom.llm.tokens import encoder, tokenizer_path

SEQUENCE = 1024
WINDOW = 1024 * 64
UNIT = 256      # tokens that a queue sends at once, so that small sources are not sent token by token
SEPARATOR = 0

_TOKENS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
_PIECE = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "source string, window long, ids binary")


def tokenised(path: str, separator: int | None = SEPARATOR):
    """mapInArrow function over (id, source, text_key, text): token ids as little-endian 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            ids, at = code.encode(batch.column(3))
            small = ids.astype("<u2")
            if separator is not None:
                small = np.insert(small, at[1:], separator)
                at = at + np.arange(len(at))
            raw, bounds = small.tobytes(), (2 * at).tolist()
            blobs = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at)),
                 pa.array(blobs, pa.binary())], names=_TOKENS.names)

    return run


def token_table(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str) -> DataFrame:
    """uid, id, source, text_key, n and the ids of every document, stored."""
    texts = private(docs, id=F.col(id_col).cast("long"), source=F.col(source_col).cast("string"),
                    text_key=F.xxhash64(F.col(text_col)), text=F.col(text_col))
    return stored(numbered(texts.mapInArrow(tokenised(path), _TOKENS), "uid"), "tokens", compression="zstd")


def _phases(totals: dict, weights: Mapping[str, float]) -> list[tuple[float, float, float]]:
    """When queues run dry: (virtual time, tokens sent by then, tokens per unit of time from then on).

    A queue of weight w sends w tokens in a unit of virtual time until it is empty.
    """
    ends = sorted((n / weights[q], weights[q]) for q, n in totals.items() if n)
    rate, time, sent, out = sum(w for _, w in ends), 0.0, 0.0, []
    for end, weight in ends:
        out.append((time, sent, rate))
        sent += rate * (end - time)
        rate, time = max(0.0, rate - weight), end
    return out



def window_cuts(window: int, unit: int, weights_of: dict | None, phases: list | None):
    """mapInArrow function: documents to the stretches that fall into one window.

    A stretch is (uid, start in the document, length, window, queue place).
    """

    def natural(q_total: int, total: int):
        # the first token of window k is floor(k * W * q / T)
        first = lambda k: k * window * q_total // total
        of = lambda t: -(-(t + 1) * total // (window * q_total)) - 1
        return first, of

    def weighted(weight: float):
        def sent_at(time: float) -> float:
            p = phases[max(0, _rightmost(phases, 0, time))]
            return p[1] + (time - p[0]) * p[2]

        def first(k: int) -> int:
            p = phases[max(0, _rightmost(phases, 1, k * window))]
            return int(np.ceil((p[0] + (k * window - p[1]) / p[2]) * weight))

        def of(t: int) -> int:
            k = max(0, int(sent_at(t / weight) // window))
            while first(k) > t:
                k -= 1
            while first(k + 1) <= t:
                k += 1
            return k

        return first, of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, queue, at, n, q_total, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                first, of = natural(q_total, total) if phases is None else weighted(weights_of[queue])
                begin = at
                while begin < at + n:
                    # a unit goes with its last token
                    k = of(min((begin // unit + 1) * unit, q_total) - 1)
                    due = first(k + 1)
                    end = min(at + n, q_total if due >= q_total else due // unit * unit)
                    rows.append((uid, begin - at, end - begin, k, queue, begin))
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()])],
                names=["uid", "start", "length", "window", "queue", "place"])

    return run


def _rightmost(phases: list, field: int, value: float) -> int:
    """The last phase whose field is at or below value."""
    low, high = 0, len(phases)
    while low < high:
        middle = (low + high) // 2
        if phases[middle][field] <= value:
            low = middle + 1
        else:
            high = middle
    return low - 1


def _pieces(length: int, keep_ids: bool):
    """mapInArrow function: tokens with their stretches, cut at sequence ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid_id, source, n, ids, stretches in zip(*[batch.column(c).to_pylist() for c in (
                    "id", "source", "n", "ids", "stretches")], strict=True):
                codes = np.frombuffer(ids, "<u2")
                for s in sorted(stretches, key=lambda s: s["start"]):
                    begin, left, at = s["start"], s["length"], s["stream_at"]
                    while left:
                        take = min(left, length - at % length)
                        piece = codes[begin:begin + take].astype("<u4").tobytes()
                        out.append((uid_id, begin, take, zlib.crc32(piece), n, at // length, at % length,
                                    source, s["window"], piece if keep_ids else None))
                        begin, left, at = begin + take, left - take, at + take
            types = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 10, types)],
                names=[f.split()[0] for f in _PIECE.split(", ")])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         length: int = SEQUENCE, window: int = WINDOW, unit: int = UNIT,
         weights: Mapping[str, float] | None = None, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of sequences of ``length`` tokens, each window mixed by ``weights`` (default: the corpus's shares).

    ``weights`` names sources, and optionally ``rest``; its size bounds what the driver holds.
    ``ids`` holds a piece's token ids as little-endian 32-bit numbers, null without keep_ids.
    """
    prepare(docs.sparkSession)
    tokens = token_table(docs, id_col, text_col, source_col, path or tokenizer_path())
    queue = F.coalesce("source", F.lit("\0null"))
    if weights is not None:
        # sources without a weight of their own form one queue
        queue = F.when(queue.isin(*[w for w in weights if w != "rest"]), queue).otherwise(F.lit("rest"))
    queued = tokens.select("uid", "n", queue.alias("queue"), F.xxhash64("id", "text_key").alias("_order"))
    placed = running_total(queued, ["queue", "_order", "uid"], "n", "_all_before", "queues")
    # pre-aggregated: one row per queue
    totals = queued.groupBy("queue").agg(F.sum("n").alias("q_total"))
    starts = running_total(totals, ["queue"], "q_total", "q_start", "queue-totals")
    n_tokens = queued.agg(F.sum("n")).first()[0] or 0
    rows = placed.join(starts, "queue").select(
        "uid", "queue", (F.col("_all_before") - F.col("q_start")).alias("at"), "n", "q_total",
        F.lit(n_tokens).cast("long").alias("total"))
    weights_of = phases = None
    if weights is not None:
        sums = {r["queue"]: r["q_total"] for r in starts.collect()}     # at most one row per weight
        weights_of = {q: float(weights.get(q, min(weights.values()))) for q in sums}
        phases = _phases(sums, weights_of)
    cuts = rows.mapInArrow(window_cuts(window, unit, weights_of, phases),
                           "uid long, start long, length long, window long, queue string, place long")
    stream = running_total(cuts, ["window", "queue", "place"], "length", "stream_at", "stretches")
    per_doc = stream.groupBy("uid").agg(
        F.collect_list(F.struct("start", "length", "window", "stream_at")).alias("stretches"))
    return (tokens.join(per_doc, "uid").select("id", "source", "n", "ids", "stretches")
            .mapInArrow(_pieces(length, keep_ids), _PIECE))
