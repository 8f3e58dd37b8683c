"""Quality rules: document statistics judged by gradient-boosted trees.

One pass over a text gives exact counts (words, characters, symbols, repeated
lines, repeated windows of three words) and ratios of them. Fixed rules fail a
text outright; the others are judged by boosted trees that were trained on
labelled documents. The trees are grown on histograms, with monotonic
constraints: more symbols, repeated lines, repeated windows or capitals never
raise a score. All trees lie flattened in numpy node arrays, and a batch is
scored by ``depth`` gathers over a matrix of (text, tree).

Only the fit is bounded: at most TRAINING labelled documents, those with the
smallest hash of the id (then of the text). Every text is measured whole.

Results in special cases: a null text is empty, and fails the rules with all
counts 0, like any text of fewer than MIN_WORDS words; labels that are null are
not learned, and an id with several labels has the lowest; without two
different labels the trees say nothing and only the rules decide; a null id
carries no label and is judged like any other; repeated rows get the same
answer each; an empty table gives an empty result; other columns pass through,
those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.arrays import SPACE, flat, word_codes, words
from fieldloom.llm.common import prepare

TRAINING = 20_000       # labelled documents in the fit
TREES = 60
DEPTH = 3
BINS = 64
RATE = 0.2
SHRINK = 1.0            # added to the curvature of every leaf
LEAF = 10               # labelled documents in a leaf, at least
MIN_WORDS = 50
MAX_REPEATED = 50       # per cent of the words in windows found again
WINDOW = 3
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# name and direction of each feature: -1 never raises the score, 0 is free
FEATURES = (
    ("log_words", 0), ("word_length", 0), ("symbols_per_word", -1), ("repeated_lines", -1), ("repeated_words", -1),
    ("digits", 0), ("capitals", -1), ("punctuation", 0), ("words_per_line", 0), ("distinct_words", 0),
)
_RESULT = "struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ", score: double>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT = _table(SYMBOLS), _table(b"0123456789")
_CAPITAL = _table(bytes(range(65, 91)))
_PUNCTUATION = _table(b".,;:!?'\"()-")


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (n x 5, exact) and FEATURES (n x 10) of each text; null is empty."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    starts, ends, at = words(data, offsets)
    codes = word_codes(data, starts, ends)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    visible = ((data & 0xC0) != 0x80) & ~SPACE[data]
    n_words, word_chars, n_symbols = np.diff(at), per_text(visible), per_text(_SYMBOL[data])
    n_lines, n_dup = _lines(data, offsets, starts)
    again, distinct = _windows(codes, at)
    n_repeat = np.diff(np.concatenate(([0], np.cumsum(again)))[at])
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64).reshape(n, 5)
    some, chars = np.maximum(1, n_words), np.maximum(1, word_chars)
    features = np.stack([
        np.log1p(n_words), word_chars / some, n_symbols / some, n_dup / np.maximum(1, n_lines), n_repeat / some,
        per_text(_DIGIT[data]) / chars, per_text(_CAPITAL[data]) / chars, per_text(_PUNCTUATION[data]) / chars,
        n_words / np.maximum(1, n_lines), distinct / some,
    ], axis=1).reshape(n, len(FEATURES))
    return counts, features


def _lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the lines with a word, and those equal to an earlier one."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    text = np.searchsorted(offsets, begin, side="right") - 1
    # a break at a text's end opens an empty line, which may lie where the next text begins: no word, no matter
    end = np.append(begin[1:], len(data))
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, text = begin[full], end[full], text[full]
    raw = data.tobytes()
    dup, seen, current = np.zeros(n, np.int64), set(), -1
    for t, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
        if t != current:
            current, seen = t, set()
        line = raw[a:b].removesuffix(b"\n")
        if line in seen:
            dup[t] += 1
        else:
            seen.add(line)
    return np.bincount(text, minlength=n), dup


def _windows(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in a window that its text holds twice or more, and each text's distinct words."""
    again = np.zeros(len(codes) + WINDOW, bool)
    distinct = np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if a == b:
            continue
        own, ids = np.unique(codes[a:b], return_inverse=True)
        distinct[i] = len(own)
        key, base = ids[:b - a - WINDOW + 1].astype(np.int64), len(own)
        for j in range(1, WINDOW):
            if len(key) < 2:
                break
            if base > (1 << 31):        # keep the key in 63 bits: number what is there anew
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                base = int(key.max()) + 1
            key = key * len(own) + ids[j:j + len(key)]
            base *= len(own)
        if len(key) < 2:
            continue
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        for begin in np.flatnonzero(times[which] > 1) + a:
            again[begin:begin + WINDOW] = True
    return again[:len(codes)], distinct


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node i sends x to left[i] + (x[feature[i]] > threshold[i]); a leaf sends it to itself."""

    roots: np.ndarray       # the root of each tree
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray       # of the leaves
    depth: int
    start: float

    def score(self, features: np.ndarray) -> np.ndarray:
        """The probability that a text is good, one per row; 1 where there is no tree."""
        if not len(self.roots):
            return np.ones(len(features))
        node = np.broadcast_to(self.roots, (len(features), len(self.roots)))
        row = np.arange(len(features))[:, None]
        for _ in range(self.depth):
            node = self.left[node] + (features[row, self.feature[node]] > self.threshold[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES, depth: int = DEPTH,
          bins: int = BINS) -> Trees:
    """Fit boosted trees to y in {0, 1} with logistic loss, growing level by level on histograms."""
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros(0)
        return Trees(none.astype(np.int64), none.astype(np.int64), none, none.astype(np.int64), none, 0, 0.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    nodes: list[list] = []      # feature, threshold, left, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(len(nodes))
        leaf = _grow(binned, cuts, p - y, p * (1 - p), directions, depth, bins, nodes)
        margin += np.array([node[3] for node in nodes])[leaf]
    feature, threshold, left, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(np.array(roots), feature.astype(np.int64), threshold.astype(float), left.astype(np.int64),
                 value.astype(float), depth, start)


def _grow(binned, cuts, grad, curve, directions, depth, bins, nodes) -> np.ndarray:
    """Append one tree to nodes and return the leaf of every row."""
    def weight(g, h):
        return -g / (h + SHRINK)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), value])    # left is itself, and nothing exceeds its threshold
        return len(nodes) - 1

    where = np.zeros(len(grad), np.int64)
    root = leaf(RATE * float(weight(grad.sum(), curve.sum())))
    where[:] = root
    front = [(root, np.arange(len(grad)), -np.inf, np.inf)]
    for _ in range(depth):
        following = []
        for node, rows, low, high in front:
            g, h = grad[rows], curve[rows]
            parent = g.sum() ** 2 / (h.sum() + SHRINK)
            best = (1e-6, None)
            for f, direction in enumerate(directions):
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, bins))[:len(cuts[f])] for w in (g, h, None))
                gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
                wl, wr = np.clip(weight(gl, hl), low, high), np.clip(weight(gr, hr), low, high)
                gain = -(2 * gl * wl + (hl + SHRINK) * wl**2 + 2 * gr * wr + (hr + SHRINK) * wr**2) - parent
                allowed = (nl >= LEAF) & (nr >= LEAF) & ((wr - wl) * direction >= 0)
                gain = np.where(allowed, gain, -np.inf)
                at = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[at] > best[0]:
                    best = (gain[at], (f, at, float(wl[at]), float(wr[at])))
            if best[1] is None:
                continue
            f, at, wl, wr = best[1]
            middle, direction = (wl + wr) / 2, directions[f]
            child = leaf(RATE * wl), leaf(RATE * wr)
            nodes[node][:3] = f, cuts[f][at], child[0]
            right = binned[rows, f] > at
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(
                direction, ((low, high), (low, high)))
            for side, (which, bound) in enumerate(zip((rows[~right], rows[right]), bounds, strict=True)):
                where[which] = child[side]
                following.append((child[side], which, *bound))
        front = following
    return where


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", training: int = TRAINING) -> Trees:
    """Fit on at most ``training`` labelled documents, the first in order of a hash of the id."""
    prepare(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
             .dropna().groupBy("_id").agg(F.min("_label").alias("_label")))
    # a bounded table: ``training`` rows of two numbers
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(training)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(list(measure(texts)[1]), pa.list_(pa.float64()))

    order = [F.xxhash64("_id"), F.col("_id"), F.xxhash64("_text")]
    sample = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(F.broadcast(chosen), "_id").orderBy(*order).limit(training)
              .select("_label", features("_text").alias("x")).collect())
    x = np.array([r["x"] for r in sample], float).reshape(len(sample), len(FEATURES))
    y = np.array([r["_label"] for r in sample], float)
    return boost(x, (y > 0).astype(float), [d for _, d in FEATURES])


def judge(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with COUNTS, ``score``, ``base_failed`` and ``kept``."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)      # TREES x 2^DEPTH nodes, whatever the data

    @F.arrow_udf(_RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        counts, features = measure(texts)
        return pa.StructArray.from_arrays(
            [*[pa.array(c) for c in counts.T], pa.array(sent.value.score(features))], [*COUNTS, "score"])

    results = (*COUNTS, "score", "base_failed", "kept")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    said = docs.select(F.struct(*others, F.lit(0)).alias("_row"), judged(F.col(text_col)).alias("_said"))
    failed = (F.col("_said.n_words") < MIN_WORDS) | (
        100 * F.col("_said.n_repeat_words") > MAX_REPEATED * F.col("_said.n_words"))
    return said.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in results],
        *[F.col(f"_said.{c}") for c in (*COUNTS, "score")],
        failed.alias("base_failed"), (~failed & (F.col("_said.score") >= threshold)).alias("kept"))
