"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Tokens are the runs of letters and digits, lower-cased; in scripts written
without spaces every character is one. Fixed masks select some tokens of a span
and ignore the others; a seed is the hash of the selected tokens, for every
position and mask. Test seeds and training seeds are joined; for each alignment
that a hit gives, the item is laid beside the document's tokens around it and
both are compared token by token.
An overlap is a stretch of OVERLAP tokens (the whole item if it is shorter) of
which at least PERCENT per cent are equal, so substituted words do not hide it.

The masks miss no overlap. Every way to substitute 2 of 13 tokens leaves a seed
of one of MASKS whole. An item shorter than OVERLAP is anchored at its start by
the masks of SHORT: its first ``span`` tokens are dealt into ``groups`` in turn
and each mask ignores as many groups as tokens may differ, so one mask ignores
all that do. Items of fewer than 5 tokens may differ in none and are hashed
whole. Only the masks that some item uses are hashed in documents.

The test seeds are counted first: up to BROADCAST_SEEDS of them are sent to all
executors and the training seeds, the large side, are never shuffled; beyond
that the join shuffles both sides. Items with equal tokens are joined once.

Results in special cases: null and empty texts are clean; items without a token
say nothing and are left out; an item of one word overlaps every text with that
word; rows that repeat id and text get the same verdict; a null item id still counts as one item; an empty table
on either side gives no overlap; other columns pass through unread.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import numbered, prepare, stored

# fixed masks of weight 6: 1 is compared, 0 ignored
MASKS = ("111111", "11011011", "1110000111", "1011010101")
OVERLAP = 13
PERCENT = 80
# shortest item, span, groups and ignored groups of the masks for items shorter than OVERLAP
SHORT = ((1, 1, 1, 0), (2, 2, 1, 0), (3, 3, 1, 0), (4, 4, 1, 0), (5, 5, 3, 1), (7, 7, 3, 1), (10, 10, 4, 2))
# Thai, Lao, Myanmar, Khmer, kana, Han
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
BROADCAST_SEEDS = 1 << 20       # 16 bytes each
_CHUNK = 32     # positions whose tokens are kept together; a row never holds a whole text's tokens per position
_BLOCK = 4096   # alignments of a document that are kept in one row at most, per item
_LONGEST = max(map(len, MASKS))


def short_masks(span: int, groups: int, ignored: int) -> list[str]:
    """Every choice of ``ignored`` groups, position i being of group i modulo groups."""
    return ["".join("0" if i % groups in gone else "1" for i in range(span)) for gone in combinations(range(groups), ignored)]


def tokens(text: Column) -> Column:
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"([{UNSPACED}])", " $1 ")
    return F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), "")


def _seed(words: Column, position: Column, mask: str) -> Column:
    """Null where the mask reaches beyond the words."""
    chosen = [F.get(words, position + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(position + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *chosen))


def _short_classes() -> list[tuple[int, int, list[str]]]:
    """Items of ``first`` to below ``end`` tokens with their masks."""
    ends = [*[first for first, *_ in SHORT[1:]], OVERLAP]
    return [(first, end, short_masks(*how)) for (first, *how), end in zip(SHORT, ends, strict=True)]


def masks_in_use(items: DataFrame) -> list[str]:
    """The masks by which some item is sought: at most those of MASKS and SHORT."""
    classes = [(OVERLAP, 1 << 31, list(MASKS)), *_short_classes()]
    size = F.size("item")
    held = items.agg(*[F.count_if((size >= first) & (size < end)) for first, end, _ in classes]).first()
    return [mask for n, (_, _, masks) in zip(held, classes, strict=True) if n for mask in masks]


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_no, item_id, item: every distinct token sequence, stored."""
    items = (benchmark.select(F.col(id_col).alias("item_id"), tokens(F.col(text_col)).alias("item"))
             .filter(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id")))
    return stored(numbered(items, "item_no"), "benchmark-items")


def item_seeds(items: DataFrame) -> DataFrame:
    """seed, item_no, item_at, item_size: every mask at every position of long items, at the start of short ones."""
    size = F.size("item")
    at = items.filter(size >= OVERLAP).withColumn("item_at", F.explode(F.sequence(F.lit(0), size - 1)))
    seeds = [at.withColumn("seed", F.explode(F.array(*[_seed(F.col("item"), F.col("item_at"), m) for m in MASKS])))]
    for first, end, masks in _short_classes():
        start = items.filter((size >= first) & (size < end)).withColumn("item_at", F.lit(0))
        seeds.append(start.withColumn("seed", F.explode(F.array(*[_seed(F.col("item"), F.col("item_at"), m) for m in masks]))))
    out = reduce(DataFrame.unionByName, seeds).filter("seed is not null")
    return stored(out.select("seed", "item_no", "item_at", size.alias("item_size")), "benchmark-seeds")


def _best_stretch() -> Column:
    """Of the item's tokens laid beside the document's: the most equal ones in a stretch of ``need`` tokens."""
    equal = F.zip_with("beside", F.slice("item", F.col("item_from") + 1, F.size("beside")),
                       lambda x, y: F.when(x == y, 1).otherwise(0))
    sums = F.transform(F.array(equal), lambda e: F.array_max(F.transform(
        F.sequence(F.lit(1), F.size(e) - F.col("need") + 1),
        lambda at: F.aggregate(F.slice(e, at, F.col("need")), F.lit(0), lambda acc, x: acc + x))))
    return F.when(F.size("beside") >= F.col("need"), F.get(sums, F.lit(0))).otherwise(0)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """_id, _text_key, item_id and the best share of equal tokens of every verified overlap."""
    prepare(docs.sparkSession)
    items = benchmark_items(benchmark, item_id_col, item_text_col)
    seeds = item_seeds(items)
    small = seeds.count() <= BROADCAST_SEEDS
    masks = masks_in_use(items)
    bounded = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_key"),
                        tokens(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    chunks = texts.select("_id", "_text_key", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("words") - 1, F.lit(_CHUNK)),
        lambda s: F.struct(s.alias("from"), F.slice("words", s + 1, F.lit(_CHUNK + _LONGEST - 1)).alias("words")))).alias("c"))
    at = chunks.select("_id", "_text_key", "c.from", "c.words", F.explode(F.sequence(
        F.lit(0), F.least(F.size("c.words"), F.lit(_CHUNK)) - 1)).alias("at"))
    hashed = at.select("_id", "_text_key", (F.col("from") + F.col("at")).alias("doc_at"), F.explode(F.array(*[
        _seed(F.col("words"), F.col("at"), m) for m in masks])).alias("seed"))
    # all hits of one alignment of an item become one row before the shuffle
    aligned = (hashed.join(bounded(seeds), "seed")
               .groupBy("_id", "_text_key", "item_no", (F.col("doc_at") - F.col("item_at")).alias("shift"))
               .agg(F.max("item_size").alias("item_size")))
    block = F.floor(F.greatest(F.col("shift"), F.lit(0)) / _BLOCK).alias("block")
    per_doc = stored(aligned.groupBy("_id", "_text_key", block).agg(
        F.collect_list(F.struct("item_no", "shift", "item_size")).alias("hits")), "benchmark-hits")
    # texts with a hit, each once; the tokens beside each aligned item are cut out inside the row
    found = per_doc.select(F.col("_id").alias("_hid"), F.col("_text_key").alias("_hkey"), "hits")
    beside = (texts.join(found, texts["_id"].eqNullSafe(found["_hid"]) & (texts["_text_key"] == found["_hkey"]))
              .select("_id", "_text_key", F.explode(F.transform("hits", lambda h: F.struct(
                  h["item_no"].alias("item_no"), F.greatest(-h["shift"], F.lit(0)).alias("item_from"),
                  F.slice("words", F.greatest(h["shift"], F.lit(0)) + 1,
                          h["item_size"] + F.least(h["shift"], F.lit(0))).alias("beside")))).alias("h"))
              .select("_id", "_text_key", "h.*"))
    verified = (beside.join(bounded(items), "item_no")
                .withColumn("need", F.least(F.lit(OVERLAP), F.size("item"))).withColumn("best", _best_stretch()))
    return (verified.filter(F.col("best") * 100 >= F.col("need") * PERCENT)
            .groupBy("_id", "_text_key", "item_id").agg(F.max(F.col("best") / F.col("need")).alias("share")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **columns: str) -> DataFrame:
    """One row per row of docs: id, contaminated, the overlapped items in order, the best share of equal tokens."""
    found = overlaps(docs, benchmark, id_col, text_col, **columns).groupBy("_id", "_text_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("share"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"))
    joined = rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["text_key"] == found["_text_key"]), "left")
    return joined.select("id", F.col("_id").isNotNull().alias("_by_id"), F.col("share").isNotNull().alias("contaminated"),
                         F.coalesce("items", F.array().cast("array<long>")).alias("items"),
                         F.coalesce("share", F.lit(0.0)).alias("share")).drop("_by_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **columns: str) -> DataFrame:
    """The rows of docs without an overlap, with all their columns."""
    found = overlaps(docs, benchmark, id_col, text_col, **columns).select("_id", "_text_key").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(id_col).alias("_did"), F.xxhash64(F.col(text_col)).alias("_dkey"))
    clean = packed.join(found, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dkey") == F.col("_text_key")), "left_anti")
    return clean.select("_row.*")
