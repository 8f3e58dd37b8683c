"""Language identification with string kernels.

A text is the set of its n-grams of 1 to 4 letters (a blended spectrum, presence
not counts), hashed into DIMENSIONS bits. The kernel of two texts is the cosine
of their sets. A bounded sample of labelled texts gives landmarks and training
rows; Nyström features are the kernels with the landmarks times the inverse
root of the landmarks' own kernel matrix; one kernel ridge regression per
language is solved on them. A batch of texts is scored by two matrix products:
presence times landmarks, and kernels times coefficients.

Only the sample is bounded: LANDMARKS and TRAINING texts per language, those
with the smallest hash of id and text, and the LANGUAGES labels with the most
rows. Every text is scored whole.

Results in special cases: a text that is null or has no letter is ``und`` with
score 0; without any labelled text every text is ``und``; labels that are null
are not learned; repeated ids and rows are ranked like others; a null id is in the training fold if it carries a label; ties
go to the first language in alphabetical order; repeated rows get the same
answer each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare

DIMENSIONS = 1 << 15
LANDMARKS = 32      # per language
TRAINING = 256      # per language, landmarks included
LANGUAGES = 64      # labels that are learned; 4 MB of model each
RIDGE = 1e-2
UNKNOWN = "und"
_ORDERS = 4
_BLOCK = 64         # texts scored at once


def presence(text: str | None, flags: np.ndarray) -> np.ndarray:
    """The hashed n-grams present in the text's words; flags is scratch space of DIMENSIONS falses.

    Letters are lower-cased; every run of other characters is one blank, which
    takes part in n-grams as a word boundary. Empty without letters.
    """
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(code)
    if not letter.any():
        return np.zeros(0, np.int64)
    # keep letters and the first of each run of other characters
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[keep]
    code = np.concatenate(([32], code, [32])).astype(np.uint32)
    gram = np.zeros(len(code), np.uint32)
    for n in range(_ORDERS):
        if len(code) <= n:
            break
        gram = gram[:len(code) - n] * np.uint32(0x01000193) ^ code[n:] * np.uint32(0x9E3779B1)
        h = gram + np.uint32(n * 0x51ED27)
        h ^= h >> np.uint32(15)
        flags[(h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


_TABLE = np.zeros(1 << 16, bool)
_TABLE[[c for c in range(1 << 16) if chr(c).isalpha()]] = True


def _letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters; beyond the first plane each distinct one is asked."""
    letter = _TABLE[np.minimum(code, 0xFFFF)]
    high = code > 0xFFFF
    if high.any():
        points, which = np.unique(code[high], return_inverse=True)
        letter[high] = np.array([chr(p).isalpha() for p in points])[which]
    return letter


@dataclass(frozen=True)
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray       # DIMENSIONS x m, columns of length 1
    coefficients: np.ndarray    # m x languages

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: the ridge outputs, NaN where nothing can be said."""
        out = np.full((len(texts), max(1, len(self.languages))), np.nan)
        flags = np.zeros(DIMENSIONS, bool)
        for begin in range(0, len(texts), _BLOCK):
            block = np.zeros((min(_BLOCK, len(texts) - begin), DIMENSIONS), np.float32)
            for i, text in enumerate(texts[begin:begin + _BLOCK]):
                found = presence(text, flags)
                if len(found):
                    block[i, found] = 1 / np.sqrt(len(found))
            said = block.any(axis=1)
            if self.languages and said.any():
                out[begin:begin + len(block)][said] = (block[said] @ self.landmarks) @ self.coefficients
        return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, presence bits): a text of any length becomes DIMENSIONS bits."""
    flags = np.zeros(DIMENSIONS, bool)
    for batch in batches:
        bits = []
        for text in batch.column(1).to_pylist():
            row = np.zeros(DIMENSIONS, bool)
            row[presence(text, flags)] = True
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["lang", "bits"])


def _unit(packed: np.ndarray) -> np.ndarray:
    """Packed presence bits as rows of length 1."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str,
          landmarks: int = LANDMARKS, training: int = TRAINING, most: int = LANGUAGES) -> KernelModel:
    """Fit on at most ``training`` texts per language, the first in order of a hash of id and text.

    Of more than ``most`` labels those with the most rows are learned.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                           F.xxhash64(id_col, text_col).alias("_hash")).filter("lang is not null and text is not null")
    learned = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    rows = rows.filter(F.col("lang").isin(learned))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    # the last hash that is taken, from rows without texts: one row per language; tasks keep ``training`` rows each
    last = {r["lang"]: r["last"] for r in rows.select("lang", "_hash").withColumn("rank", first)
            .filter(F.col("rank") <= training).groupBy("lang").agg(F.max("_hash").alias("last")).collect()}
    bound = F.lit(None).cast("long")
    for name, value in sorted(last.items()):
        bound = F.when(F.col("lang") == name, F.lit(value)).otherwise(bound)
    sample = (rows.filter(F.col("_hash") <= bound).withColumn("rank", first).filter(F.col("rank") <= training)
              .orderBy("lang", "rank").select("lang", "text").mapInArrow(_sets, "lang string, bits binary").collect())
    sample = [r for r in sample if any(r["bits"])]      # texts without a letter teach nothing
    languages = sorted({r["lang"] for r in sample})
    packed = np.array([np.frombuffer(r["bits"], np.uint8) for r in sample])
    lang = np.array([languages.index(r["lang"]) for r in sample], np.int64)
    if not languages:
        return KernelModel([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros((0, 0), np.float32))
    marks = np.concatenate([np.flatnonzero(lang == c)[:landmarks] for c in range(len(languages))])
    z = _unit(packed[marks])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    kernels = [_unit(packed[i:i + _BLOCK]) @ z.T for i in range(0, len(packed), _BLOCK)]
    phi = np.concatenate(kernels).astype(np.float64) @ root
    # rows of each language weigh the same; targets are 1 and 0
    weight = 1 / np.bincount(lang)[lang]
    y = (lang[:, None] == np.arange(len(languages))).astype(np.float64)
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
    ridge = np.linalg.solve(gram, phi.T @ (y * weight[:, None]))
    return KernelModel(languages, np.ascontiguousarray(z.T), (root @ ridge).astype(np.float32))


def in_fold(id_col: str, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, model: KernelModel, text_col: str = "text", lang_name: str = "lang_pred",
             score_name: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1 (the share of the best among positive outputs)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)     # at most LANGUAGES x LANDMARKS x DIMENSIONS floats

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        out = m.scores(list(texts))
        known = ~np.isnan(out[:, 0])
        positive = np.maximum(np.nan_to_num(out), 0)
        total = positive.sum(axis=1)
        best = positive.argmax(axis=1)
        score = np.where(total > 0, positive.max(axis=1) / np.where(total > 0, total, 1), 0.0)
        names = np.array([*m.languages, UNKNOWN], object)
        return pd.DataFrame({"lang": names[np.where(known, best, -1)], "score": np.where(known, score, 0.0)})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_name, score_name)]
    return (docs.select(F.struct(*kept).alias("_row"), predict(F.col(text_col)).alias("_said"))
            .select("_row.*", F.col("_said.lang").alias(lang_name), F.col("_said.score").alias(score_name)))
