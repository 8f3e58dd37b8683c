"""The corpus pipeline: documents in, packed training pieces out.

Each stage takes the documents its predecessor kept, as a Parquet table read
back, and calls one operator. All stages but the last return the columns of
documents. Special cases are those of the operators; a stage without input rows
returns none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import stored
from fieldloom.llm.decontaminate import decontaminate
from fieldloom.llm.exact_dedup import exact_dedup
from fieldloom.llm.langid import UNKNOWN, identify, in_fold, train
from fieldloom.llm.near_dedup import near_dedup
from fieldloom.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# SQL has no string kernels, sketches or tokenizer: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, or without text, go."""
    model = train(docs.filter(~in_fold("doc_id")), "doc_id", "text", "lang")
    said = identify(docs, model, lang_name="_pipeline_lang", score_name="_pipeline_score")
    return said.filter(F.col("_pipeline_lang") != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, equal up to the case of A-Z: the one with the largest doc_id."""
    return exact_dedup(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens with the sources' shares in every window."""
    return pack(docs, keep_ids=False).drop("ids").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("exact", exact), ("near", near), ("benchmarks", benchmarks), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
