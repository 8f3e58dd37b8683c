"""The queries of this package and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from fieldloom.llm.conversations import damaged, repair_digests
from fieldloom.llm.decontaminate import contamination
from fieldloom.llm.exact_dedup import digest_verdicts
from fieldloom.llm.langid import identify, in_fold, train
from fieldloom.llm.line_dedup import line_dedup
from fieldloom.llm.materialize import training_order
from fieldloom.llm.near_dedup import near_duplicates
from fieldloom.llm.packing import pack
from fieldloom.llm.phrases import collocations
from fieldloom.llm.pii import BASE_KINDS, masked_counts, personal_spans, span_list
from fieldloom.llm.quality import COUNTS, judge
from fieldloom.llm.quality import train as train_quality
from fieldloom.llm.sharding import byte_shards
from fieldloom.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = digest_verdicts(_table(spark, sf_dir, "documents"), keep="largest")
    return verdicts.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                           F.lower(F.hex("digest")).alias("text_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = near_duplicates(_table(spark, sf_dir, "documents"), width=4)
    return verdicts.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                           F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = byte_shards(_table(spark, sf_dir, "documents"), n_shards=40)
    return sharded.select(
        "doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return verdicts.withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), keep_ids=False)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
                         "sequence_id", "offset", "source", "window")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "dropped", "kept_in",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(_table(spark, sf_dir, "documents"))
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select(
        F.col("id").alias("doc_id"), *[masked_counts(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(every).alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id")
    model = train(docs.filter(~held_out), "doc_id", "text", "lang")
    return (identify(docs.select("doc_id", "text"), model)
            .select("doc_id", in_fold("doc_id").alias("held_out"), "lang_pred", "score"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(_table(spark, sf_dir, "documents"), key=2024).withColumnRenamed("id", "doc_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), model).select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair_digests(damaged(conversations), conversations)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents")).withColumnRenamed("group", "lang")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_language_id": op9_language_id,
    "op10_training_order": op10_training_order,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_AZ}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> f THEN f END AS refers_to FROM f""",
    "op13_phrases": f"""
        WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
               SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_AZ}, '[.,;:!?\x0A-\x0D]')) AS piece
               FROM documents)),
             n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
             f AS (SELECT lang, m, phrase, count(*) AS f FROM (
               SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
               FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest(range(1, 6)) AS m)
               WHERE i + m - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= 100),
             c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1),
             cuts AS (SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r, n.n,
                 CAST(CAST(1000 AS HUGEINT) * c.a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
               FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
               JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:k], ' ')
               JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(words[k + 1:], ' ') JOIN n ON n.lang = c.lang),
             lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             held AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c x
               ON x.lang = s.lang AND x.m > s.m AND 100 * x.a >= 100 * s.a
               AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' '))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score
        FROM lowest ANTI JOIN held USING (lang, phrase)
        QUALIFY rank <= 2000""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
