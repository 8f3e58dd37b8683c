"""Readers, conforming projections and sinks for the domain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import schemas
from fieldloom.functions.documents import parse_document
from fieldloom.operators.skew import first_rows


def read_table(spark: SparkSession, path: str | None = None, schema: T.StructType | str | None = None,
               format: str = "parquet", **options: str) -> DataFrame:
    """One reader for files and, with ``format="jdbc"``, for a PostgreSQL table.

    A JDBC read takes ``url``, ``dbtable`` and, for a large table,
    ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``.
    """
    reader = spark.read.format(format).options(**options)
    if schema is not None and format != "jdbc":
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str,
                 format: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), format: str = "parquet") -> None:
    df.write.format(format).mode("append").partitionBy(*partition_by).save(path)


def write_version(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a whole next state to its own folder; a retry writes the same folder again."""
    df.write.format(format).mode("overwrite").save(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns that df has, in declared order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name in df.columns])


def enum_value(status: Column) -> Column:
    """Databases store the enum's NAME, code and requests use its value."""
    return F.lower(status)


def users(raw: DataFrame) -> DataFrame:
    """Users without the password digest."""
    return conform(raw.drop("password_hash"), schemas.USERS).withColumn("status", enum_value(F.col("status")))


def activation_codes(raw: DataFrame) -> DataFrame:
    return conform(raw, schemas.ACTIVATION_CODES).withColumn("status", enum_value(F.col("status")))


def resumes(raw: DataFrame) -> DataFrame:
    """Resumes with the JSON document parsed to a map; other columns pass through."""
    return raw.withColumn("fields", parse_document(F.col("fields")))


def user_activations(raw: DataFrame) -> DataFrame:
    return conform(raw, schemas.USER_ACTIVATIONS)


def usage_logs(raw: DataFrame) -> DataFrame:
    return conform(raw, schemas.USAGE_LOGS)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Existing rows plus the new rows whose natural key is not taken.

    Of new rows with one key the first in ``order`` is inserted; rows with a
    null key never conflict. Columns the new rows lack are null.
    """
    named = first_rows(new.filter(F.col(key).isNotNull()), [key], order)
    fresh = named.join(existing.select(key), key, "left_anti").select(*new.columns).unionByName(
        new.filter(F.col(key).isNull()))
    return existing.unionByName(fresh.select(*existing.columns))


def usage_log_rows(outcomes: DataFrame) -> DataFrame:
    """Log rows of successful match requests; a null or empty url is 'unknown'."""
    return outcomes.select(
        F.col("request_id").alias("log_id"), "user_id",
        F.coalesce(F.nullif(F.col("website_url"), F.lit("")), F.lit(schemas.UNKNOWN_URL)).alias("website_url"),
        F.col("total_fields").cast("int").alias("fields_count"),
        F.col("success_count").cast("int").alias("success_count"),
        F.col("requested_at").alias("used_at"),
    )
