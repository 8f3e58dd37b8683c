"""Usage statistics and model answers over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import matching, stats
from fieldloom.streaming import runs
from fieldloom.streaming.state import StreamState


def _changes(changed: DataFrame, logs: DataFrame, folder: str, key: str) -> DataFrame:
    """Keep each batch's changed totals in a state log, and return the current ones."""
    spark, schema = logs.sparkSession, changed.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        state = StreamState(spark, folder, batch_id)
        state.log("totals", [key], schema).put(batch)
        state.commit()

    runs.each_batch(changed, folder, step, mode="update")
    return StreamState.latest(spark, folder).log("totals", [key], schema).read()


def stream_match_stats(logs: DataFrame, folder: str) -> DataFrame:
    """Running totals per user; each batch writes only the users it changed."""
    return stats.with_success_rate(_changes(stats.match_totals(logs), logs, folder, "user_id"))


def stream_daily_usage(logs: DataFrame, folder: str) -> DataFrame:
    """Usage per calendar day (UTC); each batch writes only the days it changed.

    A day stays open for late rows, so none is dropped. The state is one row
    per day, whatever the number of rows.
    """
    daily = logs.groupBy(F.col("used_at").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("total_uses"), F.sum("fields_count").alias("total_fields"),
        F.sum("success_count").alias("total_successes"))
    return _changes(daily, logs, folder, "day")


def stream_extract_matches(outputs: DataFrame, folder: str) -> DataFrame:
    """Valid matches of model outputs as they arrive."""
    matches = matching.match_rows(matching.read_answers(outputs))
    runs.to_files(matches, folder)
    # the schema is told, as there is no file when nothing matched
    return outputs.sparkSession.read.schema(matches.schema).parquet(f"{folder}/rows")
