"""Starting streams and the folders they keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that has arrived, then stop; a failure is raised here."""
    writer.trigger(availableNow=True).start().awaitTermination()


def to_files(stream: DataFrame, folder: str) -> None:
    """Append a stream to parquet files, exactly once."""
    run_available(stream.writeStream.format("parquet").outputMode("append")
                  .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint"))


def each_batch(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None],
               mode: str = "append") -> None:
    """Run step on every micro-batch.

    A batch may be run again after a failure, so step must write only folders
    named by its batch id and overwrite them. Streams plan without adaptive
    execution; what a step does is bulk work and gets it.
    """
    def bulk(batch: DataFrame, batch_id: int) -> None:
        conf = batch.sparkSession.conf
        before = conf.get("spark.sql.adaptive.enabled")
        conf.set("spark.sql.adaptive.enabled", "true")
        try:
            step(batch, batch_id)
        finally:
            conf.set("spark.sql.adaptive.enabled", before)

    run_available(stream.writeStream.outputMode(mode).foreachBatch(bulk)
                  .option("checkpointLocation", f"{folder}/checkpoint"))
