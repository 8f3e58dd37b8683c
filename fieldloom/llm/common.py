"""What the operators of this package share: shipping code, work tables, running totals."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.session import configure, work_dir

# bounds on an Arrow batch, so that a Python worker never holds more than a few long texts
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and send this library to the Python workers."""
    configure(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Add the package as a zip file, once per context; its name tells its content."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if top.endswith(".zip/fieldloom"):
        return
    found, digest = [], hashlib.sha256()
    for folder, _, names in sorted(os.walk(top)):
        for name in sorted(names):
            if name.endswith(".py"):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    data = f.read()
                inside = os.path.relpath(path, os.path.dirname(top))
                digest.update(inside.encode() + b"\0" + data)
                found.append((inside, data))
    name = f"fieldloom-{digest.hexdigest()[:16]}.zip"
    if any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for inside, data in found:
            z.writestr(zipfile.ZipInfo(inside), data)
    spark.sparkContext.addPyFile(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage, fixes every value that depends on where a row was
    computed, and lets later steps read only the columns they need.
    """
    path = work_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a unique long per row. Only fixed once the result is stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def private(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the given columns, so that no other column of the input can clash."""
    return df.select(*[value.alias(name) for name, value in columns.items()])


def running_total(df: DataFrame, order: list[str], value: str, name: str, label: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one in ``order``.

    ``order`` must be a total order. The rows are dealt into ordered ranges, so
    equal leading columns (one hot source) spread over many tasks; a range adds
    the totals of the ranges before it, of which there are as many as tasks.
    """
    spark = df.sparkSession
    block, before = "_range", "_before"
    ranged = stored(
        df.repartitionByRange(partitions(spark), *order).withColumn(block, F.spark_partition_id()), label)
    sums = ranged.groupBy(block).agg(F.sum(value).alias("_sum"))
    carried = sums.select(block, F.coalesce(F.sum("_sum").over(
        Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # one row per task, so broadcasting it does not depend on the data
    return (summed.join(F.broadcast(carried), block)
            .withColumn(name, F.col(name) + F.col(before)).drop(block, before))


def retain(docs: DataFrame, id_col: str, text_col: str, keepers: DataFrame) -> DataFrame:
    """The rows of docs named by keepers(_id, _text_key), with all columns of docs.

    A row is known by its id and xxhash64 of its text. Rows that repeat both
    are one document, of which one row stays (which one is not defined: they
    differ at most in other columns). A null id or text equals itself.
    """
    columns = docs.columns
    packed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_key"),
                         F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    repeated = (packed.groupBy("_id", "_text_key").count().filter("count > 1")
                .select(F.col("_id").alias("_rid"), F.col("_text_key").alias("_rkey")))
    keys = keepers.select("_id", "_text_key").distinct().join(
        repeated, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_text_key") == F.col("_rkey")), "left",
    ).select(F.col("_id").alias("_kid"), F.col("_text_key").alias("_kkey"), F.col("_rkey").isNotNull().alias("_again"))
    kept = packed.join(keys, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_text_key") == F.col("_kkey")))
    once = kept.filter(~F.col("_again"))
    again = kept.filter("_again").dropDuplicates(["_id", "_text_key"])
    return once.unionByName(again).select("_row.*")
