"""Declared limits, foreign keys and cascades."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import schemas
from fieldloom.functions.documents import is_broken
from fieldloom.operators.skew import skew_join

# child table, foreign key, parent table, parent key
FOREIGN_KEYS = (
    ("resumes", "user_id", "users", "user_id"),
    ("user_activations", "user_id", "users", "user_id"),
    ("user_activations", "code_id", "activation_codes", "code_id"),
    ("usage_logs", "user_id", "users", "user_id"),
)

CHILD_IDS = {"resumes": "resume_id", "user_activations": "activation_id", "usage_logs": "log_id"}

_STATUSES = {"users": schemas.USER_STATUSES, "activation_codes": schemas.CODE_STATUSES}

_SCHEMAS = {
    "users": schemas.USERS, "activation_codes": schemas.ACTIVATION_CODES, "resumes": schemas.RESUMES,
    "user_activations": schemas.USER_ACTIVATIONS, "usage_logs": schemas.USAGE_LOGS,
}


def _rules(table: str, df: DataFrame) -> list[tuple[str, str, Column]]:
    rules = [(f.name, "not_null", F.col(f.name).isNull())
             for f in _SCHEMAS[table] if not f.nullable and f.name in df.columns]
    for (owner, column), limit in schemas.MAX_LENGTHS.items():
        if owner == table and column in df.columns:
            rules.append((column, f"max_length_{limit}", F.char_length(column) > limit))
    if table == "resumes" and "fields" in df.columns and df.schema["fields"].dataType == T.StringType():
        rules.append(("fields", "json_object", is_broken(F.col("fields"))))
    if table in _STATUSES:
        rules.append(("status", "in_domain", ~F.lower("status").isin(*_STATUSES[table])))
    return rules


def check_lengths(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations per declared rule: one pass and one row of counts per table, unpivoted."""
    reports = []
    for name, df in tables.items():
        rules = _rules(name, df)
        counts = df.agg(*[F.count_if(broken).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)])
        reports.append(counts.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
                     F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations"))
            for i, (column, rule, _) in enumerate(rules)]))))
    return reduce(DataFrame.unionByName, reports)


def check_rule(table: str, df: DataFrame, rule: str) -> DataFrame:
    """The report on one rule of a table: its broken rows are counted by column, and columns without any get 0."""
    rules = [(column, broken) for column, name, broken in _rules(table, df) if name == rule]
    columns = df.sparkSession.createDataFrame([(table, column, rule) for column, _ in rules],
                                              "table_name string, column_name string, rule string")
    broken = F.array(*[F.when(broken, F.lit(column)) for column, broken in rules])
    found = (df.select(F.explode(broken).alias("column_name")).filter("column_name is not null")
             .groupBy("column_name").agg(F.count(F.lit(1)).alias("violations")))
    return columns.join(F.broadcast(found), "column_name", "left").select(
        "table_name", "column_name", "rule", F.coalesce("violations", F.lit(0)).alias("violations"))


def fk_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per foreign key whose parent is missing.

    Children are counted per key first, so the anti join sees each key once.
    """
    reports = []
    for child, column, parent, key in FOREIGN_KEYS:
        per_key = (tables[child].filter(F.col(column).isNotNull())
                   .groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("n")))
        orphans = per_key.join(tables[parent].select(key), key, "left_anti")
        reports.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
            F.lit(child).alias("child_table"), F.lit(column).alias("fk_column"),
            F.lit(parent).alias("parent_table"), "orphans"))
    return reduce(DataFrame.unionByName, reports)


def cascade_delete(tables: Mapping[str, DataFrame], deleted_users: DataFrame | None = None,
                   deleted_codes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The children that survive deleting users and codes."""
    gone = {"users": deleted_users, "activation_codes": deleted_codes}
    survivors = {}
    for child, row_id in CHILD_IDS.items():
        df = tables[child]
        for owner, column, parent, key in FOREIGN_KEYS:
            if owner == child and gone[parent] is not None:
                keys = gone[parent].select(F.col(key).alias(column)).distinct()
                df = skew_join(df, keys, [column], "left_anti", [row_id])
        survivors[child] = df
    return survivors
