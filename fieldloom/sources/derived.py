"""Domain tables derived from the star-schema test tables.

Every table is computed over the whole of its source. The SQL text holds for
Spark and DuckDB alike (see ``dialect``), so both engines start from the same
rows and the operators on top of them are what a comparison tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.skew import Running, Timeline
from fieldloom.sources import tables

VIEWS = {
    "users": """
        SELECT c_custkey AS user_id,
          lower(replace(c_name, '#', '.')) || '@example.com' AS email,
          'digest' || CAST(c_custkey AS VARCHAR(12)) AS password_hash,
          CASE WHEN c_custkey % 20 = 0 THEN 'BANNED' WHEN c_custkey % 10 = 0 THEN 'INACTIVE'
               ELSE 'ACTIVE' END AS status,
          NTZ '2020-01-01 00:00:00' AS created_at,
          NTZ '2020-01-01 00:00:00' AS updated_at
        FROM customer""",
    "activation_codes": """
        SELECT p_partkey AS code_id,
          'CODE' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0') AS code,
          p_size AS total_uses,
          CAST(p_partkey % 7 AS INT) AS used_count,
          CASE WHEN p_partkey % 11 = 0 THEN 'USED' ELSE 'ACTIVE' END AS status,
          CASE WHEN p_partkey % 4 = 0 THEN NULL
               ELSE NTZ '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(p_partkey AS INT)
          END AS expires_at
        FROM part""",
    "redeem_requests": """
        SELECT o_orderkey AS request_id, o_custkey % 50 AS user_id,
          CASE WHEN o_orderkey % 17 = 0 THEN 'NONE' ELSE 'CODE' END ||
            lpad(CAST(o_orderkey * 7 % 260 AS VARCHAR(12)), 12, '0') AS code,
          o_orderdate AS requested_at
        FROM orders""",
    "user_activations": """
        SELECT o_orderkey AS activation_id, o_custkey AS user_id, o_orderkey * 7 % 200 AS code_id,
          CAST(o_orderkey % 6 AS INT) AS remaining_uses, o_orderdate AS activated_at
        FROM orders""",
    "usage_logs": """
        SELECT event_id AS log_id, user_id,
          'https://site' || CAST(event_id % 37 AS VARCHAR(12)) || '.example.com/apply' AS website_url,
          CAST(1 + event_id % 20 AS INT) AS fields_count,
          CAST(floor(event_id / 20) % (2 + event_id % 20) AS INT) AS success_count,
          ts AS used_at
        FROM events""",
    "resumes": """
        SELECT doc_id AS resume_id, doc_id % 150 AS user_id,
          CASE WHEN doc_id % 9 = 0 THEN NULL
               ELSE lang || ' resume ' || CAST(doc_id AS VARCHAR(12)) END AS title,
          CASE WHEN doc_id % 13 = 0 THEN '{}' ELSE
            '{"name":"User ' || CAST(doc_id AS VARCHAR(12)) || '","email":"u' ||
            CAST(doc_id AS VARCHAR(12)) || '@example.com","work_years":"' ||
            CAST(n_chars % 15 AS VARCHAR(12)) || '","programming_languages":"' || lang ||
            '","hobby":"' || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END || '"}' END AS fields,
          n_chars AS updated_seq
        FROM documents""",
    "legacy_resumes": """
        SELECT doc_id AS resume_id, doc_id % 150 AS user_id,
          '{"name":"User ' || CAST(doc_id AS VARCHAR(12)) || '","lang":"' || lang || '"}' AS personal_info,
          CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '{"degree":"' || source || '"}' END AS education,
          CASE WHEN doc_id % 5 = 0 THEN '{}'
               ELSE '{"work_years":"' || CAST(n_chars % 15 AS VARCHAR(12)) || '"}' END AS experience,
          CASE WHEN doc_id % 3 = 0 THEN '{"lang":"skill ' || lang || '"}' ELSE '{}' END AS skills
        FROM documents""",
    "model_outputs": """
        SELECT conv_id * 100 + turn AS request_id,
          CASE WHEN (conv_id + turn) % 9 = 8 THEN 500 ELSE 200 END AS status_code,
          CASE (conv_id + turn) % 5
            WHEN 0 THEN 'no array here'
            WHEN 1 THEN '[{"field_name":"a","field_type":"text","matched_value":"x"}]'
            WHEN 2 THEN 'Sure: [{"field_name":"a","matched_value":3},{"field_name":"b","matched_value":""},7] done'
            WHEN 3 THEN '[1] and [2]'
            ELSE '[{"field_name":"c","matched_value":"v]"},{}]' END AS output_text
        FROM conversations""",
    "match_requests": """
        SELECT o_orderkey AS request_id,
          CASE WHEN o_orderkey % 10 = 9 THEN o_custkey ELSE o_orderkey * 7 % 1100 % 150 END AS user_id,
          o_orderkey * 7 % 1100 AS resume_id,
          CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
            ELSE 'https://jobs' || CAST(o_orderkey % 37 AS VARCHAR(12)) || '.example.com' END AS website_url,
          o_orderdate AS requested_at
        FROM orders""",
    "match_answers": """
        SELECT o_orderkey AS request_id,
          CASE WHEN o_orderkey % 19 = 18 THEN 500 ELSE 200 END AS status_code,
          CASE WHEN o_orderkey % 23 = 1 THEN 'nothing found'
            WHEN o_orderkey % 23 = 2 THEN '[{"field_name": }]'
            WHEN o_orderkey % 3 = 0 THEN '[{"field_name":"field_1","matched_value":"v' ||
              CAST(o_orderkey AS VARCHAR(12)) || '"},{"field_name":"field_2","matched_value":""}]'
            WHEN o_orderkey % 3 = 1 THEN 'Answer: [{"field_name":"field_3","field_type":"email","matched_value":"a"}] end'
            ELSE '[]' END AS output_text
        FROM orders""",
    "registrations": """
        SELECT o_orderkey AS request_id,
          CASE WHEN o_orderkey % 3 = 0
               THEN 'customer.' || lpad(CAST(o_custkey AS VARCHAR(12)), 9, '0')
               ELSE 'applicant.' || CAST(o_orderkey * 7 % 4001 AS VARCHAR(12)) END || '@example.com' AS email,
          'digest' || CAST(o_orderkey AS VARCHAR(12)) AS password_hash,
          o_orderdate AS requested_at
        FROM orders""",
    "user_patches": """
        SELECT o_orderkey AS request_id, o_custkey AS user_id,
          o_orderkey % 4 = 0 AS has_email,
          CASE WHEN o_orderkey % 8 = 0
               THEN 'customer.' || lpad(CAST(o_orderkey % 500 AS VARCHAR(12)), 9, '0')
               ELSE 'moved.' || CAST(o_orderkey * 7 % 2003 AS VARCHAR(12)) END || '@example.com' AS email,
          o_orderkey % 3 = 0 AS has_password,
          'newdigest' || CAST(o_orderkey AS VARCHAR(12)) AS password_hash,
          o_orderdate AS requested_at
        FROM orders""",
    "deactivations": """
        SELECT o_orderkey AS request_id, o_custkey * 3 AS user_id, o_orderdate AS requested_at
        FROM orders""",
    "resume_requests": """
        SELECT o_orderkey AS request_id, o_orderkey * 7 % 1100 AS resume_id,
          CASE WHEN o_orderkey % 10 = 9 THEN o_custkey ELSE o_orderkey * 7 % 1100 % 150 END AS user_id,
          o_orderkey % 2 = 0 AS has_title,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL
               ELSE 'title ' || CAST(o_orderkey AS VARCHAR(12)) END AS title,
          o_orderkey % 3 = 0 AS has_fields,
          '{"name":"Request ' || CAST(o_orderkey AS VARCHAR(12)) || '","goal":"' || o_orderpriority || '"}' AS fields,
          o_orderdate AS requested_at
        FROM orders""",
    "field_edits": """
        SELECT o_orderkey AS request_id, o_orderkey * 7 % 1100 AS resume_id,
          CASE WHEN o_orderkey % 10 = 9 THEN o_custkey ELSE o_orderkey * 7 % 1100 % 150 END AS user_id,
          CASE WHEN o_orderkey % 13 = 5 THEN '{}'
               WHEN o_orderkey % 3 = 0 THEN '{"hobby":"h' || CAST(o_orderkey AS VARCHAR(12)) || '"}'
               ELSE '{"skills":"s' || CAST(o_orderkey AS VARCHAR(12)) || '","name":"n' ||
                 CAST(o_orderkey % 100 AS VARCHAR(12)) || '"}' END AS patch,
          CASE o_orderkey % 4 WHEN 0 THEN 'hobby' WHEN 1 THEN 'email' WHEN 2 THEN 'skills' ELSE 'absent' END AS field_key,
          o_orderdate AS requested_at
        FROM orders""",
    # emails that are not customers' come twice
    "seed_users": """
        SELECT 1000000000 + s_suppkey AS user_id,
          CASE WHEN s_suppkey % 2 = 0
               THEN 'customer.' || lpad(CAST(s_suppkey AS VARCHAR(12)), 9, '0')
               ELSE 'supplier.' || CAST(s_suppkey - s_suppkey % 4 AS VARCHAR(12)) END || '@example.com' AS email,
          'digest' AS password_hash, 'ACTIVE' AS status,
          NTZ '2024-01-01 00:00:00' AS created_at,
          NTZ '2024-01-01 00:00:00' AS updated_at
        FROM supplier""",
    "code_batches": """
        SELECT p_partkey AS batch_id,
          CAST(CASE WHEN p_partkey % 10 = 0 THEN 101 ELSE p_size % 10 END AS INT) AS n_codes,
          p_size AS total_uses, CAST(30 + p_partkey % 300 AS INT) AS expires_in_days
        FROM part""",
}

# Documents as they are stored: a part of them is plain text instead of a JSON object.
VIEWS["stored_resumes"] = VIEWS["resumes"].replace(
    "CASE WHEN doc_id % 13 = 0 THEN '{}'", "CASE WHEN doc_id % 17 = 3 THEN text WHEN doc_id % 13 = 0 THEN '{}'")

# The line order within one order; (l_orderkey, l_linenumber) alone has ties.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

# Tables that need a position within the order; DuckDB text, Spark form below.
LINE_VIEWS = {
    "form_fields": f"""
        SELECT l_orderkey AS request_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS pos,
          CASE WHEN l_partkey % 97 = 0 THEN ' ' ELSE 'field_' || CAST(l_partkey % 40 AS VARCHAR(12)) END AS name,
          CASE l_suppkey % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'select' WHEN 2 THEN 'date' WHEN 3 THEN 'email'
            WHEN 4 THEN 'tel' WHEN 5 THEN 'month' WHEN 6 THEN 'radio'
            ELSE CASE WHEN l_partkey % 31 = 0 THEN 'color' ELSE 'url' END END AS type,
          CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Label ' || CAST(l_suppkey AS VARCHAR(12)) END AS label,
          CASE WHEN l_partkey % 4 = 0 THEN 'enter ' || CAST(l_suppkey AS VARCHAR(12)) ELSE NULL END AS placeholder,
          CASE WHEN l_suppkey % 8 = 1 AND l_partkey % 5 > 0 THEN 3 ELSE 0 END AS n_options
        FROM lineitem""",
    "quota_uses": f"""
        SELECT l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey
            ORDER BY {", ".join(LINE_ORDER)}) AS use_id,
          l_partkey * 7 % 1500 AS user_id, l_shipdate AS used_at
        FROM lineitem""",
}


def dialect(text: str, engine: str) -> str:
    return text.replace("NTZ '", "TIMESTAMP_NTZ '" if engine == "spark" else "TIMESTAMP '")


# Declared, so that no job reads footers to find them out.
STAR_SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
}


def _star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet", STAR_SCHEMAS[name])


def _select(spark: SparkSession, name: str, source_rows: Callable[[str], DataFrame]) -> DataFrame:
    """A definition's SQL over the given rows of its source; its JSON braces are plain text."""
    text = dialect(VIEWS[name], "spark")
    source = text.split()[-1]
    text = text.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {rows}")
    return spark.sql(text, rows=source_rows(source))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as raw rows."""
    if name in LINE_VIEWS:
        return {"form_fields": form_fields, "quota_uses": quota_uses}[name](spark, sf_dir)
    return _select(spark, name, lambda source: _star(spark, sf_dir, source))


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _star(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", *[c for c in LINE_ORDER if c != "l_suppkey"])
    return Timeline(lines, ["l_orderkey"], list(LINE_ORDER)).running(Running("pos", F.sum, F.lit(1))).rows()


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_lines(spark, sf_dir).selectExpr(
        "l_orderkey AS request_id", "CAST(pos AS INT) AS pos",
        "CASE WHEN l_partkey % 97 = 0 THEN ' ' ELSE 'field_' || l_partkey % 40 END AS name",
        "CASE WHEN l_suppkey % 8 < 7 THEN "
        "elt(1 + l_suppkey % 8, 'text', 'select', 'date', 'email', 'tel', 'month', 'radio') "
        "WHEN l_partkey % 31 = 0 THEN 'color' ELSE 'url' END AS type",
        "CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Label ' || l_suppkey END AS label",
        "CASE WHEN l_partkey % 4 = 0 THEN 'enter ' || l_suppkey END AS placeholder",
        "CASE WHEN l_suppkey % 8 = 1 AND l_partkey % 5 > 0 "
        "THEN array('it''s 1', 'option 2', 'option 3') END AS options",
    )


def quota_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_lines(spark, sf_dir).selectExpr(
        "l_orderkey * 1000000 + pos AS use_id", "l_partkey * 7 % 1500 AS user_id", "l_shipdate AS used_at")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.users(view(spark, sf_dir, "users"))


def activation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.activation_codes(view(spark, sf_dir, "activation_codes"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.resumes(view(spark, sf_dir, "resumes"))


def user_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.user_activations(view(spark, sf_dir, "user_activations"))


def usage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.usage_logs(view(spark, sf_dir, "usage_logs"))


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a stream over its source: a file, or a folder of files.

    A stream takes a single file only by a pattern, so the path is one that matches itself.
    """
    return _select(spark, name, lambda source: tables.stream_table(
        spark, f"{sf_dir}/{source}.parque[t]", STAR_SCHEMAS[source]))
