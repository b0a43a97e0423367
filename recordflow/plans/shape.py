"""Queries of flattening and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators import flatten as f
from recordflow.operators import profiling as p
from recordflow.plans.base import long_source, table
from recordflow.runtime import spread

_PATHS = [
    "name", "address::nation", "address::segment", "skills::0", "skills::1", "none",
    "deep::a::0::b", "deep::a::1::b::0", "flag",
]


def customer_json(spark, sf_dir):
    """A nested document per customer: objects, lists, empty containers and nulls."""
    text = F.concat(
        F.lit('{"name":"'), F.col("c_name"), F.lit('","address":{"nation":'), F.col("c_nationkey").cast("string"),
        F.lit(',"segment":"'), F.col("c_mktsegment"), F.lit('"},"skills":["s'), (F.col("c_custkey") % 7).cast("string"),
        F.lit('"'), F.when(F.col("c_custkey") % 2 == 0, F.lit(',"x"')).otherwise(F.lit("")),
        F.lit('],"empty":{},"nothing":[],"none":null,"deep":{"a":[{"b":'), F.col("c_custkey").cast("string"),
        F.lit('},{"b":[true]}]}'),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(',"flag":false')).otherwise(F.lit("")), F.lit("}"),
    )
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    return customer.select("c_custkey", text.alias("doc"))


def q_flatten_struct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nested = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey",
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").cast("bigint").alias("nation")).alias("place")).alias("customer"),
            F.col("o_totalprice").alias("total"),
        ).alias("record"),
    )
    return f.flatten_struct(nested, "record")


def q_flatten_paths(spark, sf_dir):
    return f.flatten_paths(customer_json(spark, sf_dir), "doc", ["c_custkey"])


def written_json(spark, sf_dir):
    """Numbers in several notations, NaN and Infinity, repeated keys, quotes in keys and in text."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit('{"n":'), key, F.lit('.50,"e":'), key, F.lit('e2,"k":1,"k":'), key, F.lit(',"odd":[NaN,-Infinity],"a\'b":"say \\"'), key,
        F.lit('\\" 1.0","both\\"\'":-0.0}'))
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.concat(text, F.lit("1"))).otherwise(text).alias("doc"))


def q_flatten_as_written(spark, sf_dir):
    return f.flatten_paths(written_json(spark, sf_dir), "doc", ["c_custkey"])


def q_flatten_groups(spark, sf_dir):
    """A path per customer and part of a name, put together from groups of columns."""
    docs = written_json(spark, sf_dir)
    first, second = f.flatten_groups(docs, "doc", ["c_custkey"], width=4)
    return first.join(second.drop("c_custkey"), "row_number").drop("row_number")


def q_union_paths(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    wide = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select(
        F.concat(F.lit('{"k'), key, F.lit('":{"'), F.lit("a'"), F.col("c_mktsegment"), F.lit('":null,"n":[1.0,2]},"same":1}')).alias("doc"))
    return f.union_paths(wide, "doc")


def q_flatten_wide(spark, sf_dir):
    return f.flatten_wide(customer_json(spark, sf_dir), "doc", ["c_custkey"], _PATHS)


def _profiled(spark, sf_dir):
    source = table(spark, sf_dir, "customer").withColumn(
        "segment_or_null", F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment"))
    )
    return p.profile_wide(source, "c_custkey")


def q_profile_wide(spark, sf_dir):
    return _profiled(spark, sf_dir)


def q_profile_long(spark, sf_dir):
    return p.profile_long(long_source(spark, sf_dir), "event_type", "k", "event_id")


def q_profile_text(spark, sf_dir):
    return p.profile_text(q_profile_long(spark, sf_dir))


QUERIES = {
    "flatten_struct": q_flatten_struct,
    "flatten_paths": q_flatten_paths,
    "flatten_as_written": q_flatten_as_written,
    "flatten_groups": q_flatten_groups,
    "union_paths": q_union_paths,
    "flatten_wide": q_flatten_wide,
    "profile_wide": q_profile_wide,
    "profile_long": q_profile_long,
    "profile_text": q_profile_text,
}


def _profile_sql(rows: str, key: str) -> str:
    return f"""
      rows AS ({rows}),
      firsts AS (SELECT {key}, value, min(place) AS place FROM rows GROUP BY {key}, value),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY place) AS n FROM firsts),
      uniq AS (SELECT {key}, CAST(to_json(list(value ORDER BY place)) AS VARCHAR) AS unique_values FROM ranked WHERE n <= 10 GROUP BY {key}),
      heads AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY place) AS n FROM rows),
      samp AS (SELECT {key}, CAST(to_json(list(value ORDER BY place)) AS VARCHAR) AS sample FROM heads WHERE n <= 3 GROUP BY {key})"""


_LONG = _profile_sql(
    "SELECT event_type AS observation, json_extract_string(props, '$.k') AS value, event_id AS place FROM events", "observation"
) + """,
      named AS (SELECT observation, CAST(row_number() OVER (ORDER BY min(place)) AS BIGINT) AS position FROM rows GROUP BY observation),
      prof AS (SELECT position, observation, 'string' AS type, unique_values, sample
               FROM uniq JOIN samp USING (observation) JOIN named USING (observation))"""

_WIDE_COLUMNS = [
    ("c_custkey", "bigint", "CAST(c_custkey AS VARCHAR)"), ("c_name", "string", "c_name"),
    ("c_nationkey", "int", "CAST(c_nationkey AS VARCHAR)"), ("c_acctbal", "double", "CAST(c_acctbal AS VARCHAR)"),
    ("c_mktsegment", "string", "c_mktsegment"),
    ("segment_or_null", "string", "CASE WHEN c_nationkey > 3 THEN c_mktsegment END"),
]

_WIDE_ROWS = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, {expr} AS value, c_custkey AS place FROM customer"
    for i, (_, _, expr) in enumerate(_WIDE_COLUMNS, 1)
)
_WIDE_INFO = ", ".join(f"({i}, '{name}', '{kind}')" for i, (name, kind, _) in enumerate(_WIDE_COLUMNS, 1))

ORACLE = {
    "flatten_as_written": """
      SELECT c_custkey, unnest(['n', 'e', 'k', 'odd::0', 'odd::1', 'a' || chr(39) || 'b', 'both"' || chr(39)]) AS path,
        unnest([c_custkey || '.50', c_custkey || 'e2', c_custkey::VARCHAR, 'NaN', '-Infinity', 'say "' || c_custkey || '" 1.0', '-0.0']) AS value
      FROM customer WHERE c_custkey % 10 <> 0""",
    "flatten_groups": """
      SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey || '.50' END AS n, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey || 'e2' END AS e,
        CASE WHEN c_custkey % 10 <> 0 THEN c_custkey::VARCHAR END AS k, CASE WHEN c_custkey % 10 <> 0 THEN 'NaN' END AS "odd::0",
        CASE WHEN c_custkey % 10 <> 0 THEN '-Infinity' END AS "odd::1", CASE WHEN c_custkey % 10 <> 0 THEN 'say "' || c_custkey || '" 1.0' END AS "a'b",
        CASE WHEN c_custkey % 10 <> 0 THEN '-0.0' END AS "both""'"
      FROM customer""",
    "union_paths": """
      SELECT 'same' AS path, count(*) AS n_rows, 0::BIGINT AS n_null FROM customer
      UNION ALL SELECT 'k' || c_custkey || '::a' || chr(39) || c_mktsegment, count(*), count(*) FROM customer GROUP BY ALL
      UNION ALL SELECT 'k' || c_custkey || '::n::' || i, count(*), 0 FROM customer, range(2) AS r(i) GROUP BY ALL""",
    "flatten_struct": """
      SELECT o_orderkey, o_orderstatus AS status, c_name AS "customer::name",
             CAST(c_nationkey AS BIGINT) AS "customer::place::nation", o_totalprice AS total
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "flatten_paths": """
      SELECT c_custkey, 'name' AS path, c_name AS value FROM customer
      UNION ALL SELECT c_custkey, 'address::nation', CAST(c_nationkey AS VARCHAR) FROM customer
      UNION ALL SELECT c_custkey, 'address::segment', c_mktsegment FROM customer
      UNION ALL SELECT c_custkey, 'skills::0', 's' || (c_custkey % 7) FROM customer
      UNION ALL SELECT c_custkey, 'skills::1', 'x' FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT c_custkey, 'none', NULL FROM customer
      UNION ALL SELECT c_custkey, 'deep::a::0::b', CAST(c_custkey AS VARCHAR) FROM customer
      UNION ALL SELECT c_custkey, 'deep::a::1::b::0', 'true' FROM customer
      UNION ALL SELECT c_custkey, 'flag', 'false' FROM customer WHERE c_custkey % 3 = 0""",
    "flatten_wide": """
      SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS "address::nation", c_mktsegment AS "address::segment",
             's' || (c_custkey % 7) AS "skills::0", CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS "skills::1",
             CAST(NULL AS VARCHAR) AS none, CAST(c_custkey AS VARCHAR) AS "deep::a::0::b", 'true' AS "deep::a::1::b::0",
             CASE WHEN c_custkey % 3 = 0 THEN 'false' END AS flag
      FROM customer""",
    "profile_wide": f"""
      WITH {_profile_sql(_WIDE_ROWS, "position")}
      SELECT position, i.name AS "column", i.kind AS type, unique_values, sample
      FROM uniq JOIN samp USING (position) JOIN (VALUES {_WIDE_INFO}) AS i(pos, name, kind) ON i.pos = position""",
    "profile_long": f"WITH {_LONG} SELECT * FROM prof",
    "profile_text": f"""
      WITH {_LONG}
      SELECT CAST(0 AS BIGINT) AS part, string_agg(position || '. Observation: ' || observation || chr(10) || 'Value type: ' || type || chr(10)
        || 'Unique values: ' || unique_values || chr(10) || 'Sample: ' || sample || chr(10), chr(10) || '---' || chr(10) ORDER BY position) AS text
      FROM prof""",
}
