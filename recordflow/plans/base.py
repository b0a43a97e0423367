"""Table access and shared inputs of the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.operators.mapping import Rule
from recordflow.operators.schema import target


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Wide rules over orders.
WIDE_RULES = [
    Rule("order_id", "o_orderkey", kind="int"),
    Rule("status", "o_orderstatus", "Finished", ("F",), kind="enum"),
    Rule("status", "o_orderstatus", "Open", ("O", "P"), kind="enum"),
    Rule("priority", "o_orderpriority", "1-URGENT", kind="enum"),
    Rule("priority", "o_orderpriority", "2-HIGH", kind="enum"),
    Rule("priority", "o_orderpriority", "3-MEDIUM", kind="enum"),
    Rule("priority", "o_orderpriority", "4-NOT SPECIFIED", kind="enum"),
    Rule("priority", "o_orderpriority", "5-LOW", kind="enum"),
    Rule("is_urgent", "o_orderpriority", "True", ("1-URGENT", "2-HIGH"), kind="bool"),
    Rule("is_urgent", "o_orderpriority", "False", ("4-NOT SPECIFIED", "5-LOW"), kind="bool"),
    Rule("amounts::total", "o_totalprice", method="first", kind="float"),
    Rule("amounts::customer", "o_custkey", kind="int"),
    Rule("tags", "o_orderstatus", method="collect_all", kind="list[str]"),
    Rule("tags", "o_orderpriority", method="collect_all", kind="list[str]"),
    Rule("note", "o_orderpriority", method="join_semicolon"),
    Rule("note", "o_orderstatus", method="join_semicolon"),
    Rule("missing", "no_such_column"),
]

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

WIDE_SCHEMA = T.StructType([
    target("order_id", "int", required=True),
    target("status", "str", options=["Finished", "Open"], enum="Status"),
    target("priority", "str", required=True, options=PRIORITIES, enum="Priority"),
    target("is_urgent", "bool"),
    target("amounts", T.StructType([
        target("total", "float", required=True),
        target("customer", "int"),
    ])),
    target("tags", "str", many=True),
    target("note", "str"),
    target("missing", "str"),
])

# As above, but the urgency must be known and the order id must be text.
STRICT_WIDE_SCHEMA = T.StructType([
    target("order_id", "str", required=True),
    target("status", "str", options=["Open"], enum="OpenOnly"),
    target("is_urgent", "bool", required=True),
    target("amounts", T.StructType([target("total", "int", required=True)])),
    target("note", "str", required=True),
    target("reviewer", "str", required=True),
])

# Urgency must be known and only open orders are accepted.
QUARANTINE_SCHEMA = T.StructType([
    target("order_id", "int", required=True),
    target("status", "str", options=["Open"], enum="OpenOnly"),
    target("is_urgent", "bool", required=True),
    target("amounts", T.StructType([target("total", "float", required=True)])),
    target("note", "str", required=True),
])

# Long rules over events; the value is the text of props.k.
LONG_RULES = [
    Rule("first_view", "view", method="first", kind="int"),
    Rule("purchases", "purchase", method="collect_all", kind="list[int]"),
    Rule("signups", "signup", method="join_semicolon"),
    Rule("clicks", "click", kind="list[str]"),
    Rule("error::level", "error", "Low", ("0", "1", "2", "3"), "first", "enum"),
    Rule("error::level", "error", "High", ("96", "97", "98", "99"), "first", "enum"),
    Rule("error::any", "error", "True", kind="bool"),
    Rule("mixed", "view"),
    Rule("mixed", "signup"),
    Rule("blank", ""),
]

LONG_SCHEMA = T.StructType([
    target("user_id", "int", required=True),
    target("first_view", "int", required=True),
    target("purchases", "int", many=True),
    target("signups", "str"),
    target("clicks", "str", many=True),
    target("error", T.StructType([
        target("level", "str", required=True, options=["Low", "High"], enum="Level"),
        target("any", "bool"),
    ])),
])


# Sign-ups must be one number and errors low.
STRICT_LONG_SCHEMA = T.StructType([
    target("user_id", "int", required=True),
    target("first_view", "int", required=True),
    target("signups", "int"),
    target("purchases", "int", many=True),
    target("error", T.StructType([target("level", "str", options=["Low"], enum="LowOnly")])),
])

# Few clicks are wrong, so that a record's only error may be in a late part.
PARTS_SCHEMA = T.StructType([
    target("user_id", "int", required=True),
    target("clicks", "str", many=True, options=[str(n) for n in range(96)], enum="Click"),
    target("purchases", "int", many=True),
])

# Lists of records, three levels deep.
VISIT = T.StructType([
    target("code", "str", required=True, options=["F", "O", "Open"], enum="Code"),
    T.StructField("drugs", T.ArrayType(T.StructType([
        target("name", "str", required=True),
        T.StructField("doses", T.ArrayType(T.StructType([target("mg", "int", required=True)]))),
    ]))),
])

VISITS_SCHEMA = T.StructType([target("order_id", "int", required=True), T.StructField("visits", T.ArrayType(VISIT), False)])


def long_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (user_id, event_type, k, event_id): the observation value is the text of props.k."""
    return table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "event_id"
    )
