"""Queries of the mapping transforms, validation and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators import mapping as m
from recordflow.operators import validation as v
from recordflow.plans.base import (
    LONG_RULES, LONG_SCHEMA, PARTS_SCHEMA, QUARANTINE_SCHEMA, STRICT_LONG_SCHEMA, STRICT_WIDE_SCHEMA, VISITS_SCHEMA, WIDE_RULES, WIDE_SCHEMA,
    long_source, table,
)

LONG_ARGS = ("user_id", "event_type", "k", "event_id")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Values of a part in the queries, so few that the given ids take several parts.
SHORT_PARTS = 4


def rule_values(rules: list[m.Rule]) -> str:
    """The rules as a SQL VALUES list: rule_ord, field, name, target, slots."""
    rows = [
        f"({i}, {_text(r.field)}, {_text(r.column)}, {_text(r.value)}, [{', '.join(map(_text, r.slots))}]::VARCHAR[])"
        for i, r in enumerate(rules)
    ]
    return "(VALUES " + ", ".join(rows) + ") AS rule(rule_ord, field, name, target, slots)"


def long_cte(rules: list[m.Rule]) -> str:
    """SQL of the distinct long candidates with the place of their first occurrence."""
    return f"""
      WITH src AS (
        SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, event_id FROM events
      ), hit AS (
        SELECT s.user_id, r.field, r.rule_ord, s.event_id AS row_ord,
               CASE WHEN r.target = '' THEN s.k WHEN list_contains(r.slots, s.k) THEN r.target END AS value
        FROM src s JOIN {rule_values(rules)} AS r ON s.event_type = r.name
        WHERE r.name <> ''
      ), cand AS (
        SELECT user_id, field, value, rule_ord, row_ord FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, field, value ORDER BY rule_ord, row_ord) AS rn
          FROM hit WHERE value IS NOT NULL
        ) WHERE rn = 1
      )""".replace("AS rule(rule_ord, field, name, target, slots) AS r", "AS r(rule_ord, field, name, target, slots)")


def _cell(path: str, method: str) -> str:
    """SQL of one flat cell of the long form."""
    values = f"list(value ORDER BY rule_ord, row_ord) FILTER (field = {_text(path)})"
    if method == "first":
        return f"({values})[1]"
    several = f"array_to_string({values}, ';')" if method == "join_semicolon" else f"CAST(to_json({values}) AS VARCHAR)"
    return f"CASE WHEN len({values}) > 1 THEN {several} ELSE ({values})[1] END"


def flat_long_sql(rules: list[m.Rule], part_values: int = m.PART_VALUES) -> str:
    cells = ", ".join(f'{_cell(p, how)} AS "{p}"' for p, how in m.methods(rules).items())
    firsts = ", ".join(_text(p) for p, how in m.methods(rules).items() if how == "first") or "NULL"
    return f"""{long_cte(rules)}, counted AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY rule_ord, row_ord) AS rn,
          count(*) OVER (PARTITION BY user_id, field) AS n FROM cand
      ), placed AS (
        SELECT *, CASE WHEN field IN ({firsts}) THEN 0
          ELSE CAST(((rn - 1) * ((n + {part_values} - 1) // {part_values})) // n AS BIGINT) END AS record_part FROM counted
      ), ids AS (
        SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS record_part FROM events WHERE user_id IS NOT NULL
        UNION SELECT user_id, record_part FROM placed
      )
      SELECT i.user_id, i.record_part, {cells}
      FROM ids i LEFT JOIN placed c ON c.user_id = i.user_id AND c.record_part = i.record_part GROUP BY i.user_id, i.record_part"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _wide(spark, sf_dir):
    return m.map_wide(_orders(spark, sf_dir), WIDE_RULES, ["o_orderkey"])


def q_map_wide(spark, sf_dir):
    mapped = _wide(spark, sf_dir)
    lists = F.array_join("tags", "|").alias("tags"), F.array_join("note", "|").alias("note")
    return mapped.select(*[c for c in mapped.columns if c not in ("tags", "note")], *lists)


def q_map_wide_literal(spark, sf_dir):
    source = _orders(spark, sf_dir).withColumn(
        "F", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3)
    )
    return m.map_wide_flat(source, WIDE_RULES, ["o_orderkey"], compat="literal")


def q_map_wide_flat(spark, sf_dir):
    return m.map_wide_flat(_orders(spark, sf_dir), WIDE_RULES, ["o_orderkey"])


def q_map_long(spark, sf_dir):
    candidates = m.long_candidates(long_source(spark, sf_dir), *LONG_ARGS, LONG_RULES)
    return m.long_rows(candidates, "user_id", LONG_RULES)


def q_map_long_flat(spark, sf_dir):
    return m.map_long_flat(long_source(spark, sf_dir), *LONG_ARGS, LONG_RULES, part_values=SHORT_PARTS)


def _clicks(method):
    return [m.Rule("clicks", "click", method=method), m.Rule("clicks", "view", method="first")]


def _resolved(method):
    def run(spark, sf_dir):
        flat = m.map_long_flat(long_source(spark, sf_dir), *LONG_ARGS, _clicks(method), part_values=SHORT_PARTS)
        return flat.select("user_id", "record_part", "clicks")
    return run


def q_dedupe_candidates(spark, sf_dir):
    k = F.col("k").cast("int")
    values = F.array(
        F.col("event_type"), F.when(k > 50, F.col("k")), F.col("k"), F.lit(None).cast("string"),
        F.when(k % 2 == 0, F.col("event_type")), F.lit("view"),
    )
    return long_source(spark, sf_dir).select(
        "event_id", F.array_join(m.dedupe_candidates(values), "|").alias("candidates")
    )


def q_nest_paths(spark, sf_dir):
    nested = v.nest_paths(_wide(spark, sf_dir), WIDE_SCHEMA, ["o_orderkey"])
    return nested.select(
        "o_orderkey",
        F.col("record.order_id").alias("order_id"),
        F.col("record.is_urgent").alias("is_urgent"),
        F.col("record.amounts.total").alias("total"),
        F.col("record.amounts.customer").alias("customer"),
        F.to_json("record.amounts").alias("amounts_json"),
        F.array_join("record.tags", "|").alias("tags"),
        F.col("record.missing").alias("missing"),
    )


def q_inject_id(spark, sf_dir):
    mapped = m.map_long(long_source(spark, sf_dir), *LONG_ARGS, LONG_RULES)
    checked = v.validate_rows(v.inject_id(mapped, LONG_SCHEMA, "user_id"), LONG_SCHEMA, ["record_id"])
    return checked.select(
        "record_id", F.col("record.user_id").alias("user_id"),
        F.col("record.first_view").alias("first_view"),
        F.col("record.error.level").alias("level"), "valid", "error",
    )


def q_validate_rows(spark, sf_dir):
    checked = v.validate_rows(_wide(spark, sf_dir), STRICT_WIDE_SCHEMA, ["o_orderkey"])
    return checked.select(
        "o_orderkey", "valid", "error", F.size("errors").cast("bigint").alias("n_errors"),
        F.col("record.is_urgent").alias("is_urgent"), F.col("record.amounts.total").alias("total"),
    )


def q_records_json(spark, sf_dir):
    checked = v.validate_rows(_wide(spark, sf_dir), WIDE_SCHEMA, ["o_orderkey"])
    return v.records_json(checked, ["o_orderkey"])


def q_quarantine(spark, sf_dir):
    checked = v.validate_rows(_wide(spark, sf_dir), QUARANTINE_SCHEMA, ["o_orderkey"], raw=True)
    return v.quarantine(checked, v.wide_identifier(F.col("o_orderkey")))


def q_quarantine_long(spark, sf_dir):
    mapped = m.map_long(long_source(spark, sf_dir), *LONG_ARGS, LONG_RULES)
    mapped = v.inject_id(mapped, STRICT_LONG_SCHEMA, "user_id")
    checked = v.validate_rows(mapped, STRICT_LONG_SCHEMA, ["record_id"], raw=True)
    return v.quarantine(checked, v.long_identifier("user_id", F.col("record_id")))


def _checked_parts(spark, sf_dir):
    rules = [r for r in LONG_RULES if r.field in ("clicks", "purchases")]
    mapped = m.map_long(long_source(spark, sf_dir), *LONG_ARGS, rules, part_values=SHORT_PARTS)
    return v.validate_rows(v.inject_id(mapped, PARTS_SCHEMA, "user_id"), PARTS_SCHEMA, ["record_id"], raw=True)


def q_records_json_parts(spark, sf_dir):
    return v.records_json(_checked_parts(spark, sf_dir), ["record_id", "record_part"])


def q_quarantine_parts(spark, sf_dir):
    return v.quarantine_data(_checked_parts(spark, sf_dir), v.long_identifier("user_id", F.col("record_id")))


def q_quarantine_once(spark, sf_dir):
    return v.quarantine(_checked_parts(spark, sf_dir), F.col("record_id")).select(
        F.col("row_identifier").alias("user_id"), "error")


# Three levels of lists; the second drug and the second visit stand in some rows only.
VISIT_RULES = [
    m.Rule("order_id", "o_orderkey", kind="int"),
    m.Rule("visits::0::code", "o_orderstatus"),
    m.Rule("visits::0::drugs::0::name", "o_orderpriority"),
    m.Rule("visits::0::drugs::0::doses::0::mg", "o_custkey", kind="int"),
    m.Rule("visits::0::drugs::0::doses::1::mg", "o_orderkey", kind="int"),
    m.Rule("visits::0::drugs::1::name", "o_orderpriority", "urgent", ("1-URGENT",)),
    m.Rule("visits::1::code", "o_orderstatus", "Open", ("O",)),
]


def q_nested_lists(spark, sf_dir):
    mapped = m.map_wide(_orders(spark, sf_dir), VISIT_RULES, ["o_orderkey"])
    checked = v.validate_rows(mapped, VISITS_SCHEMA, ["o_orderkey"])
    return checked.select("o_orderkey", "valid", "error", F.when(F.col("valid"), F.to_json("record")).alias("record_json"))


QUERIES = {
    "map_wide": q_map_wide,
    "nested_lists": q_nested_lists,
    "map_wide_literal": q_map_wide_literal,
    "map_wide_flat": q_map_wide_flat,
    "map_long": q_map_long,
    "map_long_flat": q_map_long_flat,
    "dedupe_candidates": q_dedupe_candidates,
    "resolve_first": _resolved("first"),
    "resolve_join": _resolved("join_semicolon"),
    "resolve_both": _resolved("haveBoth"),
    "nest_paths": q_nest_paths,
    "inject_id": q_inject_id,
    "validate_rows": q_validate_rows,
    "records_json": q_records_json,
    "quarantine": q_quarantine,
    "quarantine_long": q_quarantine_long,
    "records_json_parts": q_records_json_parts,
    "quarantine_parts": q_quarantine_parts,
    "quarantine_once": q_quarantine_once,
}

_PRIORITY = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW') THEN o_orderpriority END"
_URGENT = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'True' WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN 'False' END"
_STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus IN ('O','P') THEN 'Open' END"
_URGENT_BOOL = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN true WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN false END"


def _first_sql():
    firsts = ", ".join(_text(p) for p, how in m.methods(LONG_RULES).items() if how == "first")
    return f"""{long_cte(LONG_RULES)}
      SELECT user_id, field, value, CAST(rule_ord AS BIGINT) AS rule_ord, CAST(row_ord AS BIGINT) AS row_ord FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY rule_ord, row_ord) AS pos FROM cand
      ) WHERE pos = 1 OR field NOT IN ({firsts})"""


def _resolved_sql(method):
    return f"SELECT user_id, record_part, clicks FROM ({flat_long_sql(_clicks(method), SHORT_PARTS)})"


def _values_sql(path):
    return f"list(value ORDER BY rule_ord, row_ord) FILTER (field = {_text(path)})"


def _listed(path):
    """SQL of a list member of the raw record JSON, null when there is no value."""
    return f"""'"{path}":' || CAST(to_json({_values_sql(path)}) AS VARCHAR)"""


def _single(path):
    return f"""'"{path}":"' || ({_values_sql(path)})[1] || '"'"""


_QUARANTINE_LONG = f"""{long_cte(LONG_RULES)},
  g AS (
    SELECT i.user_id, ({_values_sql("first_view")})[1] AS first_view, {_values_sql("signups")} AS signups,
      ({_values_sql("error::level")})[1] AS level,
      '{{' || concat_ws(',', {_listed("clicks")}, {_single("error::level")}, {_single("first_view")}, {_listed("mixed")}, {_listed("purchases")},
        '"signups":["' || array_to_string({_values_sql("signups")}, ';') || '"]', '"user_id":' || i.user_id) || '}}' AS data
    FROM (SELECT DISTINCT user_id FROM events) i LEFT JOIN cand c USING (user_id) GROUP BY i.user_id
  ),
  e AS (
    SELECT user_id, data, concat_ws('; ', CASE WHEN first_view IS NULL THEN 'first_view: int_type' END,
      CASE WHEN len(signups) > 1 THEN 'signups: int_parsing' END, CASE WHEN level = 'High' THEN 'error::level: enum' END) AS error
    FROM g
  )
  SELECT 'Long format, user_id: ' || user_id AS row_identifier, error, data FROM e WHERE error <> ''"""

_PARTS = f"""{long_cte(LONG_RULES)}, listed AS (SELECT * FROM cand WHERE field IN ('clicks', 'purchases')),
  counted AS (
    SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY rule_ord, row_ord) AS rn,
      count(*) OVER (PARTITION BY user_id, field) AS n FROM listed),
  placed AS (
    SELECT *, CAST(((rn - 1) * ((n + {SHORT_PARTS} - 1) // {SHORT_PARTS})) // n AS BIGINT) AS record_part FROM counted),
  ids AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS record_part FROM events WHERE user_id IS NOT NULL
    UNION SELECT user_id, record_part FROM placed),
  whole AS (SELECT DISTINCT user_id FROM listed WHERE field = 'clicks' AND value::INT >= 96),
  parts AS (
    SELECT i.user_id, i.record_part, i.user_id IN (FROM whole) AS bad, {_values_sql("clicks")} AS clicks, {_values_sql("purchases")} AS purchases
    FROM ids i LEFT JOIN placed p ON p.user_id = i.user_id AND p.record_part = i.record_part GROUP BY i.user_id, i.record_part)"""


ORACLE = {
    "nested_lists": """
      SELECT o_orderkey, o_orderstatus <> 'P' AS valid, CASE WHEN o_orderstatus = 'P' THEN 'visits::0::code: enum' ELSE '' END AS error,
        CASE WHEN o_orderstatus <> 'P' THEN '{"order_id":' || o_orderkey || ',"visits":[{"code":"' || o_orderstatus || '","drugs":[{"name":"' || o_orderpriority
          || '","doses":[{"mg":' || o_custkey || '},{"mg":' || o_orderkey || '}]}' || CASE WHEN o_orderpriority = '1-URGENT' THEN ',{"name":"urgent"}' ELSE '' END
          || ']}' || CASE WHEN o_orderstatus = 'O' THEN ',{"code":"Open"}' ELSE '' END || ']}' END AS record_json
      FROM orders""",
    "records_json_parts": f"""{_PARTS}
      SELECT user_id AS record_id, record_part, '{{' || concat_ws(',', '"user_id":' || user_id,
        '"clicks":' || CAST(to_json(clicks) AS VARCHAR), '"purchases":' || CAST(to_json([p::BIGINT for p in purchases]) AS VARCHAR)) || '}}' AS record_json
      FROM parts WHERE NOT bad""",
    "quarantine_parts": f"""{_PARTS}
      SELECT 'Long format, user_id: ' || user_id AS row_identifier, record_part, '{{' || concat_ws(',',
        '"clicks":' || CAST(to_json(clicks) AS VARCHAR), '"purchases":' || CAST(to_json(purchases) AS VARCHAR), '"user_id":' || user_id) || '}}' AS data
      FROM parts WHERE bad""",
    "quarantine_once": f"{_PARTS} SELECT user_id, 'clicks: enum' AS error FROM parts WHERE bad AND record_part = 0",
    "quarantine_long": _QUARANTINE_LONG,
    "map_wide": f"""
      SELECT o_orderkey, o_orderkey AS order_id, {_STATUS} AS status, {_PRIORITY} AS priority, {_URGENT} AS is_urgent,
             o_totalprice AS "amounts::total", o_custkey AS "amounts::customer",
             o_orderstatus || '|' || o_orderpriority AS tags, o_orderpriority || ';' || o_orderstatus AS note,
             CAST(NULL AS VARCHAR) AS missing
      FROM orders""",
    "map_wide_literal": f"""
      SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS order_id,
             CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'Finished' END AS status,
             {_PRIORITY} AS priority, CAST(NULL AS VARCHAR) AS is_urgent,
             CAST(o_totalprice AS VARCHAR) AS "amounts::total", CAST(o_custkey AS VARCHAR) AS "amounts::customer",
             CAST(to_json([o_orderstatus, o_orderpriority]) AS VARCHAR) AS tags,
             o_orderpriority || ';' || o_orderstatus AS note, CAST(NULL AS VARCHAR) AS missing
      FROM orders""",
    "map_wide_flat": f"""
      SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS order_id, {_STATUS} AS status,
             {_PRIORITY} AS priority, {_URGENT} AS is_urgent,
             CAST(o_totalprice AS VARCHAR) AS "amounts::total", CAST(o_custkey AS VARCHAR) AS "amounts::customer",
             CAST(to_json([o_orderstatus, o_orderpriority]) AS VARCHAR) AS tags,
             o_orderpriority || ';' || o_orderstatus AS note, CAST(NULL AS VARCHAR) AS missing
      FROM orders""",
    "map_long": _first_sql(),
    "map_long_flat": flat_long_sql(LONG_RULES, SHORT_PARTS),
    "dedupe_candidates": """
      SELECT event_id,
             CASE WHEN event_type = 'view' THEN 'view|' || k ELSE event_type || '|' || k || '|view' END AS candidates
      FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""",
    "resolve_first": _resolved_sql("first"),
    "resolve_join": _resolved_sql("join_semicolon"),
    "resolve_both": _resolved_sql("haveBoth"),
    "nest_paths": f"""
      SELECT o_orderkey, o_orderkey AS order_id, {_URGENT_BOOL} AS is_urgent, o_totalprice AS total,
             o_custkey AS customer,
             CAST(to_json(struct_pack(total := o_totalprice, customer := o_custkey)) AS VARCHAR) AS amounts_json,
             o_orderstatus || '|' || o_orderpriority AS tags, CAST(NULL AS VARCHAR) AS missing
      FROM orders""",
    "inject_id": f"""
      WITH flat AS ({flat_long_sql(LONG_RULES)})
      SELECT user_id AS record_id, user_id, CAST(first_view AS BIGINT) AS first_view, "error::level" AS level,
             first_view IS NOT NULL AND (signups IS NOT NULL OR true) AS valid,
             CASE WHEN first_view IS NULL THEN 'first_view: int_type' ELSE '' END AS error
      FROM flat""",
    "validate_rows": f"""
      WITH e AS (
        SELECT o_orderkey, {_URGENT_BOOL} AS is_urgent,
          CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END AS total,
          o_orderstatus = 'F' AS bad_status
        FROM orders
      )
      SELECT o_orderkey, false AS valid,
        concat_ws('; ', 'order_id: string_type', CASE WHEN bad_status THEN 'status: enum' END,
          CASE WHEN is_urgent IS NULL THEN 'is_urgent: bool_type' END,
          CASE WHEN total IS NULL THEN 'amounts::total: int_parsing' END, 'reviewer: missing') AS error,
        CAST(2 + bad_status::INT + (is_urgent IS NULL)::INT + (total IS NULL)::INT AS BIGINT) AS n_errors,
        is_urgent, total
      FROM e""",
    "records_json": f"""
      SELECT o_orderkey, CAST(json_merge_patch('{{}}', to_json(struct_pack(
        order_id := o_orderkey, status := {_STATUS}, priority := o_orderpriority, is_urgent := {_URGENT_BOOL},
        amounts := struct_pack(total := o_totalprice, customer := o_custkey),
        tags := [o_orderstatus, o_orderpriority], note := o_orderpriority || ';' || o_orderstatus))) AS VARCHAR) AS record_json
      FROM orders""",
    "quarantine": f"""
      SELECT 'Wide format, index ' || o_orderkey AS row_identifier,
        concat_ws('; ', CASE WHEN o_orderstatus = 'F' THEN 'status: enum' END,
          CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'is_urgent: bool_type' END) AS error,
        '{{' || concat_ws(',', '"amounts::customer":' || o_custkey, '"amounts::total":' || o_totalprice,
          '"is_urgent":"' || ({_URGENT}) || '"', '"note":["' || o_orderpriority || ';' || o_orderstatus || '"]',
          '"order_id":' || o_orderkey, '"priority":"' || o_orderpriority || '"', '"status":"' || ({_STATUS}) || '"',
          '"tags":["' || o_orderstatus || '","' || o_orderpriority || '"]') || '}}' AS data
      FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '3-MEDIUM'""",
}
