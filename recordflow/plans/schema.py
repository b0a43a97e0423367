"""Queries over schema definitions and rule tables. Every part carries a schema of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators import schema as s
from recordflow.plans.base import table
from recordflow.runtime import spread

# (parent class, position, field name, declared type); the name and one type depend on the part.
_FIELDS = [
    ("Report", 1, None, "str"),
    ("Report", 2, "size", "Optional[int]"),
    ("Report", 3, "price", "float"),
    ("Report", 4, "is_promo", "Optional[bool]"),
    ("Report", 5, "grade", "Grade"),
    ("Report", 6, "tags", "List[str]"),
    ("Report", 7, "finishes", "Optional[List[Finish]]"),
    ("Report", 8, "details", None),
    ("Report", 9, "mode", "Literal['a','b']"),
    ("Details", 1, "brand", "str"),
    ("Details", 2, "box", "Box"),
    ("Details", 3, "alt", "str | None"),
    ("Box", 1, "width", "float"),
    ("Box", 2, "kind", "Optional[Grade]"),
    ("Box", 3, "labels", "List[Optional[str]]"),
    ("Box", 4, "either", "Union[int, str, None]"),
]


def definition_fields(spark, sf_dir):
    first = F.concat(F.lower("p_type"), F.lit("_name"))
    details = F.when(F.col("p_size") % 2 == 0, F.lit("Optional[Details]")).otherwise(F.lit("List[Details]"))
    rows = F.array(*[
        F.struct(
            F.lit(parent).alias("parent_class"), F.lit(ord_).cast("bigint").alias("ord"),
            (F.lit(name) if name else first).alias("name"),
            (F.lit(kind) if kind else details).alias("field_type"),
        )
        for parent, ord_, name, kind in _FIELDS
    ])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("schema_id"), F.inline(rows))


def definition_enums(spark, sf_dir):
    def option(enum, ord_, value):
        return F.struct(F.lit(enum).alias("enum_name"), F.lit(ord_).cast("bigint").alias("ord"), value.alias("value"))

    rows = F.array(
        option("Grade", 1, F.lit("A")), option("Grade", 2, F.lit("B")), option("Grade", 3, F.col("p_type")),
        option("Finish", 1, F.lit("MATTE")), option("Finish", 2, F.col("p_brand")),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("schema_id"), F.inline(rows))


def _paths(spark, sf_dir):
    main = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("schema_id"), F.lit("Report").alias("main_class")
    )
    return s.schema_paths(definition_fields(spark, sf_dir), main)


def q_schema_paths(spark, sf_dir):
    return _paths(spark, sf_dir)


def q_resolve_field_type(spark, sf_dir):
    return s.resolve_field_type(definition_fields(spark, sf_dir))


def q_mapping_template(spark, sf_dir):
    return s.mapping_template(_paths(spark, sf_dir), definition_enums(spark, sf_dir))


def _filled_rules(spark, sf_dir):
    """Two filled-in rules per part, some with unknown options, some without a source column."""
    def rule(field, kind, value):
        return F.struct(
            F.lit(field).alias("pydantic_field"), F.lit(kind).alias("pydantic_type"), value.alias("pydantic_value"),
            F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("col_"), "p_brand")).alias("Observation_ColName"),
        )

    rows = F.array(
        rule("grade", "Grade", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_type"))),
        rule("size", "int", F.lit("")),
        rule("finishes", "Finish", F.lit("")),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("schema_id"), F.inline(rows))


def q_validate_mapping(spark, sf_dir):
    return s.validate_mapping(_filled_rules(spark, sf_dir), definition_enums(spark, sf_dir), ["schema_id"])


def q_mapping_monitor(spark, sf_dir):
    return s.mapping_monitor(q_validate_mapping(spark, sf_dir))


def definition_json(spark, sf_dir):
    """One schema-definition document per part; some lack the main class and the enums."""
    text = F.concat(
        F.lit('{'),
        F.when(F.col("p_size") % 4 != 0, F.lit('"main_class":"Report",')).otherwise(F.lit("")),
        F.lit('"classes":[{"name":"Report","description":"d","is_base_model":true}],"fields":['
              '{"name":"grade","field_type":"Grade","parent_class":"Report","description":"g","enum_values":["o\'neil_3d fit","'),
        F.lower("p_type"),
        F.lit('_fit",{"name":"X","description":"kept As is"},{"value":"A","label":"x"}]},'
              '{"name":"n","field_type":"int","parent_class":"Report","description":"n","enum_values":null}]'),
        F.when(F.col("p_size") % 4 != 0, F.concat(
            F.lit(',"enums":[{"name":"Grade","base_type":"str","description":"e","values":["'),
            F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('"]}]'),
        )).otherwise(F.lit("")),
        F.lit('}'),
    )
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"))
    return part.select(F.col("p_partkey").alias("schema_id"), text.alias("schema_json"))


def q_normalize_enum_values(spark, sf_dir):
    normal = s.normalize_enum_values(definition_json(spark, sf_dir), "schema_json")
    return normal.select(
        "schema_id",
        F.to_json("schema.fields.enum_values").alias("field_options"),
        F.to_json("schema.enums.values").alias("enum_options"),
    )


def q_schema_stats(spark, sf_dir):
    return s.schema_stats(definition_json(spark, sf_dir), "schema_json").drop("schema_json")


QUERIES = {
    "schema_paths": q_schema_paths,
    "resolve_field_type": q_resolve_field_type,
    "mapping_template": q_mapping_template,
    "validate_mapping": q_validate_mapping,
    "mapping_monitor": q_mapping_monitor,
    "normalize_enum_values": q_normalize_enum_values,
    "schema_stats": q_schema_stats,
}

_FIELD_ROWS = """
  fields AS (
    SELECT p_partkey AS schema_id, f.parent_class, CAST(f.ord AS BIGINT) AS ord,
           coalesce(f.name, lower(p_type) || '_name') AS name,
           coalesce(f.field_type, CASE WHEN p_size % 2 = 0 THEN 'Optional[Details]' ELSE 'List[Details]' END) AS field_type,
           f.base_type, f.spark_type,
           CASE WHEN f.name = 'details' THEN p_size % 2 = 0 ELSE f.nullable END AS nullable,
           CASE WHEN f.name = 'details' THEN p_size % 2 <> 0 ELSE f.is_list END AS is_list
    FROM part, (VALUES
      ('Report', 1, NULL, 'str', 'str', 'string', false, false),
      ('Report', 2, 'size', 'Optional[int]', 'int', 'bigint', true, false),
      ('Report', 3, 'price', 'float', 'float', 'double', false, false),
      ('Report', 4, 'is_promo', 'Optional[bool]', 'bool', 'boolean', true, false),
      ('Report', 5, 'grade', 'Grade', 'Grade', 'string', false, false),
      ('Report', 6, 'tags', 'List[str]', 'str', 'string', false, true),
      ('Report', 7, 'finishes', 'Optional[List[Finish]]', 'Finish', 'string', true, true),
      ('Report', 8, 'details', NULL, 'Details', 'string', NULL, NULL),
      ('Report', 9, 'mode', 'Literal[''a'',''b'']', 'str', 'string', false, false),
      ('Details', 1, 'brand', 'str', 'str', 'string', false, false),
      ('Details', 2, 'box', 'Box', 'Box', 'string', false, false),
      ('Details', 3, 'alt', 'str | None', 'str', 'string', true, false),
      ('Box', 1, 'width', 'float', 'float', 'double', false, false),
      ('Box', 2, 'kind', 'Optional[Grade]', 'Grade', 'string', true, false),
      ('Box', 3, 'labels', 'List[Optional[str]]', 'str', 'string', true, true),
      ('Box', 4, 'either', 'Union[int, str, None]', 'int', 'bigint', true, false)
    ) AS f(parent_class, ord, name, field_type, base_type, spark_type, nullable, is_list)
  )"""

_PATH_ROWS = f"""
  {_FIELD_ROWS},
  walk AS (
    SELECT schema_id, name AS path, base_type AS leaf_type, lpad(CAST(ord AS VARCHAR), 6, '0') AS sort_key
    FROM fields WHERE parent_class = 'Report'
    UNION ALL
    SELECT f.schema_id, w.path || '::' || f.name, f.base_type, w.sort_key || '.' || lpad(CAST(f.ord AS VARCHAR), 6, '0')
    FROM walk w JOIN fields f ON f.schema_id = w.schema_id AND f.parent_class = w.leaf_type
  ),
  paths AS (SELECT * FROM walk WHERE leaf_type NOT IN ('Details', 'Box'))"""

_ENUM_ROWS = """
  enums AS (
    SELECT p_partkey AS schema_id, e.enum_name, CAST(e.ord AS BIGINT) AS ord,
           CASE e.value WHEN '$type' THEN p_type WHEN '$brand' THEN p_brand ELSE e.value END AS value
    FROM part, (VALUES ('Grade', 1, 'A'), ('Grade', 2, 'B'), ('Grade', 3, '$type'), ('Finish', 1, 'MATTE'),
                       ('Finish', 2, '$brand')) AS e(enum_name, ord, value)
  )"""

_CHECKED = f"""
  {_ENUM_ROWS},
  rules AS (
    SELECT p_partkey AS schema_id, r.field AS pydantic_field, r.kind AS pydantic_type,
           CASE WHEN r.field = 'grade' THEN CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END ELSE '' END AS pydantic_value,
           CASE WHEN p_size % 5 = 0 THEN ' ' ELSE 'col_' || p_brand END AS "Observation_ColName"
    FROM part, (VALUES ('grade', 'Grade'), ('size', 'int'), ('finishes', 'Finish')) AS r(field, kind)
  ),
  checked AS (
    SELECT *, concat_ws('; ',
      CASE WHEN pydantic_type IN ('Grade', 'Finish') AND pydantic_value <> '' AND NOT EXISTS (
        SELECT 1 FROM enums e WHERE e.schema_id = rules.schema_id AND e.enum_name = pydantic_type AND e.value = pydantic_value
      ) THEN 'unknown enum value: ' || pydantic_value END,
      CASE WHEN trim("Observation_ColName") = '' THEN 'no Observation_ColName set' END) AS mapping_error
    FROM rules
  )"""

_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, '\\p{{L}}+|\\P{{L}}+'), "
    "lambda x: upper(x[1]) || lower(x[2:])), '')"
)

ORACLE = {
    "schema_paths": f"WITH RECURSIVE {_PATH_ROWS} SELECT * FROM paths",
    "resolve_field_type": f"""WITH {_FIELD_ROWS}
      SELECT schema_id, parent_class, ord, name, field_type, base_type, nullable, is_list,
             CASE WHEN is_list THEN 'array<' || spark_type || '>' ELSE spark_type END AS spark_type
      FROM fields""",
    "mapping_template": f"""WITH RECURSIVE {_PATH_ROWS}, {_ENUM_ROWS}
      SELECT p.schema_id, p.sort_key, CAST(coalesce(b.ord, e.ord, 0) AS BIGINT) AS option_ord,
             p.path AS pydantic_field, p.leaf_type AS pydantic_type, 'smart_exact_match' AS evaluation_method,
             'haveBoth' AS "multiValue_handling_method", coalesce(b.value, e.value, '') AS pydantic_value,
             '' AS "Observation_ColName", '' AS "Observation_Value", '' AS "Observation_Value2",
             '' AS "Observation_Value3", '' AS "Observation_Value4"
      FROM paths p
      LEFT JOIN enums e ON e.schema_id = p.schema_id AND e.enum_name = p.leaf_type
      LEFT JOIN (VALUES ('bool', 0, 'True'), ('bool', 1, 'False')) AS b(kind, ord, value) ON b.kind = p.leaf_type""",
    "validate_mapping": f"WITH {_CHECKED} SELECT * FROM checked",
    "mapping_monitor": f"""WITH {_CHECKED}
      SELECT pydantic_field, count(*) FILTER (mapping_error <> '') AS rules_with_errors,
             count(*) FILTER (mapping_error = '') AS rules_ok
      FROM checked GROUP BY pydantic_field""",
    "normalize_enum_values": f"""
      SELECT p_partkey AS schema_id,
        '[[{{"name":"O''NEIL_3D FIT","description":"O''Neil 3D Fit"}},{{"name":"' || p_type || '_FIT","description":"'
          || {_TITLE.format("p_type")} || ' Fit"}},{{"name":"X","description":"kept As is"}},{{"value":"A","label":"x"}}],null]' AS field_options,
        CASE WHEN p_size % 4 <> 0 THEN '[[{{"name":"' || upper(replace(p_name, ' ', '_')) || '","description":"'
          || {_TITLE.format("p_name")} || '"}}]]' END AS enum_options
      FROM part""",
    "schema_stats": """
      SELECT p_partkey AS schema_id, CASE WHEN p_size % 4 = 0 THEN 'NOT SET' ELSE 'Report' END AS main_class,
             CAST(1 AS BIGINT) AS n_classes, CAST(2 AS BIGINT) AS n_fields, CAST(1 AS BIGINT) AS n_enum_fields,
             CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_enums
      FROM part""",
}
