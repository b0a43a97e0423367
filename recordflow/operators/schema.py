"""Target schemas: driver-side description of one schema, and schema definitions held as tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.text import blank, bound, last_key_wins, title_text
from recordflow.runtime import by_shuffle, cut_lineage

SEP = "::"

SCALARS = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
}


def target(name: str, kind: str | T.StructType, *, required: bool = False, many: bool = False,
           options: list[str] | None = None, enum: str | None = None) -> T.StructField:
    """One target field. ``options`` restricts its values and ``enum`` names the option set."""
    base = kind if isinstance(kind, T.StructType) else SCALARS[kind]
    metadata: dict = {}
    if options:
        metadata["options"] = list(options)
    if enum:
        metadata["enum"] = enum
    return T.StructField(name, T.ArrayType(base) if many else base, not required, metadata)


def leaves(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.StructField]]:
    """(path, leaf field) in declaration order; structs are entered, arrays of scalars are leaves."""
    for field in schema.fields:
        path = f"{prefix}{SEP}{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            yield from leaves(field.dataType, path)
        else:
            yield path, field


def leaf_map(schema: T.StructType) -> dict[str, T.StructField]:
    return dict(leaves(schema))


def options_of(field: T.StructField) -> list[str] | None:
    return (field.metadata or {}).get("options")


def check_paths(paths: list[str]) -> None:
    """A path may not be a leaf and a parent at once."""
    known = set(paths)
    for path in known:
        parts = path.split(SEP)
        for cut in range(1, len(parts)):
            if SEP.join(parts[:cut]) in known:
                raise ValueError(f"path {SEP.join(parts[:cut])!r} is both a field and a parent of {path!r}")


_WRAPPERS = r"^((?:(?:Optional|Union|List|list)\[\s*(?:None\s*,\s*)?|None\s*\|\s*)*)"


def type_columns(declared: Column) -> dict[str, Column]:
    """Declared type text -> base type, nullability, list-ness and Spark type name.

    ``Optional[..]``, ``List[..]`` and ``.. | None`` are unwrapped in any order and depth; a union
    keeps its first member that is not ``None``; ``Literal[..]`` reads as text.
    """
    text = F.trim(declared)
    wrappers = F.regexp_extract(text, _WRAPPERS, 1)
    inner = F.regexp_replace(text, _WRAPPERS, "")
    none_member = text.rlike(r"^None\s*\||[|,\[]\s*None\s*([|,\]]|$)") & ~inner.startswith("Literal[")
    optional = wrappers.contains("Optional[") | none_member
    many = F.lower(wrappers).contains("list[")
    base = F.when(inner.startswith("Literal["), F.lit("str")).otherwise(
        F.regexp_extract(inner, r"^[A-Za-z_][A-Za-z0-9_.]*", 0)
    )
    element = (
        F.when(base == "str", "string")
        .when(base == "int", "bigint")
        .when(base == "float", "double")
        .when(base == "bool", "boolean")
        .when(F.lower(base) == "dict", "map<string,string>")
        .otherwise("string")
    )
    return {
        "base_type": base,
        "nullable": optional,
        "is_list": many,
        "spark_type": F.when(many, F.concat(F.lit("array<"), element, F.lit(">"))).otherwise(element),
    }


def resolve_field_type(fields: DataFrame, type_col: str = "field_type") -> DataFrame:
    """Add base_type, nullable, is_list and spark_type to a table of declared types. Narrow."""
    return fields.withColumns(type_columns(F.col(type_col)))


def schema_paths(fields: DataFrame, main: DataFrame, *, literal: bool = False,
                 max_depth: int | None = None) -> DataFrame:
    """Leaf paths of many schemas at once.

    ``fields``: (schema_id, parent_class, ord, name, field_type); ``main``: (schema_id, main_class).
    Each level is one join of the frontier (the members that are classes themselves) with the class
    members on (schema_id, class). Members and frontiers are stored, so the plan of a level starts
    from tables; the leaves of all levels are one lazy union. Output: schema_id, path, leaf_type,
    sort_key (declaration order). ``literal`` stops at an optional list, whose leaf type is then
    ``List``. Nesting may be of any depth; a class that stands twice on a path is an error, as is
    nesting deeper than a ``max_depth`` that a caller sets. Steps of the sort key have six digits, those of larger places a tilde and twenty, which sort after them.
    """
    typed = resolve_field_type(fields)
    shown = F.col("base_type")
    if literal:
        hidden = F.col("field_type").rlike(r"^(Optional|Union)\[\s*(List|list)\[")
        shown = F.when(hidden, F.lit("List")).otherwise(shown)
    place = F.col("ord").cast("string")
    members = typed.select(
        "schema_id", F.col("parent_class").alias("class"), "name", shown.alias("leaf_type"),
        F.when(F.length(place) <= 6, F.lpad(place, 6, "0")).otherwise(F.concat(F.lit("~"), F.lpad(place, 20, "0"))).alias("step"),
    )
    classes = fields.select("schema_id", F.col("parent_class").alias("leaf_type")).distinct()
    members = cut_lineage(
        members.join(by_shuffle(classes.withColumn("nested", F.lit(True))), ["schema_id", "leaf_type"], "left")
        .withColumn("nested", F.coalesce("nested", F.lit(False))), "members",
    )
    above = main.select(
        "schema_id", F.col("main_class").alias("class"), F.lit("").alias("path"), F.lit("").alias("sort_key"),
        F.array("main_class").alias("entered"),
    )
    found = []
    while True:
        level = by_shuffle(above).join(members, ["schema_id", "class"]).select(
            "schema_id", "leaf_type", "nested", "entered",
            F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(SEP, "path", "name")).alias("path"),
            F.when(F.col("sort_key") == "", F.col("step")).otherwise(F.concat_ws(".", "sort_key", "step")).alias("sort_key"),
        )
        found.append(level.where(~F.col("nested")).drop("entered"))
        again = F.array_contains("entered", F.col("leaf_type")).alias("again")
        frontier = level.where("nested").select(
            "schema_id", F.col("leaf_type").alias("class"), "path", "sort_key",
            F.concat("entered", F.array("leaf_type")).alias("entered"), again)
        above = cut_lineage(frontier, "frontier")
        looped = above.where("again").select("class", "path").first()
        if looped is not None:
            raise ValueError(f"class {looped['class']!r} refers to itself at {looped['path']!r}, so its levels have no end")
        if above.isEmpty():
            break
        if len(found) == max_depth:
            raise ValueError(f"schema nesting exceeds {max_depth} levels")
        above = above.drop("again")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result.select("schema_id", "path", "leaf_type", "sort_key")


RULE_COLUMNS = (
    "pydantic_field", "pydantic_type", "evaluation_method", "multiValue_handling_method",
    "pydantic_value", "Observation_ColName", "Observation_Value", "Observation_Value2",
    "Observation_Value3", "Observation_Value4",
)


def mapping_template(paths: DataFrame, enums: DataFrame) -> DataFrame:
    """Rule rows to fill in: one per option for enums and booleans, one otherwise.

    ``paths``: (schema_id, path, leaf_type, sort_key); ``enums``: (schema_id, enum_name, ord, value).
    Option rows join by (schema_id, type), so a large option set spreads over its rows and is
    never gathered into one array. Both sides are dealt by these keys, none is broadcast.
    """
    named = enums.select(
        "schema_id", F.col("enum_name").alias("leaf_type"), F.col("ord").alias("option_ord"),
        F.col("value").alias("option"),
    )
    truth = F.posexplode(F.array(F.lit("True"), F.lit("False"))).alias("option_ord", "option")
    # An enum whose name starts with "bool" is filled in like a boolean.
    boolish = F.lower("leaf_type").startswith("bool")
    options = named.where(~boolish).unionByName(
        named.where(boolish).select("schema_id", "leaf_type").distinct().select("*", truth)
    )
    is_bool = F.lower("leaf_type") == "bool"
    bools = paths.where(is_bool).select("*", truth)
    others = paths.where(~is_bool).join(by_shuffle(options), ["schema_id", "leaf_type"], "left")
    rows = bools.select(*others.columns).unionByName(others)
    fill = {
        "pydantic_field": F.col("path"),
        "pydantic_type": F.col("leaf_type"),
        "evaluation_method": F.lit("smart_exact_match"),
        "multiValue_handling_method": F.lit("haveBoth"),
        "pydantic_value": F.coalesce("option", F.lit("")),
    }
    return rows.select(
        "schema_id",
        "sort_key",
        F.coalesce(F.col("option_ord"), F.lit(0)).cast("bigint").alias("option_ord"),
        *[fill.get(c, F.lit("")).alias(c) for c in RULE_COLUMNS],
    )


def validate_mapping(rules: DataFrame, enums: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``mapping_error`` to a rule table; rules with errors stay in the table.

    ``enums``: (<keys>, enum_name, value). Two equi-joins: is the type an enum, and is the value one
    of its options. Both sides are dealt by the join's keys, so a task holds its share of them only.
    """
    keys = keys or []
    known = enums.select(*keys, F.col("enum_name").alias("pydantic_type")).distinct()
    allowed = enums.select(
        *keys, F.col("enum_name").alias("pydantic_type"), F.col("value").alias("pydantic_value")
    ).distinct()
    joined = rules.join(
        by_shuffle(known.withColumn("_is_enum", F.lit(True))), [*keys, "pydantic_type"], "left"
    ).join(
        by_shuffle(allowed.withColumn("_allowed", F.lit(True))), [*keys, "pydantic_type", "pydantic_value"], "left"
    )
    value_set = F.coalesce(F.col("pydantic_value"), F.lit("")) != ""
    unknown = F.col("_is_enum") & value_set & F.col("_allowed").isNull()
    no_column = blank(F.col("Observation_ColName"))
    error = F.concat_ws(
        "; ",
        F.when(unknown, F.concat(F.lit("unknown enum value: "), F.col("pydantic_value"))),
        F.when(no_column, F.lit("no Observation_ColName set")),
    )
    return joined.select(*[F.col(c) for c in rules.columns], error.alias("mapping_error"))


def mapping_monitor(validated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rules with and without errors per field."""
    has_error = F.col("mapping_error") != ""
    return validated.groupBy(*(keys or []), "pydantic_field").agg(
        F.count_if(has_error).alias("rules_with_errors"),
        F.count_if(~has_error).alias("rules_ok"),
    )


# Member names of schema definitions.
_FIELD = "struct<name:string,field_type:string,parent_class:string,description:string,is_optional:boolean,enum_values:array<string>,default_value:string>"
_ENUM = "struct<name:string,base_type:string,description:string,values:array<string>>"
_CLASS = "struct<name:string,description:string,is_base_model:boolean,parent_class:string,is_enum:boolean>"
SCHEMA_JSON = f"struct<main_class:string,classes:array<{_CLASS}>,fields:array<{_FIELD}>,enums:array<{_ENUM}>>"


def _normal_option(item: Column, given: Column) -> Column:
    """A bare string option becomes {name, description}; an object keeps all its members, as text.

    ``given`` is the option as a variant, which tells a string from an object that looks alike.
    """
    bare = F.coalesce(F.schema_of_variant(given) == "STRING", ~F.trim(item).startswith("{"))
    as_object = F.from_json(item, "map<string,string>")
    return F.when(
        bare,
        F.create_map(
            F.lit("name"), F.upper(item),
            F.lit("description"), title_text(F.replace(item, F.lit("_"), F.lit(" "))),
        ),
    ).otherwise(as_object)


def normalize_enum_values(df: DataFrame, json_col: str, out: str = "schema") -> DataFrame:
    """Parse a schema-definition JSON column; options become maps of text, bare strings name and description. Narrow.

    Each text is parsed once as a schema and once as a variant, and each list of options is taken from the
    variant once: ``bound`` holds what a lambda would evaluate again for every entry and option.
    """
    parsed = F.from_json(F.col(json_col), SCHEMA_JSON)
    whole = F.try_parse_json(F.col(json_col))

    def options_of_entry(entry: Column, given: Column, options: str) -> Column:
        items = F.try_variant_get(given, f"$.{options}", "array<variant>")
        return entry.withField(options, bound(items, lambda each: F.transform(
            entry[options], lambda v, i: _normal_option(v, F.get(each, i)))))

    def normal(entries: Column, variant: Column, member: str, options: str) -> Column:
        given = F.try_variant_get(variant, f"$.{member}", "array<variant>")
        return bound(given, lambda each: F.transform(
            entries, lambda entry, at: options_of_entry(entry, F.get(each, at), options)))

    def both(variant: Column) -> Column:
        return bound(parsed, lambda schema: schema
                     .withField("fields", normal(schema["fields"], variant, "fields", "enum_values"))
                     .withField("enums", normal(schema["enums"], variant, "enums", "values")))

    with last_key_wins(df.sparkSession):
        return df.withColumn(out, bound(whole, both))


def schema_stats(df: DataFrame, json_col: str) -> DataFrame:
    """Main class and counts of classes, fields, fields with options, and enums. Narrow."""
    parsed = F.from_json(F.col(json_col), SCHEMA_JSON)
    with_options = F.filter(parsed["fields"], lambda f: F.coalesce(F.size(f["enum_values"]), F.lit(0)) > 0)

    def count(arr: Column) -> Column:
        return F.coalesce(F.greatest(F.size(arr), F.lit(0)), F.lit(0)).cast("bigint")

    return df.withColumns({
        "main_class": F.coalesce(parsed["main_class"], F.lit("NOT SET")),
        "n_classes": count(parsed["classes"]),
        "n_fields": count(parsed["fields"]),
        "n_enum_fields": count(with_options),
        "n_enums": count(parsed["enums"]),
    })
