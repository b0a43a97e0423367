"""Typing, validation, nesting and quarantine of mapped records.

Works on mapped tables (see ``mapping``): per path a plain column or an ``array<string>``. Projections
add the typed record and its errors; only records in several parts need a shuffle, for their verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.text import any_of, lax_cast
from recordflow.operators.mapping import PART, cell_value
from recordflow.operators.schema import SEP, leaf_map, options_of
from recordflow.runtime import cut_lineage

_NAMES = {T.StringType: "string", T.LongType: "int", T.DoubleType: "float", T.BooleanType: "bool"}

def type_name(dtype: T.DataType) -> str:
    return _NAMES.get(type(dtype), dtype.simpleString())


def enum_or_null(col: Column, options: list[str]) -> Column:
    """The value when it is one of the options, else null."""
    return F.when(col.isin(*options), col)


def _typed(value: Column, source: T.DataType, field: T.StructField, dtype: T.DataType) -> Column:
    """One source value as the declared type; null where it is not accepted.

    Text follows the lax rules; numbers and booleans convert among each other when nothing is lost.
    """
    options = options_of(field)
    if isinstance(source, T.StringType):
        return enum_or_null(value, options) if options else lax_cast(value, dtype)
    if options or isinstance(dtype, T.StringType):
        return F.lit(None).cast("string")
    if isinstance(dtype, T.LongType):
        whole = value == F.floor(value) if isinstance(source, T.FractionalType) else F.lit(True)
        return F.when(whole, value.try_cast("bigint"))
    if isinstance(dtype, T.BooleanType) and not isinstance(source, T.BooleanType):
        return F.when(value.isin(0, 1), value == 1)
    return value.try_cast(dtype)


def _item_error(value: Column, source: T.DataType, field: T.StructField, dtype: T.DataType) -> Column:
    """Error kind of one value, null when it is accepted or absent."""
    name = type_name(dtype)
    text = isinstance(source, T.StringType)
    if options_of(field):
        return F.when(~value.isin(*options_of(field)), F.lit("enum")) if text else F.when(value.isNotNull(), F.lit("enum"))
    if isinstance(dtype, T.StringType):
        return F.lit(None).cast("string") if text else F.when(value.isNotNull(), F.lit("string_type"))
    safe = isinstance(source, T.IntegralType) and isinstance(dtype, (T.LongType, T.DoubleType))
    if safe or source == dtype:
        return F.lit(None).cast("string")
    return F.when(value.isNotNull() & _typed(value, source, field, dtype).isNull(), F.lit(f"{name}_parsing"))


class _Leaf:
    """Value, presence and error expressions of one target leaf over a mapped column."""

    def __init__(self, path: str, field: T.StructField, source: T.DataType | None, compat: str):
        many = isinstance(field.dataType, T.ArrayType)
        dtype = field.dataType.elementType if many else field.dataType
        if source is None:
            self.value = F.lit(None).cast(field.dataType)
            self.present = F.lit(False)
            self.error = F.lit(None if field.nullable else "missing").cast("string")
            return
        column = F.col(f"`{path}`")
        if many and isinstance(dtype, T.StructType):
            # A list of records that is typed already.
            self.value, self.present = column, column.isNotNull()
            self.error = F.when(~self.present, F.lit(None if field.nullable else "list_type"))
            return
        wrong = "enum" if options_of(field) else f"{type_name(dtype)}_type"
        absent = F.lit(None if field.nullable else ("list_type" if many else wrong)).cast("string")
        listed = isinstance(source, T.ArrayType)
        if listed:
            # In JSON an empty list is a value and a missing one is null.
            self.present = column.isNotNull() if many and compat == "json" else F.size(column) > 0
            several = F.size(column) > 1
        else:
            self.present = column.isNotNull()
            several = F.lit(False)
        if many and listed:
            text = T.StringType()
            bad = F.filter(F.transform(column, lambda v: _item_error(v, text, field, dtype)), lambda e: e.isNotNull())
            error = F.get(bad, F.lit(0))
            value = F.transform(column, lambda v: _typed(v, text, field, dtype))
        elif many:
            error = _item_error(column, source, field, dtype)
            value = F.array(_typed(column, source, field, dtype))
        elif listed:
            one = F.get(column, F.lit(0))
            error = F.when(several, F.lit(wrong)).otherwise(_item_error(one, T.StringType(), field, dtype))
            value = F.when(~several, _typed(one, T.StringType(), field, dtype))
        else:
            error = _item_error(column, source, field, dtype)
            value = _typed(column, source, field, dtype)
        if many and compat == "literal":
            error = F.when(~several, F.lit("list_type")).otherwise(error)
        self.value = F.when(self.present, value) if many or listed else value
        self.error = F.when(self.present, error).otherwise(absent).cast("string")


def _is_records(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType)


class _Group:
    """A list of nested records over indexed columns, such as ``items::0::a`` and ``items::1::a``."""

    def __init__(self, path: str, field: T.StructField, indexes: list[int]):
        self.path, self.field, self.items = path, field, [f"{path}{SEP}{i}" for i in indexes]


def _indexes(columns: list[str], path: str) -> list[int]:
    """Index steps that follow a path in column names, ascending."""
    lead = path + SEP
    steps = {c[len(lead):].split(SEP)[0] for c in columns if c.startswith(lead)}
    return sorted(int(s) for s in steps if s.isdecimal())


def _leaf_table(mapped: DataFrame, schema: T.StructType, compat: str) -> dict[str, _Leaf | _Group]:
    """Leaves and groups by path; elements of a group have the paths of their columns, index included."""
    types = {f.name: f.dataType for f in mapped.schema.fields}
    table: dict[str, _Leaf | _Group] = {}

    def enter(inner: T.StructType, prefix: str) -> None:
        for field in inner.fields:
            path = f"{prefix}{SEP}{field.name}" if prefix else field.name
            if isinstance(field.dataType, T.StructType):
                enter(field.dataType, path)
            elif _is_records(field.dataType) and path not in types:
                table[path] = group = _Group(path, field, _indexes(list(types), path))
                for item in group.items:
                    enter(field.dataType.elementType, item)
            else:
                table[path] = _Leaf(path, field, types.get(path), compat)

    enter(schema, "")
    return table


def _present(field: T.StructField, path: str, table: dict[str, _Leaf | _Group]) -> Column:
    if isinstance(field.dataType, T.StructType):
        return _any_present(field.dataType, path, table)
    entry = table[path]
    if isinstance(entry, _Group):
        return any_of([_any_present(field.dataType.elementType, item, table) for item in entry.items])
    return entry.present


def _any_present(schema: T.StructType, prefix: str, table: dict[str, _Leaf | _Group]) -> Column:
    return any_of([_present(f, f"{prefix}{SEP}{f.name}" if prefix else f.name, table) for f in schema.fields])


def _nest(schema: T.StructType, prefix: str, table: dict[str, _Leaf | _Group], compat: str) -> Column:
    parts = []
    for field in schema.fields:
        path = f"{prefix}{SEP}{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            inner = _nest(field.dataType, path, table, compat)
            if field.nullable and compat != "literal":
                inner = F.when(_any_present(field.dataType, path, table), inner)
        elif isinstance(table[path], _Group):
            # elements without any value are left out; those that stay keep the order of their indexes
            element = field.dataType.elementType
            items = [F.when(_any_present(element, i, table), _nest(element, i, table, compat)) for i in table[path].items]
            listed = F.array_compact(F.array(*items)) if items else F.lit(None).cast(field.dataType)
            inner = F.when(F.size(listed) > 0, listed)
        else:
            inner = table[path].value
        parts.append(inner.alias(field.name))
    return F.struct(*parts)


def _errors(schema: T.StructType, prefix: str, table: dict[str, _Leaf | _Group], compat: str) -> dict[str, Column]:
    """Error kind per leaf path, null when the leaf is fine; elements of lists have their index in the path."""
    out: dict[str, Column] = {}
    for field in schema.fields:
        path = f"{prefix}{SEP}{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            inner = _errors(field.dataType, path, table, compat)
            if field.nullable and compat != "literal":
                guard = _any_present(field.dataType, path, table)
                inner = {p: F.when(guard, e) for p, e in inner.items()}
            out.update(inner)
        elif isinstance(table[path], _Group):
            if not field.nullable:
                absent = "list_type" if table[path].items else "missing"
                out[path] = F.when(~_present(field, path, table), F.lit(absent))
            for item in table[path].items:
                guard = _any_present(field.dataType.elementType, item, table)
                out.update({p: F.when(guard, e) for p, e in _errors(field.dataType.elementType, item, table, compat).items()})
        else:
            out[path] = table[path].error
    return out


def keep_where(df: DataFrame, condition: Column, columns: list[Column]) -> DataFrame:
    """Columns of the rows that meet a condition, the condition evaluated where it stands.

    A plain filter on validation results is pushed below the mapping, which then runs twice; an
    array of one or no row is not.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def nest_paths(mapped: DataFrame, schema: T.StructType, keep: list[str], *, compat: str = "intended",
               out: str = "record") -> DataFrame:
    """Typed nested record from the path columns. An optional struct without any value is null
    (``literal`` keeps it, empty). Columns ``items::0::a``, ``items::1::a`` make the list of records ``items``,
    which may hold further lists; elements without any value are left out."""
    table = _leaf_table(mapped, schema, compat)
    return mapped.select(*keep, _nest(schema, "", table, compat).alias(out))


def validate_rows(mapped: DataFrame, schema: T.StructType, keep: list[str], *,
                  compat: str = "intended", raw: bool = False) -> DataFrame:
    """Add record, errors (array of field and kind), valid and error text.

    A number is not accepted where text is declared. ``raw`` adds the mapped values as JSON text. With
    ``compat="json"`` an empty list is a value.

    Of a record in parts (``record_part``, which stays) every part has the verdict of the whole record: it is
    valid if all its parts are, and its errors are those of all parts. What is absent counts against part
    0, which holds something of every field that has a value. Parts are checked and stored once; errors
    of records with several parts are combined by ``record_id`` before they move, a row per invalid record.
    """
    table = _leaf_table(mapped, schema, compat)
    kinds_by_path = _errors(schema, "", table, compat)
    parted = PART in mapped.columns
    if parted:
        kinds_by_path = {p: _in_part(table.get(p), e) for p, e in kinds_by_path.items()}
        keep = [*keep, *([] if PART in keep else [PART])]
    marks = {path: f"_error_{i}" for i, path in enumerate(kinds_by_path)}
    checked = mapped.select(
        *keep,
        *([F.col("record_id").alias("_record")] if parted else []),
        *([raw_json(mapped, keep).alias("data")] if raw else []),
        _nest(schema, "", table, compat).alias("record"),
        *[kinds_by_path[path].alias(mark) for path, mark in marks.items()],
    )
    if parted:
        checked = _whole_verdicts(checked, list(marks.values()))
    wrong = [
        F.when(F.col(mark).isNotNull(), F.struct(F.lit(path).alias("field"), F.col(mark).alias("kind")))
        for path, mark in marks.items()
    ]
    errors = F.array_except(F.array(*wrong), F.array(F.lit(None).cast("struct<field:string,kind:string>")))
    texts = [F.when(F.col(mark).isNotNull(), F.concat(F.lit(f"{path}: "), F.col(mark))) for path, mark in marks.items()]
    return checked.select(
        *keep, *(["data"] if raw else []), "record", errors.alias("errors"),
        F.coalesce(*[F.col(mark) for mark in marks.values()]).isNull().alias("valid"),
        F.concat_ws("; ", *texts).alias("error"),
    )


def _in_part(entry: _Leaf | _Group | None, error: Column) -> Column:
    """The error of a leaf where its part is asked for it: part 0, and later ones that hold a value of it."""
    held = entry.present if isinstance(entry, _Leaf) else F.lit(False)
    return F.when((F.col(PART) == 0) | held, error)


def _whole_verdicts(checked: DataFrame, marks: list[str]) -> DataFrame:
    """Parts with the errors of their whole record: per leaf its own, else the least of the other parts.

    Only records with several parts and an error take part in the join; without any, there is none.
    """
    stored = cut_lineage(checked, "checked-parts")
    several = stored.where(F.col(PART) > 0).select("_record").distinct()
    if several.isEmpty():
        return stored
    # A record without errors in any part is left out before the aggregation.
    wrong = stored.where(F.coalesce(*[F.col(mark) for mark in marks]).isNotNull()).select("_record", *marks)
    verdicts = wrong.join(several, "_record", "left_semi").groupBy("_record").agg(
        *[F.min(mark).alias(f"{mark}_whole") for mark in marks])
    joined = stored.join(verdicts, "_record", "left")
    return joined.withColumns({mark: F.coalesce(mark, f"{mark}_whole") for mark in marks})


def raw_json(mapped: DataFrame, keep: list[str]) -> Column:
    """The mapped values before typing, as one JSON object of path -> value or list."""
    paths = sorted(c for c in mapped.columns if c not in keep and c != PART)
    return F.to_json(F.struct(*[cell_value(F.col(f"`{p}`"), mapped.schema[p].dataType).alias(p) for p in paths]))


def records_json(checked: DataFrame, keep: list[str]) -> DataFrame:
    """Valid records as JSON text with nulls pruned at every level; a record in parts gives a row per part
    (keep ``record_part`` to tell them apart), or none if any part is invalid."""
    text = F.to_json("record", {"ignoreNullFields": "true"}).alias("record_json")
    return keep_where(checked, F.col("valid"), [*[F.col(k) for k in keep], text])


def quarantine(checked: DataFrame, identifier: Column) -> DataFrame:
    """Rows that failed validation: (row_identifier, error, data). Needs ``validate_rows(raw=True)``.

    A record in parts is named once, with the errors of all its parts and the values of part 0;
    ``quarantine_data`` has the values of every part.
    """
    columns = [identifier.alias("row_identifier"), F.col("error"), F.col("data")]
    once = F.col(PART) == 0 if PART in checked.columns else F.lit(True)
    return keep_where(checked, ~F.col("valid") & once, columns)


def quarantine_data(checked: DataFrame, identifier: Column) -> DataFrame:
    """The values of the records that failed, whole, a row per part: (row_identifier, record_part, data)."""
    return keep_where(checked, ~F.col("valid"), [identifier.alias("row_identifier"), F.col(PART), F.col("data")])


def wide_identifier(index: Column) -> Column:
    """Identifier of a row of a wide source in the quarantine."""
    return F.concat(F.lit("Wide format, index "), index.cast("string"))


def long_identifier(id_col: str, value: Column) -> Column:
    """Identifier of a record of a long source in the quarantine."""
    return F.concat(F.lit(f"Long format, {id_col}: "), value.cast("string"))


def inject_id(mapped: DataFrame, schema: T.StructType, id_col: str) -> DataFrame:
    """Set the schema's field named like the id column, or else its ``patient_id``, when the rules
    leave it open. The id is the mapped table's ``record_id``."""
    names = set(schema.fieldNames())
    for name in (id_col, "patient_id"):
        if name in names and name not in mapped.columns:
            return mapped.withColumn(name, F.col("record_id"))
    return mapped


def fill_form_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Values an untouched form would hold: required numbers 0, text '', lists [], others stay null."""
    out = []
    known = {f.name: f for f in schema.fields}
    for name in df.columns:
        field = known.get(name)
        if field is None:
            out.append(F.col(name))
            continue
        dtype = field.dataType
        if options_of(field) or isinstance(dtype, T.BooleanType):
            value = F.col(name)
        elif isinstance(dtype, T.LongType) and not field.nullable:
            value = F.coalesce(F.col(name), F.lit(0).cast("bigint"))
        elif isinstance(dtype, T.DoubleType) and not field.nullable:
            value = F.coalesce(F.col(name), F.lit(0.0))
        elif isinstance(dtype, T.StringType):
            value = F.coalesce(F.col(name), F.lit(""))
        elif isinstance(dtype, T.ArrayType):
            value = F.coalesce(F.col(name), F.array().cast(dtype))
        else:
            value = F.col(name)
        out.append(value.alias(name))
    return df.select(*out)
