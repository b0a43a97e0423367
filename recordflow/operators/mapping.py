"""Rule-driven mapping of wide and long sources onto target paths.

A mapped table holds one column per target path. Where several values can meet it is an
``array<string>``: empty when nothing matched, one item for a single value, several when the field's
multi-value method keeps a list. Where the rules allow one value at most it is a plain column, of the
source's own type when the source value is passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.text import any_of, value_text
from recordflow.operators.schema import check_paths
from recordflow.runtime import cut_lineage, rank_in_groups

# Rule tables are configuration; this is the proven bound under which they are broadcast.
MAX_RULES = 10_000

# Values of one list in one part of a record; longer lists go on in further parts.
PART_VALUES = 1_000

# Column that numbers the parts of a record.
PART = "record_part"


@dataclass(frozen=True)
class Rule:
    """One mapping rule. A blank ``value`` passes the source value on; a set one is emitted on a match."""

    field: str
    column: str = ""
    value: str = ""
    slots: tuple[str, ...] = field(default_factory=tuple)
    method: str = "haveBoth"
    kind: str = "str"


def rules_from_table(rows) -> list[Rule]:
    """Rules from 10-column rule records (a rule file or accepted suggestions)."""
    def text(row, name):
        value = row[name] if name in row else None
        return "" if value is None else str(value)

    out = []
    for row in rows:
        row = row.asDict() if hasattr(row, "asDict") else row
        slots = tuple(
            s for s in (text(row, f"Observation_Value{n}") for n in ("", "2", "3", "4")) if s
        )
        out.append(Rule(
            text(row, "pydantic_field"), text(row, "Observation_ColName"), text(row, "pydantic_value"),
            slots, text(row, "multiValue_handling_method"), text(row, "pydantic_type"),
        ))
    return out


def by_field(rules: list[Rule]) -> dict[str, list[tuple[int, Rule]]]:
    """Rules with their order, grouped by field, fields sorted by path."""
    grouped: dict[str, list[tuple[int, Rule]]] = {}
    for position, rule in enumerate(rules):
        grouped.setdefault(rule.field, []).append((position, rule))
    check_paths(list(grouped))
    return dict(sorted(grouped.items()))


def methods(rules: list[Rule]) -> dict[str, str]:
    """Multi-value method per field: that of its first rule."""
    return {path: group[0][1].method for path, group in by_field(rules).items()}


def dedupe_candidates(values: Column) -> Column:
    """Drop nulls and keep each value at its first place, in one compiled function."""
    return F.array_except(values, F.array(F.lit(None).cast("string")))


def resolve_first(values: Column) -> Column:
    return F.slice(values, 1, 1)


def resolve_join(values: Column) -> Column:
    return F.when(F.size(values) > 1, F.array(F.array_join(values, ";"))).otherwise(values)


def resolve_both(values: Column) -> Column:
    return values


def resolve(values: Column, method: str) -> Column:
    """Apply a field's multi-value method to its ordered distinct candidates."""
    if method == "first":
        return resolve_first(values)
    if method == "join_semicolon":
        return resolve_join(values)
    return resolve_both(values)


def cell_text(column: Column, dtype: T.DataType) -> Column:
    """Flat form of a mapped column: null, the value as text, or a list as JSON text."""
    if not isinstance(dtype, T.ArrayType):
        return value_text(column, dtype)
    return F.when(F.size(column) > 1, F.to_json(column)).when(F.size(column) == 1, column[0])


def cell_value(column: Column, dtype: T.DataType) -> Column:
    """A mapped column for raw JSON: the value in its own type, lists as they are, null when empty."""
    return F.when(F.size(column) > 0, column) if isinstance(dtype, T.ArrayType) else column


def _present(column: str, dtype: T.DataType) -> Column:
    """The source value; a NaN counts as missing."""
    value = F.col(f"`{column}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def _accepted(rule: Rule, types: dict[str, T.DataType], literal: bool) -> list[tuple[str, Column | None]]:
    """Texts a targeted rule accepts, each with the condition it holds under."""
    if not literal:
        return [(text, None) for text in dict.fromkeys((rule.value, *rule.slots))]
    slots = [(slot, F.col(f"`{slot}`").isNotNull()) for slot in rule.slots if slot in types]
    return [(rule.value, None), *slots]


def _wide_output(rule: Rule, types: dict[str, T.DataType], literal: bool) -> Column:
    text = value_text(_present(rule.column, types[rule.column]), types[rule.column])
    if not rule.value:
        return text
    accepted = _accepted(rule, types, literal)
    always = [t for t, condition in accepted if condition is None]
    tests = [text.isin(*always)] + [condition & (text == t) for t, condition in accepted if condition is not None]
    return F.when(any_of(tests), F.lit(rule.value))


def _exclusive(rules: list[Rule], types: dict[str, T.DataType], literal: bool) -> bool:
    """True when at most one rule can match a row: targets on one column, no text accepted twice."""
    if not all(r.value for r in rules) or len({r.column for r in rules}) > 1:
        return False
    texts = [t for r in rules for t, _ in _accepted(r, types, literal)]
    return len(texts) == len(set(texts))


def _wide_field(group: list[tuple[int, Rule]], types: dict[str, T.DataType], literal: bool) -> Column:
    """The mapped column of one field, in the plainest form its rules allow."""
    method = group[0][1].method
    live = [rule for _, rule in group if rule.column in types]
    if not live:
        return F.lit(None).cast("string")
    if len(live) == 1 and not live[0].value:
        return _present(live[0].column, types[live[0].column])
    outputs = [_wide_output(rule, types, literal) for rule in live]
    if method == "first" or len(live) == 1 or _exclusive(live, types, literal):
        return F.coalesce(*outputs)
    return resolve(dedupe_candidates(F.array(*outputs)), method)


def map_wide(source: DataFrame, rules: list[Rule], keep: list[str], *, compat: str = "intended") -> DataFrame:
    """Map one record per source row. Rules compile to column expressions: no join, no shuffle.

    ``compat='literal'`` reads value slots as names of source columns: a slot counts only where that
    column exists and is set, and only against the slot's own text.
    """
    literal = compat == "literal"
    types = {f.name: f.dataType for f in source.schema.fields}
    columns = [_wide_field(group, types, literal).alias(path) for path, group in by_field(rules).items()]
    return source.select(*[F.col(f"`{k}`") for k in keep], *columns)


def flat_cells(mapped: DataFrame, paths: list[str], keep: list[str]) -> DataFrame:
    """One text column per path, in sorted path order, after the kept columns."""
    return mapped.select(
        *[F.col(f"`{k}`") for k in keep],
        *[cell_text(F.col(f"`{p}`"), mapped.schema[p].dataType).alias(p) for p in sorted(paths)],
    )


def map_wide_flat(source: DataFrame, rules: list[Rule], keep: list[str], *, compat: str = "intended") -> DataFrame:
    return flat_cells(map_wide(source, rules, keep, compat=compat), list(by_field(rules)), keep)


def _rule_rows(spark, rules: list[Rule]) -> DataFrame:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules exceed the supported {MAX_RULES}")
    named = [(position, rule) for position, rule in enumerate(rules) if rule.column]
    columns = {
        "rule_ord": pa.array([position for position, _ in named], pa.int32()),
        "field": pa.array([rule.field for _, rule in named], pa.string()),
        "_name": pa.array([rule.column for _, rule in named], pa.string()),
        "target": pa.array([rule.value for _, rule in named], pa.string()),
        "slots": pa.array([list(rule.slots) for _, rule in named], pa.list_(pa.string())),
    }
    # An Arrow table becomes a local relation: no job and no Python worker for the rule side.
    return spark.createDataFrame(
        pa.table(columns),
        "rule_ord int not null, field string not null, _name string not null, target string, slots array<string>",
    )


_WIDTH = "1" + "0" * 20


def pack_place(rule_ord: Column, row_ord: Column) -> Column:
    """(rule, row) as one decimal: a fixed-width buffer keeps the aggregation hash-based."""
    width = F.lit(_WIDTH).cast("decimal(21,0)")
    return rule_ord.cast("decimal(16,0)") * width + row_ord.cast("decimal(19,0)")


def unpack_place(place: Column) -> tuple[Column, Column]:
    width = F.lit(_WIDTH).cast("decimal(21,0)")
    rule_ord = F.round(place / width).cast("decimal(16,0)")
    return rule_ord.cast("bigint").alias("rule_ord"), (place - rule_ord * width).cast("bigint").alias("row_ord")


def first_places(rows: DataFrame, id_col: str) -> DataFrame:
    """Each distinct (id, field, value) at its least ``_place``."""
    first = rows.groupBy(id_col, "field", "value").agg(F.min("_place").alias("_place"))
    return first.select(id_col, "field", "value", *unpack_place(F.col("_place")))


def long_candidates(source: DataFrame, id_col: str, name_col: str, value_col: str, order_col: str,
                    rules: list[Rule]) -> DataFrame:
    """Distinct candidate values as rows: (id, field, value, rule_ord, row_ord).

    Unmapped names are dropped at the scan, the rules (bounded by ``MAX_RULES``) are broadcast, and
    the one shuffle is an aggregation keyed by the value as well, with map-side combine: an id that
    holds most of the rows spreads over as many tasks as it has distinct values. (rule_ord, row_ord)
    is the place of the value's first occurrence, so the order of a list survives without gathering
    it. A matched name with a target needs its text in the slots; without slots it never matches.
    """
    types = {f.name: f.dataType for f in source.schema.fields}
    if not isinstance(types[order_col], T.IntegralType):
        raise TypeError("the order column must be an integer")
    names = sorted({r.column for r in rules if r.column})
    value = value_text(_present(value_col, types[value_col]), types[value_col])
    emitted = F.when(F.col("target") == "", F.col("_value")).when(
        F.array_contains("slots", F.col("_value")), F.col("target")
    )
    matched = (
        source.where(F.col(id_col).isNotNull() & F.col(name_col).isin(names))
        .select(id_col, F.col(name_col).alias("_name"), value.alias("_value"), order_col)
        .join(F.broadcast(_rule_rows(source.sparkSession, rules)), "_name")
        .select(id_col, "field", emitted.alias("value"), pack_place(F.col("rule_ord"), F.col(order_col)).alias("_place"))
        .where(F.col("value").isNotNull())
    )
    return first_places(matched, id_col)


def _first_fields(rules: list[Rule]) -> list[str]:
    return [path for path, method in methods(rules).items() if method == "first"]


def long_rows(candidates: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """Row form of the long mapping: every kept value is a row, ordered by (rule_ord, row_ord).

    Nothing is gathered per id. Fields resolved by ``first`` reduce to their least row.
    """
    firsts = _first_fields(rules)
    place = F.struct("rule_ord", "row_ord", "value")
    one = (
        candidates.where(F.col("field").isin(firsts))
        .groupBy(id_col, "field").agg(F.min(place).alias("_best"))
        .select(id_col, "field", "_best.value", "_best.rule_ord", "_best.row_ord")
    )
    return candidates.where(~F.col("field").isin(firsts)).unionByName(one)


def in_parts(candidates: DataFrame, id_col: str, rules: list[Rule], part_values: int = PART_VALUES) -> DataFrame:
    """Candidates with ``record_part``: the part of the record, from 0, that holds the value.

    A list of n values takes ceil(n / part_values) parts of nearly equal length, in its order; a
    shorter list and a field resolved by ``first`` are in part 0. Only values of lists with several
    parts are ranked, by range partitions, so a list of any length spreads over many tasks.
    """
    listed = ~F.col("field").isin(_first_fields(rules))
    long_lists = (
        candidates.where(listed).groupBy(id_col, "field").agg(F.count("*").alias("_n"))
        .where(F.col("_n") > part_values)
    )
    ranked = rank_in_groups(
        candidates.join(long_lists, [id_col, "field"]), [id_col, "field"], ["rule_ord", "row_ord", "value"], "_rank")
    parts = F.ceil(F.col("_n") / part_values)
    split = ranked.withColumn("record_part", F.floor((F.col("_rank") - 1) * parts / F.col("_n")).cast("bigint"))
    whole = candidates.join(long_lists, [id_col, "field"], "left_anti")
    return whole.withColumn("record_part", F.lit(0).cast("bigint")).unionByName(split.drop("_n", "_rank"))


def map_long(source: DataFrame, id_col: str, name_col: str, value_col: str, order_col: str,
             rules: list[Rule], *, part_values: int = PART_VALUES,
             candidates: DataFrame | None = None) -> DataFrame:
    """The mapped record of every non-null id, matched or not, the id as ``record_id``, in parts.

    ``record_part`` counts from 0. Every id has part 0 with its single values and the start of each
    list; a list of more than ``part_values`` distinct values goes on in further parts (``in_parts``),
    so nothing is lost and no cell, task or group grows with an id. Reduced candidates are stored once;
    they meet the distinct ids in one aggregation by id and part, which combines before the shuffle.
    ``candidates`` may pass a stored table of ``long_candidates`` rows.
    """
    if candidates is None:
        candidates = cut_lineage(long_candidates(source, id_col, name_col, value_col, order_col, rules), "candidates")
    place = F.struct("rule_ord", "row_ord", "value")
    ids = source.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    rows = (
        in_parts(candidates, id_col, rules, part_values).select(id_col, "record_part", "field", place.alias("_p"))
        .unionByName(ids.select(
            id_col, F.lit(0).cast("bigint").alias("record_part"), F.lit(None).cast("string").alias("field"),
            F.lit(None).cast("struct<rule_ord:bigint,row_ord:bigint,value:string>").alias("_p")))
    )
    aggregates, finish = [], []
    for i, (path, method) in enumerate(methods(rules).items()):
        mine = F.when(F.col("field") == path, F.col("_p"))
        if method == "first":
            aggregates.append(F.min(mine).alias(f"_f{i}"))
            finish.append(F.col(f"_f{i}.value").alias(path))
        else:
            aggregates.append(F.collect_list(mine).alias(f"_f{i}"))
            ordered = F.sort_array(F.col(f"_f{i}"))["value"]
            finish.append(resolve(ordered, method).alias(path))
    grouped = rows.groupBy(id_col, "record_part").agg(*aggregates)
    return grouped.select(F.col(id_col).alias("record_id"), "record_part", *finish)


def map_long_flat(source: DataFrame, id_col: str, name_col: str, value_col: str, order_col: str,
                  rules: list[Rule], **options) -> DataFrame:
    """Flat form: the id and the part first, then one text column per path in sorted order. A path named like the
    id column takes its place."""
    mapped = map_long(source, id_col, name_col, value_col, order_col, rules, **options)
    flat = [cell_text(F.col(f"`{p}`"), mapped.schema[p].dataType).alias(p) for p in sorted(by_field(rules))]
    lead = [] if id_col in by_field(rules) else [F.col("record_id").alias(id_col)]
    return mapped.select(*lead, "record_part", *flat)
