"""File sources and sinks with the record layer's reading rules."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.text import lax_cast, null_if_na, strict_json
from recordflow.runtime import checked_broadcast, cut_lineage

_BAD = "_bad_line"
_PLACE = "_place"


def _field_count(line: Column, sep: str) -> Column:
    """Number of fields of a raw line: quoted fields are cut out, then separators counted."""
    mark = "\\" + sep
    bare = F.regexp_replace(line, rf'(^|{mark})"(?:[^"]|"")*"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _file_facts(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(file, first line, whether a quoted field may hold a line break) per file, from one pass over raw lines."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    facts = lines.groupBy("file").agg(F.min_by("value", "place").alias("first"), F.bool_or(odd).alias("open"))
    return sorted((unquote(r["file"]), r["first"].removeprefix("\ufeff"), r["open"]) for r in facts.collect())


def _csv_rows(spark: SparkSession, paths: str | list[str], names: list[str], options: dict[str, str], sep: str) -> DataFrame:
    """Text columns of files with one header, too long lines dropped, with the place of each row that stays."""
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD]])
    raw = (
        spark.read.options(**options).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD).schema(text_schema).csv(paths)
    )
    # Lines of the wrong length arrive flagged with their text; the short ones are kept.
    fits = F.col(_BAD).isNull() | (_field_count(F.col(_BAD), sep) <= len(names))
    return raw.where(fits).select(*[F.col(f"`{n}`") for n in names], F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias(_PLACE))


def number_rows(rows: DataFrame, out: str) -> DataFrame:
    """Row number from 0 over all files, by file name and place in the file, from the place of each row.

    Rows are stored once with the number that their task gave them; a row per file split is counted, summed
    up over the splits before it and joined back. No sort of the rows, and no order column needed.
    """
    stored = cut_lineage(rows, "file-rows")
    splits = stored.groupBy(F.col(f"{_PLACE}.file").alias("_file"), F.col(f"{_PLACE}.start").alias("_start")).agg(
        F.count("*").alias("_n"), F.min(f"{_PLACE}.row").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = stored.join(
        checked_broadcast(shifts), (F.col(f"{_PLACE}.file") == F.col("_file")) & (F.col(f"{_PLACE}.start") == F.col("_start")))
    return joined.withColumn(out, F.col(f"{_PLACE}.row") - F.col("_first") + F.col("_shift")).drop(_PLACE, "_file", "_start", "_first", "_shift")


def column_types(rows: DataFrame) -> dict[str, T.DataType]:
    """The narrowest type that all set values of each text column have: bool, int, float, or else text.

    Every column keeps one flag a type; flags of tasks are combined, so one pass over all rows settles all.
    A column without values is text. Whole numbers beyond 64 bits are floats.
    """
    kinds = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType()}

    def holds(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind == "bool":
            return value.isin("True", "TRUE", "true", "False", "FALSE", "false")
        plain = value.rlike(r"^\s*[+-]?[0-9]+\s*$") if kind == "int" else ~value.contains("_")
        return F.when(value.isNotNull(), plain & lax_cast(value, kinds[kind]).isNotNull())

    flags = rows.agg(F.lit(0).alias("_"), *[
        F.bool_and(holds(n, k)).alias(f"{k}_{i}") for i, n in enumerate(rows.columns) for k in kinds]).first()
    return {n: next((t for k, t in kinds.items() if flags[f"{k}_{i}"]), T.StringType()) for i, n in enumerate(rows.columns)}


def read_csv_lenient(spark: SparkSession, path: str, schema: T.StructType | None = None, *,
                     header: bool = True, sep: str = ",", keep_na: bool = False,
                     multiline: bool | None = None, infer: bool = False, row_index: str | None = None) -> DataFrame:
    """CSV where lines with too many fields are dropped and short lines are padded with nulls.

    Files are grouped by their header and aligned by name, a column that a file lacks being null; columns go by
    the schema, or without one by the first file, further names after. Fields may hold line breaks within
    quotes: files where a quote stays open at a line's end are read whole, all others are split across
    tasks (``multiline`` settles it for all files). Both need a pass over the raw lines; it is left out for
    a table without header or with a schema and ``multiline`` given, whose files then share one order.

    Missing tokens become null unless ``keep_na``. Declared types are cast leniently; text that does not fit is
    null. ``infer`` finds the types of text columns from all rows (``column_types``); whole numbers stay whole
    beside nulls. ``row_index`` adds the row's number from 0 by file name and place (``number_rows``).
    Text after a closing quote keeps its quotes.
    """
    options = {"header": str(header).lower(), "sep": sep, "escape": '"'}
    known = [f.name for f in schema.fields] if schema else []
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    if schema is not None and (multiline is not None or not header):
        groups[tuple(known), bool(multiline)] = [path]
    else:
        for file, first, opened in _file_facts(spark, path):
            names = next(csv.reader([first], delimiter=sep))
            names = names if header else [f"_c{i}" for i in range(len(names))]
            # a header that does not name the schema's columns is taken by position
            names = names if not known or set(known) <= set(names) else known
            groups.setdefault((tuple(names), opened if multiline is None else multiline), []).append(file)
    whole: DataFrame | None = None
    for (names, lines), files in groups.items():
        part = _csv_rows(spark, files, list(names), {**options, "multiLine": str(lines).lower()}, sep)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        fields = schema.fields if schema else []
        extra = [T.StructField(row_index, T.LongType())] if row_index else []
        return spark.createDataFrame([], T.StructType([*fields, *extra]))
    wanted = known or [c for c in whole.columns if c != _PLACE]
    if not keep_na:
        whole = whole.withColumns({n: null_if_na(F.col(f"`{n}`")) for n in wanted})
    rows = number_rows(whole, row_index) if row_index else whole
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    if infer and not schema:
        types = column_types(rows.select(*[F.col(f"`{n}`") for n in wanted]))
    return rows.select(
        *[lax_cast(F.col(f"`{n}`"), types.get(n, T.StringType())).alias(n) for n in wanted], *([row_index] if row_index else []))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None, *,
                      lines: bool = False) -> DataFrame:
    """JSON arrays of objects become rows, a single object one row.

    One file is one task unless the files hold a record per line (``lines``). Without a schema it is
    inferred in a pass of its own.
    """
    reader = spark.read.option("multiLine", str(not lines).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_other(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold no records (a bare value, or no JSON at all), as text with their name."""
    whole = spark.read.text(path, wholetext=True)
    first = F.substring(F.to_json(strict_json(F.col("value"))), 1, 1)
    records = F.coalesce(first.isin("[", "{"), F.lit(False))
    return whole.where(~records).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name and its whole text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def write_records_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines without their null fields."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_flat_csv(df: DataFrame, path: str, id_col: str | None = None, mode: str = "errorifexists") -> None:
    """Flat table as CSV with a header in every file; the id column comes first."""
    columns = [c for c in df.columns if c != id_col]
    ordered = ([id_col] if id_col else []) + columns
    df.select(*[F.col(f"`{c}`") for c in ordered]).write.mode(mode).option("header", True).option("escape", '"').csv(path)
