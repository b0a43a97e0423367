"""Flattening of nested values to ``a::b`` paths, a list index counting as a segment."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.text import bound, last_key_wins, scalar_text, strict_json
from recordflow.operators.schema import SEP
from recordflow.runtime import cut_lineage

GROUP_COLUMNS = 1_000  # path columns of one table
LEVELS = 8  # of nesting that one pass opens


def flatten_struct(df: DataFrame, col: str, sep: str = SEP) -> DataFrame:
    """Replace a struct column by one column per leaf. Arrays and maps stay whole."""
    def walk(dtype: T.StructType, ref: Column, prefix: str):
        for field in dtype.fields:
            name = f"{prefix}{sep}{field.name}" if prefix else field.name
            inner = ref.getField(field.name)
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType, inner, name)
            else:
                yield inner.alias(name)

    others = [F.col(f"`{c}`") for c in df.columns if c != col]
    return df.select(*others, *walk(df.schema[col].dataType, F.col(f"`{col}`"), ""))


def _container(value: Column) -> Column:
    """True for an object or array variant: its JSON starts with a bracket, a scalar's never does."""
    return F.substring(F.to_json(value), 1, 1).isin("{", "[")


def _opened(rows: DataFrame, keep: list[str], sep: str, levels: int) -> DataFrame:
    """(keep, path, _v, _deeper) with the containers of so many levels opened in place; leaves pass.

    Only what is left at the end is looked at: an empty container opens to itself, as a leaf does.
    """
    spark = rows.sparkSession
    for _ in range(levels):
        opened = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
        segment = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        below = F.when(F.col("path") == "", segment).otherwise(F.concat_ws(sep, "path", segment))
        inside = F.col("pos").isNotNull()
        rows = opened.select(
            *keep,
            F.when(inside, below).otherwise(F.col("path")).alias("path"),
            F.when(inside, F.col("value")).otherwise(F.col("_v")).alias("_v"),
        )
    # The type of a scalar is found without writing it out; that of a container names its members.
    kind = F.schema_of_variant("_v")
    deeper = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    left = rows.where(F.col("_v").isNotNull()).withColumn("_deeper", deeper)
    return left.where(~F.col("_deeper") | ~F.to_json("_v").isin("{}", "[]"))


def flatten_paths(df: DataFrame, json_col: str, keep: list[str], sep: str = SEP,
                  max_depth: int | None = None) -> DataFrame:
    """Any JSON text -> (keep, path, value) rows, one per leaf, whatever the depth.

    Some levels are opened in one pass over the input without a shuffle; the result is stored, and
    containers that are left are opened in further passes over them alone. Texts that are not JSON and
    empty containers give no row, null leaves give a null value. Numbers read as they are written, NaN and
    Infinity are numbers, and of a repeated key the last one counts. A container left below a ``max_depth``
    that a caller sets fails the query rather than losing its leaves.
    """
    with last_key_wins(df.sparkSession):
        rows = df.select(*keep, F.lit("").alias("path"), strict_json(F.col(json_col), as_written=True).alias("_v"))
    found = []
    while True:
        deeper = F.col("_deeper")
        stored = cut_lineage(_opened(rows, keep, sep, max_depth or LEVELS).select(
            *keep, "path", "_deeper",
            F.when(deeper, F.col("_v")).alias("_v"), F.when(~deeper, scalar_text(F.col("_v"))).alias("value")), "paths")
        found.append(stored.where(~F.col("_deeper") & (F.col("path") != "")).select(*keep, "path", "value"))
        left = stored.where("_deeper")
        if left.isEmpty():
            break
        if max_depth:
            raise ValueError(f"nesting exceeds {max_depth} levels")
        rows = left.select(*keep, "path", "_v")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _step(segment: str) -> str | None:
    """A key as a step of a variant path, null if its quotes allow none."""
    return f"['{segment}']" if "'" not in segment else f'["{segment}"]' if '"' not in segment else None


def _leaf_at(variant: Column, path: str, sep: str) -> Column:
    """Text of the leaf at a path; null where the path is missing or leads to a container.

    A number as a segment may be an index or a key; each step takes whichever is there.
    """
    def inside(value: Column, segment: str) -> Column:
        named = F.try_variant_get(value, f"${_step(segment)}", "variant")
        return F.coalesce(named, F.try_variant_get(value, f"$[{segment}]", "variant")) if re.fullmatch(r"\d+", segment) else named

    found = variant
    for segment in path.split(sep):
        found = bound(found, partial(inside, segment=segment))
    return bound(found, lambda v: F.when(~_container(v), scalar_text(v)))


def flatten_wide(df: DataFrame, json_col: str, keep: list[str], paths: list[str] | None = None,
                 sep: str = SEP) -> DataFrame:
    """One text column per path over the union of all records.

    With a path list this is one projection. Without it the paths are found first and come as columns
    of groups of records (``flatten_groups``), one group if there are ``GROUP_COLUMNS`` at most; more are
    an error here, as no table should have so many columns.
    """
    if paths is not None and all(_step(s) for p in paths for s in p.split(sep)):
        with last_key_wins(df.sparkSession):
            parsed = df.select(*keep, strict_json(F.col(json_col), as_written=True).alias("_v"))
            return parsed.select(*keep, *[_leaf_at(F.col("_v"), p, sep).alias(p) for p in paths])
    groups = flatten_groups(df, json_col, keep, sep, paths=paths)
    if len(groups) > 1:
        raise ValueError(f"more than {GROUP_COLUMNS} distinct paths; take flatten_groups")
    return groups[0].drop("row_number")


def union_paths(df: DataFrame, json_col: str, sep: str = SEP) -> DataFrame:
    """(path, n_rows, n_null) over the union of all records: how many records have the leaf, and have it null."""
    found = flatten_paths(df, json_col, [], sep)
    return found.groupBy("path").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"))


def flatten_groups(df: DataFrame, json_col: str, keep: list[str], sep: str = SEP, width: int | None = None,
                   paths: list[str] | None = None) -> list[DataFrame]:
    """The wide form for unions of any size: tables of ``width`` path columns each, paths in order.

    Every table has all records with ``row_number``, which joins them, and the kept columns. Leaves are
    found once and stored as rows; a table gathers the leaves of its own paths per record, so a cell
    array never has more than ``width`` entries. Keys may hold any character. Only the names of the
    columns reach the driver.
    """
    width = width or GROUP_COLUMNS
    numbered = cut_lineage(df.select(*keep, F.col(json_col).alias("_json"), F.monotonically_increasing_id().alias("row_number")), "numbered")
    leaves = cut_lineage(flatten_paths(numbered, "_json", ["row_number"], sep), "leaves")
    if paths is None:
        paths = [r["path"] for r in leaves.select("path").distinct().orderBy("path").toLocalIterator()]
    out = []
    for start in range(0, max(len(paths), 1), width):
        names = paths[start:start + width]
        known = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(names)], "path string, place int")
        cells = leaves.join(F.broadcast(known), "path").groupBy("row_number").agg(
            F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("_cells"))
        rows = numbered.select("row_number", *keep).join(cells, "row_number", "left")
        out.append(rows.select("row_number", *keep, *[F.try_element_at("_cells", F.lit(i)).alias(p) for i, p in enumerate(names)]))
    return out
