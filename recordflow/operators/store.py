"""Annotation store: entries (row_index, id, values, source_data), both payloads as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert_extractions(store: DataFrame, updates: DataFrame, key: str = "row_index", version: str = "version") -> DataFrame:
    """The latest entry per row. An aggregation, so a row saved very often reduces map-side.

    Ties in ``version`` go to the entry that sorts last over the remaining columns.
    """
    rows = store.unionByName(updates)
    others = [c for c in rows.columns if c not in (key, version)]
    entry = F.struct(version, *others)
    latest = rows.groupBy(key).agg(F.max(entry).alias("_entry"))
    return latest.select(key, *[F.col(f"_entry.{c}").alias(c) for c in rows.columns if c != key])


def assign_id(df: DataFrame, row_index: str, id_col: str | None = None, out: str = "id") -> DataFrame:
    """Id from the chosen column where it is set (not null, empty or zero), else ``row_<index + 1>``."""
    fallback = F.concat(F.lit("row_"), (F.col(row_index) + 1).cast("string"))
    if not id_col or id_col not in df.columns:
        return df.withColumn(out, fallback)
    unset = F.lit("") if isinstance(df.schema[id_col].dataType, T.StringType) else F.lit(0)
    return df.withColumn(out, F.coalesce(F.when(F.col(id_col) != unset, F.col(id_col).cast("string")), fallback))


def progress(store: DataFrame, source: DataFrame, key: str = "row_index") -> DataFrame:
    """Completed and total rows, and their ratio. Repeated saves of a row count once."""
    done = store.select(key).distinct().withColumn("_done", F.lit(True))
    joined = source.select(key).join(done, key, "left")
    return joined.agg(
        F.count_if("_done").alias("completed"), F.count("*").alias("total"),
    ).withColumn("ratio", F.round(F.try_divide("completed", "total"), 6))


def review_table(store: DataFrame, source: DataFrame, key: str = "row_index", flat: list[Column] | None = None) -> DataFrame:
    """Saved values, row index, id and the source columns under ``raw_`` names."""
    raw = source.select(F.col(key), *[F.col(c).alias(f"raw_{c}") for c in source.columns if c != key])
    values = flat if flat is not None else [F.col(c) for c in store.columns if c not in (key, "id")]
    return store.select(key, "id", *values).join(raw, key, "left")


def rebuild_source(store: DataFrame, schema: T.StructType, column: str = "source_data") -> DataFrame:
    """Source rows back from their stored JSON; entries without source data are skipped."""
    kept = store.where(F.col(column).isNotNull() & ~F.trim(column).isin("", "{}", "null"))
    return kept.select(F.from_json(column, schema).alias("_row")).select("_row.*")
