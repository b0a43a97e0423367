"""Column and observation profiles: first distinct values and first values, in source order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.functions.text import value_text
from recordflow.runtime import distributed_rank

N_DISTINCT = 10
N_SAMPLE = 3

# Rows of state after which a task hands on what it has and starts anew; states merge in any order.
_STATE_ROWS = 200_000
_TEXT_BLOCKS = 1_000
_ORDER = [("key", "ascending"), ("place", "ascending"), ("value", "ascending")]


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=_ORDER, null_placement="at_start")).combine_chunks()


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number per row and the values by number, null being a value."""
    whole = column.combine_chunks().dictionary_encode(null_encoding="encode")
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.indices.to_numpy(zero_copy_only=False), whole.dictionary.to_pylist()


def _leading(rows: pa.Table, count: int) -> pa.Table:
    """The first ``count`` rows per key of sorted rows."""
    if not rows.num_rows:
        return rows
    codes, _ = _codes(rows["key"])
    at = np.arange(len(codes))
    begins = np.r_[True, codes[1:] != codes[:-1]]
    return rows.filter(pa.array(at - np.maximum.accumulate(np.where(begins, at, 0)) < count))


def _distinct(rows: pa.Table) -> pa.Table:
    """The first row of each (key, value) of sorted rows, in their order."""
    if not rows.num_rows:
        return rows
    numbered = rows.select(["key", "value"]).append_column("at", pa.array(np.arange(rows.num_rows)))
    first = numbered.group_by(["key", "value"]).aggregate([("at", "min")])["at_min"]
    return rows.take(pa.array(np.sort(first.to_numpy())))


def _within(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """Without the rows that lie after the last of a key's ``N_DISTINCT`` first values."""
    held: dict = {}
    for key, place in zip(firsts["key"].to_pylist(), firsts["place"]):
        held.setdefault(key, []).append(place)
    codes, keys = _codes(rows["key"])
    full = [held[k][-1].as_py() if len(held.get(k, ())) >= N_DISTINCT else None for k in keys]
    if all(b is None for b in full):
        return rows
    bounds = pa.array(full, rows.schema.field("place").type).take(pa.array(codes))
    return rows.filter(pc.fill_null(pc.less_equal(rows["place"], bounds), True))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First distinct values and first values per key of a task's rows (key, value, place).

    A task keeps ``N_DISTINCT`` and ``N_SAMPLE`` rows a key. The first of all rows are among those of
    the tasks, so states of tasks merge by taking the first again.
    """
    firsts = sample = None

    def out(firsts: pa.Table, sample: pa.Table) -> Iterator[pa.RecordBatch]:
        for rows, kind in ((firsts, True), (sample, False)):
            yield from rows.append_column("first", pa.array([kind] * rows.num_rows, pa.bool_())).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        if firsts is not None:
            rows = _within(rows, firsts)
            if not rows.num_rows:
                continue
        rows = _sorted(rows)
        some, few = _leading(_distinct(rows), N_DISTINCT), _leading(rows, N_SAMPLE)
        if firsts is not None:
            some = _leading(_distinct(_sorted(pa.concat_tables([firsts, some]))), N_DISTINCT)
            few = _leading(_sorted(pa.concat_tables([sample, few])), N_SAMPLE)
        firsts, sample = some, few
        if firsts.num_rows > _STATE_ROWS:
            yield from out(firsts, sample)
            firsts = sample = None
    if firsts is not None:
        yield from out(firsts, sample)


def _values(rows: Column) -> Column:
    """The values of (place, value, n) rows, each n times, in place order."""
    return F.flatten(F.transform(F.sort_array(rows), lambda r: F.array_repeat(r["value"], F.least(r["n"], F.lit(N_SAMPLE)).cast("int"))))


def _summary(rows: DataFrame) -> DataFrame:
    """(key, begins, unique_values, sample) of rows (key, value, place), which are read once and not shuffled.

    Rows without a place come first.
    Only the states of the tasks move: by value first, then the least-placed few of each key.
    """
    kinds = dict(rows.dtypes)
    states = rows.mapInArrow(_states, f"key {kinds['key']}, value string, place {kinds['place']}, first boolean")
    merged = states.groupBy("key", "first", "value", F.when(~F.col("first"), F.col("place")).alias("own")).agg(
        F.min(F.struct("place"))["place"].alias("place"), F.count("*").alias("n"))
    order = Window.partitionBy("key", "first").orderBy("place", "value")
    leading = merged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= N_DISTINCT)
    found = F.struct("place", "value", F.when(F.col("first"), F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("n"))
    return leading.groupBy("key").agg(
        F.min(F.struct("place"))["place"].alias("begins"),
        F.collect_list(F.when(F.col("first"), found)).alias("firsts"),
        F.collect_list(F.when(~F.col("first"), found)).alias("heads"),
    ).select(
        "key", "begins", F.to_json(_values(F.col("firsts"))).alias("unique_values"),
        F.to_json(F.slice(_values(F.col("heads")), 1, N_SAMPLE)).alias("sample"))


def _unpivot(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("key"), value_text(F.col(f"`{c}`"), types[c]).alias("value"))
        for i, c in enumerate(columns, 1)
    ])
    return df.select(F.col(order).alias("place"), F.inline(cells)).select("key", "value", "place")


def profile_wide(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """Per column: position, name, type, first distinct values (null counts) and first values, in one pass.

    Rows of one place are taken by value, null first. Each task keeps a few rows a column, so neither
    many values nor many rows of a column move.
    """
    columns = columns or df.columns
    types = dict(df.dtypes)
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type")) for c in columns])
    info = F.element_at(names, F.col("key").cast("int"))
    return _summary(_unpivot(df, columns, order)).select(
        F.col("key").alias("position"), info["column"].alias("column"), info["type"].alias("type"), "unique_values", "sample")


def profile_long(df: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """The same per observation name, null being one; names numbered by first appearance, those of one place by
    name (the numbered profile is stored, so building the plan runs a job)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(F.col(name).alias("key"), value_text(F.col(value), types[value]).alias("value"), F.col(order).alias("place"))
    return distributed_rank(_summary(rows), ["begins", "key"], "position").select(
        "position", F.col("key").alias("observation"), F.lit(dict(df.dtypes)[value]).alias("type"), "unique_values", "sample")


def profile_text(profile: DataFrame) -> DataFrame:
    """Numbered text blocks joined by ``---`` lines, at most a thousand blocks to a part."""
    wide = "column" in profile.columns
    label, kind = ("Column", "Type") if wide else ("Observation", "Value type")
    subject = F.col("column" if wide else "observation")
    block = F.concat(
        F.col("position").cast("string"), F.lit(f". {label}: "), subject, F.lit(f"\n{kind}: "), F.col("type"),
        F.lit("\nUnique values: "), F.col("unique_values"), F.lit("\nSample: "), F.col("sample"), F.lit("\n"),
    )
    part = F.floor((F.col("position") - 1) / _TEXT_BLOCKS).cast("bigint").alias("part")
    pairs = F.sort_array(F.collect_list(F.struct("position", block.alias("block"))))
    return profile.groupBy(part).agg(F.array_join(F.transform(pairs, lambda p: p["block"]), "\n---\n").alias("text"))
