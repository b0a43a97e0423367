"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recordflow.runtime import cut_lineage

# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

# Bits of a membership bitmap: 4 MiB whatever the input, so it may always be broadcast.
BITMAP_BITS = 1 << 25
_SLICE = 500           # texts that a task judges at once
_BUCKET_BITS = 32_768  # bits of one bitmap that bitmap_construct_agg builds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send this module's functions to Python workers by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it while a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_text(docs: DataFrame, text: str, out: str, kind: str, values: Callable[[Iterator[str]], list]) -> DataFrame:
    """Every row with ``out``: what ``values`` gives for the batch's whole texts, null texts as empty ones.

    One narrow pass in slices of Arrow batches; the other columns go through untouched, whatever their
    types. A text column of strings is sent to Python once.
    """
    carried = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    schema = carried.withColumn(out, F.lit(None).cast(kind)).schema
    width = len(carried.columns)
    if text in carried.columns and carried.schema[text].dataType == StringType():
        frame, at = carried, carried.columns.index(text)
    else:
        words = fresh(docs, "_words")
        frame = docs.select(*[F.col(f"`{c}`") for c in carried.columns], text_or_empty(f"`{text}`").alias(words))
        at = width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                added = pa.array(values(x.as_py() or "" for x in part.column(at)), type=types[kind])
                yield pa.RecordBatch.from_arrays([*part.columns[:width], added], names=[*part.schema.names[:width], out])

    return frame.mapInArrow(run, schema)


def crc_of(column: str) -> Column:
    """CRC-32 of a value's text; null where the value is null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bitmap_of(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Set membership as rows (slot, bitmap) of at most ``bits`` / 32,768 rows of 4 KiB.

    A key sets the bit at its remainder. A clear bit proves absence; a set bit may be another key's,
    which costs work but no result. The size is fixed by ``bits``, not by the data.
    """
    place = F.pmod(F.col(key), F.lit(bits)) + 1  # the bitmap functions count from 1
    return keys.groupBy(F.bitmap_bucket_number(place).alias("slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def in_bitmap(df: DataFrame, key: Column, bitmap: DataFrame, out: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Add ``out``: whether the key's bit is set. The bitmap has a fixed size and is broadcast."""
    place = F.pmod(key, F.lit(bits)) + 1
    position = F.bitmap_bit_position(place)
    slot, bits_col = fresh(df, "_slot"), fresh(df, "_bitmap")
    named = bitmap.select(F.col("slot").alias(slot), F.col("bitmap").alias(bits_col))
    joined = df.join(F.broadcast(named), F.bitmap_bucket_number(place) == F.col(slot), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits_col), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1
    return joined.withColumn(out, F.coalesce(is_set, F.lit(False))).drop(slot, bits_col)


def bitmap_bytes(bitmap: DataFrame, bits: int = BITMAP_BITS) -> bytes:
    """The bitmap as one byte string on the driver; its size is fixed by ``bits``."""
    whole = bytearray(bits // 8)
    size = _BUCKET_BITS // 8
    for row in bitmap.collect():
        start = (row["slot"] - 1) * size
        whole[start:start + size] = row["bitmap"]
    return bytes(whole)


def total_before(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come earlier.

    Range partitions are stored once with their number; sums run inside (partition, group) and are
    shifted by the group's sums in earlier partitions, so a hot group is spread over many tasks.
    ``group`` columns hold no nulls; the order within ties is stored and so stays the same.
    """
    part, size, shift = fresh(df, "_part"), fresh(df, "_size"), fresh(df, "_shift")
    stored = cut_lineage(
        df.repartitionByRange(*[F.col(f"`{c}`") for c in [*group, *order]])
        .sortWithinPartitions(*group, *order)
        .withColumn(part, F.spark_partition_id()), "ranges")
    sizes = stored.groupBy(part, *group).agg(F.sum(value).alias(size))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(part, *group, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(shift))
    inside = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.join(shifts, [part, *group])
        .withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(shift))
        .drop(part, shift))
