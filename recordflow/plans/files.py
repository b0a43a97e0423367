"""Queries of the file sources and sinks and of the streaming mapping.

Files are derived from the tables, written under the shared scratch folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.operators import mapping as m
from recordflow.plans import mapping as mapping_plans
from recordflow.plans.base import LONG_RULES, WIDE_RULES, WIDE_SCHEMA, table
from recordflow.operators import validation as v
from recordflow.runtime import scratch_path
from recordflow.sources import files
from recordflow.streaming import long_records as stream


def q_read_csv_lenient(spark, sf_dir):
    """Parts as CSV lines: some too long, some short, some with missing tokens or quoted separators."""
    key = F.col("p_partkey")
    line = (
        F.when(key % 10 == 0, F.concat_ws(",", key, "p_name", "p_brand", "p_size", F.lit("extra")))
        .when(key % 10 == 1, F.concat_ws(",", key, "p_name", "p_brand", "p_size", F.lit("")))
        .when(key % 10 == 2, F.concat_ws(",", key, "p_name"))
        .when(key % 10 == 3, F.concat_ws(",", key, F.lit("NA"), F.lit("None"), "p_size"))
        .when(key % 10 == 4, F.concat_ws(",", key, F.concat(F.lit('"a, ""'), F.col("p_name"), F.lit('"""')), "p_brand", F.lit("n/a")))
        .when(key % 10 == 5, F.concat_ws(",", key, F.concat(F.lit('"x,'), F.col("p_name"), F.lit('"'))))
        .otherwise(F.concat_ws(",", key, "p_name", "p_brand", "p_size"))
    )
    path = scratch_path(spark, "lenient")
    lines = table(spark, sf_dir, "part").select(line.alias("key,name,brand,size"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("brand", T.StringType()), T.StructField("size", T.LongType()),
    ])
    return files.read_csv_lenient(spark, path, schema)


def q_read_csv_files(spark, sf_dir):
    """Two tables of part files whose columns stand in different order, one with line breaks in quotes: types of
    all rows and the row's number over all files."""
    path = scratch_path(spark, "csv-files")
    part = table(spark, sf_dir, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    first, second = part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1")
    first.select("p_partkey", F.concat(F.lit("a\n"), "p_name").alias("name"), F.when(F.col("p_size") > 9, F.col("p_size")).alias("size")).write.option(
        "header", True).option("escape", '"').csv(f"{path}/n=1")
    second.select(
        F.concat("p_size", F.lit(".0")).alias("size"), "p_partkey", (F.col("p_size") > 9).alias("big"), F.col("p_name").alias("name")
    ).write.option("header", True).csv(f"{path}/n=2")
    return files.read_csv_lenient(spark, f"{path}/*", infer=True, row_index="row_index")


def q_csv_without_order(spark, sf_dir):
    """Events as files without an order column: the row number orders the long mapping and names failed rows."""
    path = scratch_path(spark, "events")
    source = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "event_id")
    source.repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("k", T.StringType())])
    rows = files.read_csv_lenient(spark, path, schema, row_index="row_index")
    return m.map_long_flat(rows, "user_id", "event_type", "k", "row_index", LONG_RULES, part_values=mapping_plans.SHORT_PARTS)


def q_quarantine_by_row(spark, sf_dir):
    """Orders as files without an index: failed rows are named by their number."""
    path = scratch_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    orders.select("o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    rows = files.read_csv_lenient(spark, path, infer=True, row_index="row_index")
    rules = [m.Rule("order_id", "o_orderkey"), m.Rule("status", "o_orderstatus", "Open", ("O",))]
    target = T.StructType([T.StructField("order_id", T.LongType(), False), T.StructField("status", T.StringType(), False)])
    checked = v.validate_rows(m.map_wide(rows, rules, ["row_index"]), target, ["row_index"], raw=True)
    return v.quarantine(checked, v.wide_identifier(F.col("row_index")))


def q_read_json_records(spark, sf_dir):
    """Parts written as JSON, a document per line: arrays of one object and bare objects."""
    item = F.to_json(F.struct("p_partkey", "p_name", "p_retailprice"))
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(item)
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    schema = T.StructType([
        T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_retailprice", T.DoubleType()),
    ])
    return files.read_json_records(spark, path, schema, lines=True)


def q_read_text_docs(spark, sf_dir):
    """Documents written as text files of at most five hundred each, compared by length and lines."""
    path = scratch_path(spark, "texts")
    table(spark, sf_dir, "documents").select("text").write.option("maxRecordsPerFile", 500).text(path)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.read_text_docs(spark, path).agg(
        F.sum(F.length("text")).cast("bigint").alias("characters"), F.sum(breaks).cast("bigint").alias("lines")
    )


def q_write_records_json(spark, sf_dir):
    mapped = m.map_wide(table(spark, sf_dir, "orders"), WIDE_RULES, ["o_orderkey"])
    records = v.validate_rows(mapped, WIDE_SCHEMA, ["o_orderkey"]).where("valid").select("record.*")
    path = scratch_path(spark, "records")
    files.write_records_json(records, path)
    return spark.read.text(path).withColumnRenamed("value", "record_json")


def q_write_flat_csv(spark, sf_dir):
    flat = mapping_plans.q_map_wide_flat(spark, sf_dir)
    path = scratch_path(spark, "flat")
    files.write_flat_csv(flat, path, "o_orderkey")
    names = ["o_orderkey"] + [c for c in flat.columns if c != "o_orderkey"]
    schema = T.StructType([T.StructField(c, T.LongType() if c == "o_orderkey" else T.StringType()) for c in names])
    return files.read_csv_lenient(spark, path, schema)


def q_stream_long_records(spark, sf_dir):
    """The events as a file stream, reduced batch by batch."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    source = events.select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "event_id")
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "stream")
    query = stream.start_long_records(source, *mapping_plans.LONG_ARGS, LONG_RULES, log, checkpoint)
    query.awaitTermination()
    return stream.long_records(spark, log, "user_id", LONG_RULES, part_values=mapping_plans.SHORT_PARTS)


def q_stream_batches(spark, sf_dir):
    """The events in eight files, a batch each, later ones first; the last batch is merged twice."""
    folder, log = scratch_path(spark, "event-files"), scratch_path(spark, "log")
    source = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "event_id")
    # Ranges are found on the plain columns: their sample reads all rows, and would read each JSON text too.
    ranged = table(spark, sf_dir, "events").select("user_id", "event_type", "props", "event_id").repartitionByRange(8, F.col("event_id").desc())
    ranged.select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "event_id").write.parquet(folder)
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.start_long_records(events, *mapping_plans.LONG_ARGS, LONG_RULES, log, scratch_path(spark, "stream"), buckets=4)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    stream.merge_batch(*mapping_plans.LONG_ARGS, LONG_RULES, log, buckets=4)(source.where("event_id % 7 = 0"), last + 1)
    stream.merge_batch(*mapping_plans.LONG_ARGS, LONG_RULES, log, buckets=4)(source.where("event_id % 7 = 0"), last + 1)
    return stream.long_records(spark, log, "user_id", LONG_RULES, part_values=mapping_plans.SHORT_PARTS)


QUERIES = {
    "read_csv_lenient": q_read_csv_lenient,
    "read_csv_files": q_read_csv_files,
    "csv_without_order": q_csv_without_order,
    "quarantine_by_row": q_quarantine_by_row,
    "read_json_records": q_read_json_records,
    "read_text_docs": q_read_text_docs,
    "write_records_json": q_write_records_json,
    "write_flat_csv": q_write_flat_csv,
    "stream_long_records": q_stream_long_records,
    "stream_batches": q_stream_batches,
}

ORACLE = {
    "read_csv_lenient": """
      SELECT p_partkey AS key,
        CASE p_partkey % 10 WHEN 3 THEN NULL WHEN 4 THEN 'a, "' || p_name || '"' WHEN 5 THEN 'x,' || p_name ELSE p_name END AS name,
        CASE WHEN p_partkey % 10 NOT IN (2, 3, 5) THEN p_brand END AS brand,
        CASE WHEN p_partkey % 10 NOT IN (2, 4, 5) THEN CAST(p_size AS BIGINT) END AS size
      FROM part WHERE p_partkey % 10 > 1""",
    "read_csv_files": """
      WITH placed AS (SELECT *, p_partkey % 2 AS odd, row_number() OVER (ORDER BY p_partkey % 2, p_partkey) - 1 AS row_index FROM part)
      SELECT p_partkey, CASE WHEN odd = 0 THEN 'a' || chr(10) || p_name ELSE p_name END AS name,
        CASE WHEN odd = 1 OR p_size > 9 THEN p_size::DOUBLE END AS size, CASE WHEN odd = 1 THEN p_size > 9 END AS big, row_index FROM placed""",
    "csv_without_order": mapping_plans.ORACLE["map_long_flat"],
    "quarantine_by_row": """
      SELECT 'Wide format, index ' || row_index AS row_identifier, 'status: string_type' AS error, '{"order_id":' || o_orderkey || '}' AS data
      FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders) WHERE o_orderstatus <> 'O'""",
    "read_json_records": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "read_text_docs": """
      SELECT CAST(sum(length(text) + 1) AS BIGINT) AS characters,
             CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines
      FROM documents""",
    "write_records_json": f"SELECT record_json FROM ({mapping_plans.ORACLE['records_json']})",
    "write_flat_csv": mapping_plans.ORACLE["map_wide_flat"],
    "stream_long_records": mapping_plans.ORACLE["map_long_flat"],
    "stream_batches": mapping_plans.ORACLE["map_long_flat"],
}
