"""Queries of typed values and the annotation store."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions import text as t
from recordflow.operators import flatten, store
from recordflow.operators import validation as v
from recordflow.operators.schema import target
from recordflow.plans.base import PRIORITIES, long_source, table


def entered(spark, sf_dir):
    """Texts as people enter them, built from the k of each event."""
    k = F.col("k")
    kind = F.col("event_id") % 10
    text = (
        F.when(kind == 0, F.concat(F.lit("  "), k, F.lit(" "))).when(kind == 1, F.concat(k, F.lit(".0")))
        .when(kind == 2, F.concat(k, F.lit("_000"))).when(kind == 3, F.concat(k, F.lit(".5")))
        .when(kind == 4, F.lit("Yes")).when(kind == 5, F.lit("on")).when(kind == 6, F.concat(k, F.lit("e3")))
        .when(kind == 7, F.lit("abc")).when(kind == 8, F.lit(" false")).otherwise(F.lit(""))
    )
    return long_source(spark, sf_dir).select("event_id", text.alias("entry"))


def q_lax_cast(spark, sf_dir):
    entry = F.col("entry")
    return entered(spark, sf_dir).select(
        "event_id", t.lax_cast(entry, T.LongType()).alias("as_int"), t.lax_cast(entry, T.DoubleType()).alias("as_float"),
        t.lax_cast(entry, T.BooleanType()).alias("as_bool"), t.lax_cast(entry, T.StringType()).alias("as_text"),
    )


def q_coerce_list_item(spark, sf_dir):
    columns = []
    for name, dtype in (("int", T.LongType()), ("float", T.DoubleType()), ("bool", T.BooleanType()), ("str", T.StringType())):
        value, error = t.coerce_list_item(F.col("entry"), dtype)
        columns += [value.alias(f"{name}_value"), error.alias(f"{name}_error")]
    return entered(spark, sf_dir).select("event_id", *columns)


def q_enum_or_null(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", v.enum_or_null(F.col("o_orderpriority"), PRIORITIES[:3]).alias("priority"),
        v.enum_or_null(F.col("o_orderstatus"), ["F", "O"]).alias("status"),
    )


def q_fill_form_defaults(spark, sf_dir):
    schema = T.StructType([
        target("quality", "int", required=True), target("toxic", "int"), target("score", "float", required=True),
        target("note", "str"), target("lang", "str", options=["en", "de"]), target("flag", "bool", required=True),
        target("tags", "str", many=True),
    ])
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"),
        (F.col("quality") * 0.5).alias("score"), F.lit("seen").alias("note"), (F.col("toxic") == 1).alias("flag"),
        F.array(F.lit("labelled")).alias("tags"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"))
    filled = v.fill_form_defaults(docs.join(labels, "doc_id", "left"), schema)
    return filled.withColumns({"tags": F.array_join("tags", "|"), "n_tags": F.size("tags").cast("bigint")})


def entries(spark, sf_dir):
    """A store entry per label, the document's columns as its source."""
    docs = table(spark, sf_dir, "documents")
    values = F.to_json(F.struct("quality", F.struct("toxic").alias("flags")))
    source = F.to_json(F.struct("lang", "source", "n_chars"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("row_index"), F.lit(1).cast("bigint").alias("version"),
        values.alias("values"), source.alias("source_data"),
    )


def updates(spark, sf_dir):
    """Later saves of the good rows: the toxic flag turned, twice where it was set."""
    again = F.when(F.col("toxic") == 1, F.array(*map(F.lit, (2, 3)))).otherwise(F.array(F.lit(2))).cast("array<bigint>")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_index"), "quality", "toxic")
    return labels.where(F.col("quality") == 1).select(
        "row_index", F.explode(again).alias("version"), "quality", "toxic"
    ).select(
        "row_index", "version",
        F.to_json(F.struct((F.col("quality") + F.col("version")).alias("quality"), F.struct((1 - F.col("toxic")).alias("toxic")).alias("flags"))).alias("values"),
        F.lit(None).cast("string").alias("source_data"),
    )


def q_upsert_extractions(spark, sf_dir):
    return store.upsert_extractions(entries(spark, sf_dir), updates(spark, sf_dir))


def _doc_ids(spark, sf_dir):
    """Documents with an id that is unset for some."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_index"), F.when(F.col("doc_id") % 4 != 0, F.concat("lang", F.lit("-"), "doc_id")).alias("given"),
    )


def q_assign_id(spark, sf_dir):
    return store.assign_id(_doc_ids(spark, sf_dir), "row_index", "given").select("row_index", "id")


def q_progress(spark, sf_dir):
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"))
    return store.progress(entries(spark, sf_dir).unionByName(updates(spark, sf_dir)), source)


def q_review_table(spark, sf_dir):
    saved = store.assign_id(entries(spark, sf_dir), "row_index")
    flat = flatten.flatten_wide(saved, "values", ["row_index", "id"], ["quality", "flags::toxic"])
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), "lang", "source", "n_chars")
    return store.review_table(flat, source)


def q_rebuild_source(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    columns = ["p_partkey", "p_name", "p_brand", "p_retailprice"]
    saved = part.select(F.when(F.col("p_partkey") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(*columns))).alias("source_data"))
    return store.rebuild_source(saved, part.select(*columns).schema)


QUERIES = {
    "lax_cast": q_lax_cast,
    "coerce_list_item": q_coerce_list_item,
    "enum_or_null": q_enum_or_null,
    "fill_form_defaults": q_fill_form_defaults,
    "upsert_extractions": q_upsert_extractions,
    "assign_id": q_assign_id,
    "progress": q_progress,
    "review_table": q_review_table,
    "rebuild_source": q_rebuild_source,
}

_ENTERED = """
  entered AS (
    SELECT event_id, event_id % 10 AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      CASE event_id % 10 WHEN 0 THEN '  ' || json_extract_string(props, '$.k') || ' ' WHEN 1 THEN json_extract_string(props, '$.k') || '.0'
        WHEN 2 THEN json_extract_string(props, '$.k') || '_000' WHEN 3 THEN json_extract_string(props, '$.k') || '.5'
        WHEN 4 THEN 'Yes' WHEN 5 THEN 'on' WHEN 6 THEN json_extract_string(props, '$.k') || 'e3' WHEN 7 THEN 'abc'
        WHEN 8 THEN ' false' ELSE '' END AS entry
    FROM events
  )"""

_ENTRIES = """
  entries AS (
    SELECT doc_id AS row_index, CAST(1 AS BIGINT) AS version,
      '{"quality":' || quality || ',"flags":{"toxic":' || toxic || '}}' AS values_json,
      '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS source_data, quality, toxic
    FROM labels JOIN documents USING (doc_id)
  )"""

_NUMBER = "CASE kind WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k * 1000 END"
_FLOAT = "CAST(CASE kind WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k * 1000 WHEN 3 THEN k + 0.5 WHEN 6 THEN k * 1000 END AS DOUBLE)"

ORACLE = {
    "lax_cast": f"""WITH {_ENTERED}
      SELECT event_id, {_NUMBER} AS as_int, {_FLOAT} AS as_float, CASE WHEN kind IN (4, 5) THEN true END AS as_bool, entry AS as_text
      FROM entered""",
    "coerce_list_item": f"""WITH {_ENTERED}
      SELECT event_id, CASE kind WHEN 0 THEN k WHEN 2 THEN k * 1000 END AS int_value,
        CASE WHEN kind = 9 THEN 'no item' WHEN kind NOT IN (0, 2) THEN 'invalid input' END AS int_error,
        {_FLOAT} AS float_value, CASE WHEN kind = 9 THEN 'no item' WHEN kind IN (4, 5, 7, 8) THEN 'invalid input' END AS float_error,
        CASE WHEN kind = 4 THEN true WHEN kind = 8 THEN false WHEN kind = 0 AND k = 1 THEN true WHEN kind = 0 AND k = 0 THEN false END AS bool_value,
        CASE WHEN kind = 9 THEN 'no item' END AS bool_error,
        CASE WHEN kind <> 9 THEN trim(entry) END AS str_value, CASE WHEN kind = 9 THEN 'no item' END AS str_error
      FROM entered""",
    "enum_or_null": """
      SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS priority,
             CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status
      FROM orders""",
    "fill_form_defaults": """
      SELECT doc_id, CAST(coalesce(quality, 0) AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic,
             CAST(coalesce(quality * 0.5, 0) AS DOUBLE) AS score, CASE WHEN quality IS NULL THEN '' ELSE 'seen' END AS note,
             CASE WHEN lang <> 'fr' THEN lang END AS lang, toxic = 1 AS flag,
             CASE WHEN quality IS NULL THEN '' ELSE 'labelled' END AS tags,
             CAST(CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_tags
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "upsert_extractions": f"""WITH {_ENTRIES}
      SELECT row_index, CAST(CASE WHEN quality = 1 AND toxic = 1 THEN 3 WHEN quality = 1 THEN 2 ELSE 1 END AS BIGINT) AS version,
        CASE WHEN quality = 1 THEN '{{"quality":' || (quality + CASE WHEN toxic = 1 THEN 3 ELSE 2 END) || ',"flags":{{"toxic":' || (1 - toxic) || '}}}}'
          ELSE values_json END AS "values",
        CASE WHEN quality <> 1 THEN source_data END AS source_data
      FROM entries""",
    "assign_id": """
      SELECT doc_id AS row_index, CASE WHEN doc_id % 4 <> 0 THEN lang || '-' || doc_id ELSE 'row_' || (doc_id + 1) END AS id FROM documents""",
    "progress": """
      SELECT count(l.doc_id) AS completed, count(*) AS total, round(count(l.doc_id) / count(*), 6) AS ratio
      FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "review_table": f"""WITH {_ENTRIES}
      SELECT row_index, 'row_' || (row_index + 1) AS id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS "flags::toxic",
             lang AS raw_lang, source AS raw_source, n_chars AS raw_n_chars
      FROM entries JOIN documents ON doc_id = row_index""",
    "rebuild_source": "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_partkey % 5 <> 0",
}
