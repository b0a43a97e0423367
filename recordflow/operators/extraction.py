"""Extraction over documents: prompts, batched calls of a user's client, and parsing of the answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.text import bound, lax_cast, strict_json
from recordflow.operators.schema import SEP, leaf_map, options_of
from recordflow.operators.validation import type_name, validate_rows

RESULT_SCHEMA = "execution_time double, generation_success boolean, raw_response string, error string"


@dataclass(frozen=True)
class PromptConfig:
    """Message and model settings of one set-up."""

    name: str
    system_message: str
    pre_prompt: str = ""
    model_name: str = ""
    temperature: float = 0.2


def build_extraction_prompts(docs: DataFrame, text: str, keep: list[str], configs: list[PromptConfig],
                             shots: list[tuple[str, str]] | None = None) -> DataFrame:
    """One prompt per document and set-up: pre-prompt, few-shot block, then the whole text.

    Set-ups are configuration carried in the plan, so documents are not joined or shuffled.
    """
    examples = "\n\n".join(f"Text: {t}\nAnswer: {a}" for t, a in shots or [])
    rows = F.array(*[
        F.struct(
            F.lit(c.name).alias("config"), F.lit(c.system_message).alias("system_message"),
            F.lit(c.pre_prompt).alias("_pre"), F.lit(c.model_name).alias("model_name"),
            F.lit(float(c.temperature)).alias("temperature"),
        )
        for c in configs
    ])
    staged = docs.select(*keep, F.col(text).alias("_text"), F.inline(rows))
    prompt = F.concat_ws(
        "\n\n", F.when(F.col("_pre") != "", F.col("_pre")), F.lit(examples or None).cast("string"), F.col("_text")
    )
    return staged.select(*keep, "config", "system_message", "model_name", "temperature", prompt.alias("prompt"))


def batch_extract(docs: DataFrame, text: str, keep: list[str], make_client: Callable[[], Callable[[list[str]], list[str]]],
                  partitions: int | None = None) -> DataFrame:
    """Call a user's client over batches of texts; one result row per input row.

    ``make_client`` runs once per task. A batch that raises is retried text by text, and a text that
    raises again becomes a failed row, not a failed job. ``partitions`` spreads the input over that
    many tasks, which is the limit on concurrent clients.
    """
    source = docs.select(*keep, text)
    if partitions:
        source = source.repartition(partitions)

    def answers(client, texts: list[str]) -> Iterator[tuple]:
        start = time.perf_counter()
        try:
            replies = list(client(texts))
            if len(replies) != len(texts):
                raise ValueError("one reply per text expected")
            spent = (time.perf_counter() - start) / max(len(texts), 1)
            for reply in replies:
                yield spent, True, reply, None
        except Exception:
            for one in texts:
                start = time.perf_counter()
                try:
                    reply = list(client([one]))[0]
                    yield time.perf_counter() - start, True, reply, None
                except Exception as failure:
                    yield time.perf_counter() - start, False, None, str(failure)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            result = pd.DataFrame(
                list(answers(client, batch[text].tolist())),
                columns=["execution_time", "generation_success", "raw_response", "error"],
            )
            kept = batch[keep].reset_index(drop=True)
            yield pd.concat([kept, result], axis=1)

    kept_fields = [docs.schema[c] for c in keep]
    schema = T.StructType(kept_fields + T.StructType.fromDDL(RESULT_SCHEMA).fields)
    return source.mapInPandas(run, schema)


def _kind_errors(path: str, field: T.StructField, leaf: Column) -> Column:
    """Errors of one leaf that its JSON kind shows, as an array of texts; null where there are none.

    Text takes JSON strings only, a list field takes lists only, and a null is no item of a list.
    """
    kind = F.schema_of_variant(leaf)
    given = leaf.isNotNull() & (kind != "VOID")
    if not isinstance(field.dataType, T.ArrayType):
        return F.when(given & (kind != "STRING"), F.lit(f"{path}: string_type")) if isinstance(field.dataType, T.StringType) else F.lit(None).cast("string")
    element = field.dataType.elementType
    items = F.transform(F.try_variant_get(leaf, "$", "array<variant>"), F.schema_of_variant)
    text = isinstance(element, T.StringType)
    wrong = F.exists(items, lambda k: k != "STRING") if text else F.exists(items, lambda k: k == "VOID")
    return F.when(given & ~kind.startswith("ARRAY"), F.lit(f"{path}: list_type")).when(wrong, F.lit(f"{path}: {type_name(element)}_type"))


def _typed_leaf(path: Column, field: T.StructField, given: Column) -> Column:
    """struct<value, errors> of one leaf inside a list of records, the leaf held as a variant."""
    many = isinstance(field.dataType, T.ArrayType)
    dtype = field.dataType.elementType if many else field.dataType
    kind = F.schema_of_variant(given)
    absent = given.isNull() | (kind == "VOID")
    options = options_of(field)
    name = "enum" if options else f"{type_name(dtype)}_parsing"

    def typed(text: Column) -> Column:
        return F.when(text.isin(*options), text) if options else lax_cast(text, dtype)

    def error(what: str) -> Column:
        return F.concat(path, F.lit(f": {what}"))

    is_text = isinstance(dtype, T.StringType)
    if many:
        items = F.try_variant_get(given, "$", "array<variant>")
        texts = F.try_variant_get(given, "$", "array<string>")
        kinds = F.transform(items, F.schema_of_variant)
        value = F.transform(texts, typed)
        wrong = F.exists(kinds, lambda k: k != "STRING") if is_text else F.exists(kinds, lambda k: k == "VOID")
        problem = (
            F.when(~kind.startswith("ARRAY"), error("list_type")).when(wrong, error(f"{type_name(dtype)}_type"))
            .when(F.exists(value, lambda x: x.isNull()), error(name)))
        missing = "list_type"
    else:
        text = F.try_variant_get(given, "$", "string")
        value = typed(text)
        wrong = (kind != "STRING") if is_text else kind.startswith("ARRAY") | kind.startswith("OBJECT")
        problem = F.when(wrong, error(f"{type_name(dtype)}_type")).when(value.isNull(), error(name))
        missing = "enum" if options else f"{type_name(dtype)}_type"
    problem = F.when(absent, F.lit(None) if field.nullable else error(missing)).otherwise(problem).cast("string")
    return F.struct(
        F.when(~absent, value).cast(field.dataType).alias("value"), F.array_compact(F.array(problem)).alias("errors"))


def _typed_field(path: Column, field: T.StructField, given: Column) -> Column:
    """struct<value, errors> of any field of a JSON value: a leaf, an object, or a list of objects.

    Every level is bound once, so the expression grows with the schema and not with its depth's power.
    """
    if isinstance(field.dataType, T.StructType):
        sign, wrong = "OBJECT", "model_type"
    elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
        sign, wrong = "ARRAY", "list_type"
    else:
        return bound(given, lambda leaf: _typed_leaf(path, field, leaf))
    none = F.array().cast("array<string>")
    alone = F.array(F.concat(path, F.lit(f": {wrong}")))

    def inner(value: Column) -> Column:
        if sign == "OBJECT":
            return _typed_record(path, field.dataType, value)
        element = T.StructField("element", field.dataType.elementType, False)
        items = F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda item, i: _typed_field(F.concat(path, F.lit(SEP), i.cast("string")), element, item))
        return bound(items, lambda x: F.struct(
            F.transform(x, lambda e: e["value"]).alias("value"), F.flatten(F.transform(x, lambda e: e["errors"])).alias("errors")))

    def judged(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        absent = value.isNull() | (kind == "VOID")
        return bound(F.when(kind.startswith(sign), inner(value)), lambda x: F.struct(
            x["value"].alias("value"),
            F.coalesce(x["errors"], F.when(absent, none if field.nullable else alone).otherwise(alone)).alias("errors")))

    return bound(given, judged)


def _typed_record(path: Column, schema: T.StructType, given: Column) -> Column:
    """struct<value, errors> of a JSON object as a record of the schema."""
    def member(f: T.StructField) -> Column:
        name = f.name.replace("\\", "\\\\").replace("'", "\\'")
        return F.try_variant_get(given, f"$['{name}']", "variant")

    found = F.struct(*[
        _typed_field(F.concat(path, F.lit(f"{SEP}{f.name}")), f, member(f)).alias(f"f{i}") for i, f in enumerate(schema.fields)])
    return bound(found, lambda x: F.struct(
        F.struct(*[x[f"f{i}"]["value"].alias(f.name) for i, f in enumerate(schema.fields)]).alias("value"),
        F.concat(*[x[f"f{i}"]["errors"] for i in range(len(schema.fields))]).alias("errors")))


def parse_generation(results: DataFrame, schema: T.StructType, keep: list[str], raw: str = "raw_response") -> DataFrame:
    """Parse and validate answers: parsing_success, parsed_response (JSON, nulls pruned) and error.

    The whole text or its outermost object is parsed. Text takes JSON strings only, also in lists; a
    scalar is no list, a null no item, and an empty list is a valid list. Lists of nested records may stand at
    any depth; their errors carry the index, as in ``items::2::name``. A failed generation keeps its own error.
    """
    text = F.col(raw)
    doc = F.coalesce(strict_json(text), strict_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    records = {p: f for p, f in leaf_map(schema).items() if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    leaf_fields = {p: f for p, f in leaf_map(schema).items() if p not in records}
    at = {p: "$" + "".join(f"['{s}']" for s in p.split(SEP)) for p in leaf_map(schema)}
    staged = results.select(*keep, F.col("error").alias("_error"), doc.alias("_doc")).select(
        *keep, "_error", F.col("_doc").isNotNull().alias("_parsed"),
        *[F.try_variant_get("_doc", at[p], "variant").alias(f"_leaf_{i}") for i, p in enumerate(leaf_fields)],
        *[_typed_field(F.lit(p), f, F.try_variant_get("_doc", at[p], "variant")).alias(f"_list_{i}") for i, (p, f) in enumerate(records.items())],
    )
    leaves = {p: F.col(f"_leaf_{i}") for i, p in enumerate(leaf_fields)}
    mapped = staged.select(
        *keep, "_error", "_parsed",
        F.concat(
            F.array_compact(F.array(F.lit(None).cast("string"), *[_kind_errors(p, f, leaves[p]) for p, f in leaf_fields.items()])),
            *[F.col(f"_list_{i}.errors") for i in range(len(records))]).alias("_kinds"),
        *[F.try_variant_get(leaves[p], "$", "array<string>" if isinstance(f.dataType, T.ArrayType) else "string").alias(p)
          for p, f in leaf_fields.items()],
        *[F.col(f"_list_{i}.value").alias(p) for i, p in enumerate(records)],
    )
    checked = validate_rows(mapped, schema, [*keep, "_error", "_parsed", "_kinds"], compat="json")
    ok = F.coalesce(F.col("_parsed") & F.col("valid") & (F.size("_kinds") == 0), F.lit(False))
    found = F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["kind"]))
    problems = F.array_join(F.array_distinct(F.concat("_kinds", found)), "; ")
    return checked.select(
        *keep,
        ok.alias("parsing_success"),
        F.when(ok, F.to_json("record")).alias("parsed_response"),
        F.coalesce(F.col("_error"), F.when(~F.col("_parsed"), F.lit("invalid JSON")), F.when(~ok, problems)).alias("error"),
    )
