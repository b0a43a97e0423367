"""Model responses held as text columns: parsing, normalising, accepting. All operators are narrow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.functions.text import (
    FALSE_WORDS, TRUE_WORDS, bound, json_text, last_key_wins, strict_json, tagged_json, untagged,
)
from recordflow.operators.schema import RULE_COLUMNS, normalize_enum_values

# Recommendation types and priorities.
ALLOWED_TYPES = [
    "add_field", "modify_field", "remove_field", "add_class", "modify_class", "restructure",
    "general", "good_practice",
]
PRIORITIES = ["high", "medium", "low"]

# Other names that models use for the types.
TYPE_SYNONYMS = {
    "add_validation": "modify_field",
    "add_enum": "modify_field",
    "validation": "modify_field",
    "enum": "modify_field",
    "structure": "restructure",
    "best_practice": "good_practice",
    "rename_field": "modify_field",
    "refactor": "restructure",
    "documentation": "general",
    "optimize": "general",
}

# Texts filled in or appended.
DEFAULT_FEEDBACK = (
    "The schema appears to be well-structured overall, but please review the specific recommendations for improvements."
)
DEFAULT_REASONING = "No structural optimization analysis provided."
FAILED_REASONING = "\n\nThe proposed optimized schema had validation errors and couldn't be applied."
FAILED_CHANGE = "Optimization failed due to schema validation errors."

# Member names of the answers.
_RECOMMENDATION = "struct<type:string,description:string,priority:string,reason:string,example:string>"
ANALYSIS_JSON = f"struct<recommendations:array<{_RECOMMENDATION}>,missing_information:array<string>,general_feedback:string>"
VERIFICATION_JSON = "struct<approved:boolean,reasons:array<string>,suggestions:array<string>>"
OPTIMIZATION_JSON = "struct<optimized_schema:string,changes_made:array<string>,reasoning:string,is_optimized:boolean>"


def parse_json_array(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``parsed`` (compact JSON) and ``parse_status``.

    The whole text is tried first, then the span from the first ``[`` to the last ``]``; a text
    where both fail is kept as a ``failed`` row. Numbers stay as written, NaN and Infinity are numbers, of
    a repeated key the last one counts.
    """
    text = F.col(text_col)
    span = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    # A text that cannot start a JSON value is not parsed: failures cost more than parses.
    starts = text.rlike(r'^\s*[\[{"0-9tfnNI-]')
    with last_key_wins(df.sparkSession):
        staged = df.withColumn("_whole", F.when(starts, strict_json(text, as_written=True)))
        staged = staged.withColumn("_span", F.when(F.col("_whole").isNull(), strict_json(span, as_written=True)))
        return staged.select(
            *df.columns,
            json_text(F.coalesce("_whole", "_span")).alias("parsed"),
            F.when(F.col("_whole").isNotNull(), "whole").when(F.col("_span").isNotNull(), "span").otherwise("failed").alias("parse_status"),
        )


def rules_from_responses(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Parsed responses -> rule rows with their position; a failed response gives no rows.

    Every member is text; numbers read as they were written.
    """
    element = "struct<" + ",".join(f"{c}:string" for c in RULE_COLUMNS) + ">"
    items = F.from_json(tagged_json(F.col("parsed")), f"array<{element}>")
    rows = parsed.select(*keep, F.posexplode(items).alias("rule_ord", "_rule"))
    return rows.select(*keep, F.col("rule_ord").cast("bigint").alias("rule_ord"), *[untagged(F.col(f"_rule.{c}")).alias(c) for c in RULE_COLUMNS])


def _normal_recommendation(rec: Column) -> Column:
    kind = F.lower(rec["type"])
    synonyms = F.lit(None).cast("string")
    mapped = F.coalesce(*[F.when(kind == k, F.lit(t)) for k, t in TYPE_SYNONYMS.items()], synonyms)
    fixed_type = F.when(kind.isin(*ALLOWED_TYPES), kind).otherwise(F.coalesce(mapped, F.lit("general")))
    fixed_priority = F.when(F.lower(rec["priority"]).isin(*PRIORITIES), rec["priority"]).otherwise(F.lit("medium"))
    typed = rec["type"].isNotNull()
    return rec.withField("type", F.when(typed, fixed_type)).withField(
        "priority", F.when(typed, fixed_priority).otherwise(rec["priority"])
    )


def _kind(value: Column, member: str) -> Column:
    """JSON kind of a member of a variant: VOID for null, none when absent."""
    return F.schema_of_variant(F.try_variant_get(value, f"$.{member}", "variant"))


def _is_text(value: Column, member: str) -> Column:
    return F.coalesce(_kind(value, member) == "STRING", F.lit(False))


def _may_be_text(value: Column, member: str, null: bool = True) -> Column:
    """Text or absent; null too where it is allowed."""
    return F.coalesce(_kind(value, member).isin("STRING", *(["VOID"] if null else [])), F.lit(True))


def _may_be_bool(value: Column, member: str) -> Column:
    """Absent, or something that reads as true or false."""
    shown = F.lower(F.try_variant_get(value, f"$.{member}", "string"))
    scalar = _kind(value, member).isin("BOOLEAN", "STRING", "BIGINT")
    return _kind(value, member).isNull() | F.coalesce(scalar & shown.isin(*TRUE_WORDS, *FALSE_WORDS), F.lit(False))


def _items(value: Column, member: str) -> Column:
    return F.try_variant_get(value, f"$.{member}", "array<variant>")


def _all_items(value: Column, member: str, good: Callable[[Column], Column], absent: bool = False, null: bool = False) -> Column:
    """The member is a list and all its items are good; it may be absent or null where that is allowed."""
    kind = _kind(value, member)
    listed = F.coalesce(F.forall(_items(value, member), good), F.lit(False)) & F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    return listed | (kind.isNull() & absent) | (F.coalesce(kind == "VOID", F.lit(False)) & null)


def _texts_only(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item) == "STRING", F.lit(False))


def _analysis_kinds(whole: Column) -> Column:
    """Whether the members of an analysis have the JSON kinds they must; what gets filled in may be absent."""
    return (
        _all_items(whole, "recommendations", lambda r: (
            _is_text(r, "type") & _may_be_text(r, "priority") & _is_text(r, "description") & _is_text(r, "reason")
            & _may_be_text(r, "example")))
        & _all_items(whole, "missing_information", _texts_only, absent=True)
        & _may_be_text(whole, "general_feedback")
    )


def normalize_recommendations(df: DataFrame, json_col: str, out: str = "analysis") -> DataFrame:
    """Parse advisor analyses and bring their types and priorities into the allowed sets.

    A recommendation without a type is left as it is. A priority that is allowed but for its case
    passes unchanged. Feedback is filled in when there are recommendations but no feedback. ``kinds_ok``
    in the analysis says whether texts and lists were given as such; numbers in their place read as text.
    """
    parsed = F.from_json(F.col(json_col), ANALYSIS_JSON)
    recs = F.transform(parsed["recommendations"], _normal_recommendation)
    feedback = F.when(
        parsed["recommendations"].isNotNull(), F.coalesce(parsed["general_feedback"], F.lit(DEFAULT_FEEDBACK))
    ).otherwise(parsed["general_feedback"])
    with last_key_wins(df.sparkSession):
        kinds = bound(F.try_parse_json(F.col(json_col)), _analysis_kinds)
        full = parsed.withField("recommendations", recs).withField("general_feedback", feedback)
        return df.withColumn(out, F.when(parsed.isNotNull(), full.withField("kinds_ok", F.coalesce(kinds, F.lit(False)))))


def valid_analysis(df: DataFrame, analysis: str = "analysis") -> DataFrame:
    """Add ``valid``: every recommendation complete and within the allowed sets, feedback present, all members of
    their JSON kind."""
    recs, feedback = F.col(f"{analysis}.recommendations"), F.col(f"{analysis}.general_feedback")

    def good(rec: Column) -> Column:
        return (
            F.coalesce(rec["type"].isin(*ALLOWED_TYPES), F.lit(False))
            & F.coalesce(rec["priority"].isin(*PRIORITIES), F.lit(False))
            & rec["description"].isNotNull() & rec["reason"].isNotNull()
        )

    kinds = F.coalesce(F.col(f"{analysis}.kinds_ok"), F.lit(False))
    return df.withColumn("valid", F.coalesce(F.forall(recs, good), F.lit(False)) & feedback.isNotNull() & kinds)


def recommendations_by_priority(df: DataFrame, keep: list[str], analysis: str = "analysis") -> DataFrame:
    """The recommendations of each valid analysis by priority, with group size and input order.

    An analysis that ``valid_analysis`` rejects shows none. Groups live inside their analysis row, so nothing is shuffled.
    """
    recs = F.col(f"{analysis}.recommendations")

    def having(priority: str) -> Column:
        return F.filter(recs, lambda rec: rec["priority"] == priority)

    groups = F.array(*[
        F.struct(
            F.lit(rank).cast("bigint").alias("priority_rank"), F.lit(name).alias("priority"),
            having(name).alias("items"),
        )
        for rank, name in enumerate(PRIORITIES, 1)
    ])
    shown = valid_analysis(df.select(*keep, analysis), analysis)
    grouped = shown.where("valid").select(*keep, F.inline(groups)).where(F.size("items") > 0)
    return grouped.select(
        *keep, "priority_rank", "priority", F.size("items").cast("bigint").alias("n"),
        F.posexplode("items").alias("_pos", "_rec"),
    ).select(
        *keep, "priority_rank", "priority", "n", (F.col("_pos") + 1).cast("bigint").alias("position"),
        *[F.col(f"_rec.{c}").alias(c) for c in ("type", "description", "reason", "example")],
    )


def valid_schema(whole: Column) -> Column:
    """True when a schema definition, a variant, has its required members at every level, each of its JSON kind.

    Options are bare strings or objects of texts.
    """
    def option(item: Column) -> Column:
        members = F.map_values(F.try_variant_get(item, "$", "map<string,variant>"))
        return _texts_only(item) | F.coalesce(F.forall(members, _texts_only), F.lit(False))

    return (
        _is_text(whole, "main_class")
        & _all_items(whole, "classes", lambda c: (
            _is_text(c, "name") & _is_text(c, "description") & _may_be_bool(c, "is_base_model")
            & _may_be_text(c, "parent_class") & _may_be_bool(c, "is_enum")))
        & _all_items(whole, "fields", lambda f: (
            _is_text(f, "name") & _is_text(f, "field_type") & _is_text(f, "parent_class") & _is_text(f, "description")
            & _may_be_bool(f, "is_optional") & _all_items(f, "enum_values", option, absent=True, null=True)))
        & _all_items(whole, "enums", lambda e: (
            _is_text(e, "name") & _may_be_text(e, "base_type", null=False) & _is_text(e, "description")
            & _all_items(e, "values", option)), absent=True)
    )


def accept_optimized(df: DataFrame, original_col: str, response_col: str) -> DataFrame:
    """Add is_optimized, reasoning, changes_made and final_schema (JSON).

    The proposal replaces the original only when it is flagged, present and a valid definition; an
    invalid one is noted in the reasoning and the changes.
    """
    answer = F.from_json(F.col(response_col), OPTIMIZATION_JSON)
    staged = df.withColumn("_answer", answer).withColumn("_proposal", F.col("_answer.optimized_schema"))
    staged = normalize_enum_values(staged, "_proposal", "_new")
    with last_key_wins(df.sparkSession):
        staged = staged.withColumn("_kinds", bound(F.try_parse_json("_proposal"), valid_schema))
    flagged = F.coalesce(F.col("_answer.is_optimized"), F.lit(False)) & F.coalesce(
        ~F.col("_proposal").isin("{}", "[]", ""), F.lit(False)
    )
    good = flagged & F.coalesce("_kinds", F.lit(False))
    failed = flagged & ~good
    changes = F.coalesce(F.col("_answer.changes_made"), F.array().cast("array<string>"))
    reasoning = F.coalesce(F.col("_answer.reasoning"), F.lit(DEFAULT_REASONING))
    return staged.select(
        *df.columns,
        F.when(failed, F.lit(False)).otherwise(F.coalesce(F.col("_answer.is_optimized"), F.lit(False))).alias("is_optimized"),
        F.when(failed, F.concat(reasoning, F.lit(FAILED_REASONING))).otherwise(reasoning).alias("reasoning"),
        F.when(failed, F.array_append(changes, F.lit(FAILED_CHANGE))).otherwise(changes).alias("changes_made"),
        F.when(good, F.to_json("_new")).otherwise(F.col(original_col)).alias("final_schema"),
    )


def verification_status(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """Status per verification with one row per suggestion; reasons are shown when not approved."""
    answer = F.from_json(F.col(json_col), VERIFICATION_JSON)
    status = F.when(answer["approved"], "final").when(~answer["approved"], "unverified").otherwise("failed")
    staged = df.select(*keep, status.alias("status"), answer["reasons"].alias("_reasons"), answer["suggestions"].alias("_suggestions"))
    return staged.select(
        *keep, "status",
        F.when(F.col("status") == "unverified", F.array_join("_reasons", "; ")).alias("reasons"),
        F.posexplode_outer("_suggestions").alias("_pos", "suggestion"),
    ).select(*keep, "status", "reasons", F.col("_pos").cast("bigint").alias("position"), "suggestion")


