"""Queries of model responses, conversations and call costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators import chat, cost
from recordflow.operators import responses as r
from recordflow.plans.base import table

_TYPES = [
    "add_validation", "add_enum", "validation", "enum", "structure", "best_practice", "rename_field",
    "refactor", "documentation", "optimize", "ADD_FIELD", "unknown_kind", None, "general",
]
_PRIORITIES = ["high", "High", "urgent", "low", None]
_AGENTS = ["conversation", "schema_generation", "advisor", "verification", "structure_optimization"]
_MODELS = ["gpt-4o", "gpt-4.1", "gpt-4.1-mini", "GPT-4.1-Mini@east", "o3-mini", "o3", "hermes3:8b"]
_SYSTEM = "You help to design a schema."


def _pick(values, index):
    """The value at a 0-based index expression."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def raw_responses(spark, sf_dir):
    """Five shapes of answer around the props of each event."""
    props = F.col("props")
    shape = F.col("event_id") % 5
    text = (
        F.when(shape == 0, F.concat(F.lit("["), props, F.lit("]")))
        .when(shape == 1, F.concat(F.lit("Here it is: ["), props, F.lit(", "), props, F.lit("] - done")))
        .when(shape == 2, F.concat(F.lit("```json\n["), props, F.lit("]\n```")))
        .when(shape == 3, F.concat(F.lit("broken ["), props))
        .otherwise(F.concat(F.lit("[1] and ["), props, F.lit("]")))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("response"))


def q_parse_json_array(spark, sf_dir):
    return r.parse_json_array(raw_responses(spark, sf_dir), "response").drop("response")


def rule_responses(spark, sf_dir):
    rule = F.concat(
        F.lit('{"pydantic_field":"f'), F.col("p_size").cast("string"), F.lit('","pydantic_type":"str","Observation_ColName":"'),
        F.col("p_brand"), F.lit('","Observation_Value":'), F.col("p_size").cast("string"), F.lit("}"),
    )
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Rules:\n["), rule, F.lit(","), rule, F.lit("]\nDone."))).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("["), rule, F.lit("]"))
    ).otherwise(F.lit("none"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("response"))


def q_rules_from_responses(spark, sf_dir):
    parsed = r.parse_json_array(rule_responses(spark, sf_dir), "response")
    return r.rules_from_responses(parsed, ["p_partkey"])


def analyses(spark, sf_dir):
    """An advisor analysis of two recommendations per conversation turn."""
    base = F.col("conv_id") * 7 + F.col("turn")
    turn = F.col("turn").cast("string")

    def member(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":"'), value, F.lit('",'))).otherwise(F.lit(""))

    def rec(step):
        return F.concat(
            F.lit("{"), member("type", _pick(_TYPES, (base + 5 * step) % 14)),
            member("priority", _pick(_PRIORITIES, (base + step) % 5)),
            F.lit('"reason":"because","description":"d'), turn, F.lit(f'_{step}"}}'),
        )

    text = F.concat(
        F.lit('{"recommendations":['), rec(0), F.lit(","), rec(1), F.lit("]"),
        F.when(F.col("turn") % 2 == 0, F.lit(',"general_feedback":"fine"')).otherwise(F.lit("")), F.lit("}"),
    )
    return _turns(spark, sf_dir).select("conv_id", "turn", text.alias("advice"))


def _analysis(spark, sf_dir):
    return r.normalize_recommendations(analyses(spark, sf_dir), "advice").drop("advice")


def q_normalize_recommendations(spark, sf_dir):
    recs = F.col("analysis.recommendations")
    return _analysis(spark, sf_dir).select(
        "conv_id", "turn",
        F.array_join(recs["type"], "|", "-").alias("types"),
        F.array_join(recs["priority"], "|", "-").alias("priorities"),
        F.col("analysis.general_feedback").alias("general_feedback"),
    )


def q_valid_analysis(spark, sf_dir):
    """Some reasons are numbers and some missing information is no list, which is not valid."""
    given = analyses(spark, sf_dir)
    advice = F.when(F.col("conv_id") % 7 == 0, F.replace("advice", F.lit('"because"'), F.lit("5"))).otherwise(F.col("advice"))
    listed = F.when(F.col("conv_id") % 5 == 0, F.lit('"x"')).otherwise(F.lit('["x"]'))
    given = given.withColumn("advice", F.concat(F.lit('{"missing_information":'), listed, F.lit(","), F.substring(advice, 2, 2**31 - 1)))
    return r.valid_analysis(r.normalize_recommendations(given, "advice")).select("conv_id", "turn", "valid")


def q_recommendations_by_priority(spark, sf_dir):
    return r.recommendations_by_priority(_analysis(spark, sf_dir), ["conv_id", "turn"])


def optimizations(spark, sf_dir):
    """Four kinds of optimizer answer: valid, invalid, not flagged, empty."""
    kind = F.col("p_partkey") % 4
    good = F.concat(
        F.lit('{"main_class":"M","classes":[{"name":"M","description":"m"}],"fields":[{"name":"'), F.lower("p_brand"),
        F.lit('","field_type":"str","parent_class":"M","description":"x","enum_values":["'), F.lower("p_type"), F.lit('"]}]}'),
    )
    text = (
        F.when(kind == 0, F.concat(F.lit('{"is_optimized":true,"reasoning":"flatter","changes_made":["c1"],"optimized_schema":'), good, F.lit("}")))
        .when(kind == 1, F.lit('{"is_optimized":true,"reasoning":"flatter","changes_made":["c1"],"optimized_schema":{"main_class":"M"}}'))
        .when(kind == 2, F.concat(F.lit('{"is_optimized":false,"changes_made":[],"optimized_schema":'), good, F.lit("}")))
        .otherwise(F.lit("{}"))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit('{"main_class":"'), F.col("p_name"), F.lit('"}')).alias("original"), text.alias("answer")
    )


def q_accept_optimized(spark, sf_dir):
    done = r.accept_optimized(optimizations(spark, sf_dir), "original", "answer")
    return done.select(
        "p_partkey", "is_optimized", "reasoning", F.array_join("changes_made", "|").alias("changes_made"), "final_schema"
    )


def q_verification_status(spark, sf_dir):
    kind = F.col("conv_id") % 3
    text = (
        F.when(kind == 0, F.lit('{"approved":true,"reasons":["clear"],"suggestions":["s1"]}'))
        .when(kind == 1, F.concat(F.lit('{"approved":false,"reasons":["r'), F.col("turn").cast("string"),
                                  F.lit('","r2"],"suggestions":["s1","s2"]}')))
        .otherwise(F.lit('{"reasons":["no verdict"]}'))
    )
    source = _turns(spark, sf_dir).select("conv_id", "turn", text.alias("verdict"))
    return r.verification_status(source, "verdict", ["conv_id", "turn"])


def q_transcript(spark, sf_dir):
    return chat.transcript(_turns(spark, sf_dir))


def q_eligible_conversations(spark, sf_dir):
    return chat.eligible_conversations(_turns(spark, sf_dir))


def q_build_messages(spark, sf_dir):
    return chat.build_messages(_turns(spark, sf_dir), _SYSTEM, dedupe=False)


def calls(spark, sf_dir):
    """A model call per turn."""
    return _turns(spark, sf_dir).select(
        "conv_id", "turn",
        _pick(_AGENTS, F.col("turn") % 5).alias("agent"),
        _pick(_MODELS, F.col("conv_id") % 7).alias("model"),
        F.length("text").cast("bigint").alias("prompt_tokens"),
        F.floor(F.length("text") / 4).cast("bigint").alias("completion_tokens"),
    )


def q_base_model(spark, sf_dir):
    return calls(spark, sf_dir).select("conv_id", "turn", "model", cost.base_model(F.col("model")).alias("base_model"))


def q_price_lookup(spark, sf_dir):
    return cost.price_lookup(calls(spark, sf_dir)).select("conv_id", "turn", "price_key", "prompt_price", "completion_price")


def q_call_cost(spark, sf_dir):
    return cost.call_cost(calls(spark, sf_dir)).select(
        "conv_id", "turn", *[F.round(c, 9).alias(c) for c in ("prompt_cost", "completion_cost", "total_cost")]
    )


def q_cost_breakdown(spark, sf_dir):
    return cost.cost_breakdown(cost.call_cost(calls(spark, sf_dir))).select("agent", F.round("cost", 8).alias("cost"), "calls")


def q_cost_report(spark, sf_dir):
    return cost.cost_report(cost.call_cost(calls(spark, sf_dir)))


QUERIES = {
    "parse_json_array": q_parse_json_array,
    "rules_from_responses": q_rules_from_responses,
    "normalize_recommendations": q_normalize_recommendations,
    "valid_analysis": q_valid_analysis,
    "recommendations_by_priority": q_recommendations_by_priority,
    "accept_optimized": q_accept_optimized,
    "verification_status": q_verification_status,
    "transcript": q_transcript,
    "eligible_conversations": q_eligible_conversations,
    "build_messages": q_build_messages,
    "base_model": q_base_model,
    "price_lookup": q_price_lookup,
    "call_cost": q_call_cost,
    "cost_breakdown": q_cost_breakdown,
    "cost_report": q_cost_report,
}


def _list(values):
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in values) + "]"


_RECS = f"""
  raw AS (
    SELECT conv_id, turn, s.step, ({_list(_TYPES)})[(conv_id * 7 + turn + 5 * s.step) % 14 + 1] AS type,
           ({_list(_PRIORITIES)})[(conv_id * 7 + turn + s.step) % 5 + 1] AS priority, 'd' || turn || '_' || s.step AS description
    FROM conversations, (VALUES (0), (1)) AS s(step)
  ),
  recs AS (
    SELECT conv_id, turn, step, description,
      CASE WHEN type IS NULL THEN NULL
           WHEN lower(type) IN ('add_field','modify_field','remove_field','add_class','modify_class','restructure','general','good_practice') THEN lower(type)
           WHEN type IN ('add_validation','add_enum','validation','enum','rename_field') THEN 'modify_field'
           WHEN type IN ('structure','refactor') THEN 'restructure'
           WHEN type = 'best_practice' THEN 'good_practice' ELSE 'general' END AS type,
      CASE WHEN type IS NULL THEN priority WHEN lower(priority) IN ('high','medium','low') THEN priority ELSE 'medium' END AS priority
    FROM raw
  )"""

_CALLS = f"""
  calls AS (
    SELECT conv_id, turn, ({_list(_AGENTS)})[turn % 5 + 1] AS agent, ({_list(_MODELS)})[conv_id % 7 + 1] AS model,
           length(text) AS prompt_tokens, length(text) // 4 AS completion_tokens
    FROM conversations
  ),
  priced AS (
    SELECT c.*, p.* FROM calls c JOIN (VALUES ('gpt-4o', 'gpt-4o', 2.5::DOUBLE, 10.0::DOUBLE), ('gpt-4.1', 'gpt-4.1', 2.0, 8.0),
      ('gpt-4.1-mini', 'gpt-4.1', 2.0, 8.0), ('GPT-4.1-Mini@east', 'gpt-4.1', 2.0, 8.0), ('o3-mini', 'o3-mini', 1.1, 4.4),
      ('o3', 'o3', 10.0, 40.0), ('hermes3:8b', 'default', 1000.0, 2000.0)) AS p(full_name, price_key, prompt_price, completion_price)
      ON c.model = p.full_name
  ),
  costed AS (
    SELECT *, prompt_tokens / 1e6 * prompt_price AS prompt_cost, completion_tokens / 1e6 * completion_price AS completion_cost,
           prompt_tokens / 1e6 * prompt_price + completion_tokens / 1e6 * completion_price AS total_cost
    FROM priced
  )"""

ORACLE = {
    "parse_json_array": """
      SELECT event_id,
        CASE event_id % 5 WHEN 0 THEN '[' || replace(props, ' ', '') || ']'
          WHEN 1 THEN '[' || replace(props, ' ', '') || ',' || replace(props, ' ', '') || ']'
          WHEN 2 THEN '[' || replace(props, ' ', '') || ']' END AS parsed,
        CASE event_id % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'span' WHEN 2 THEN 'span' ELSE 'failed' END AS parse_status
      FROM events""",
    "rules_from_responses": """
      SELECT p_partkey, CAST(i.n AS BIGINT) AS rule_ord, 'f' || p_size AS pydantic_field, 'str' AS pydantic_type,
        CAST(NULL AS VARCHAR) AS evaluation_method, CAST(NULL AS VARCHAR) AS "multiValue_handling_method",
        CAST(NULL AS VARCHAR) AS pydantic_value, p_brand AS "Observation_ColName", CAST(p_size AS VARCHAR) AS "Observation_Value",
        CAST(NULL AS VARCHAR) AS "Observation_Value2", CAST(NULL AS VARCHAR) AS "Observation_Value3", CAST(NULL AS VARCHAR) AS "Observation_Value4"
      FROM part, (VALUES (0), (1)) AS i(n) WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND i.n = 0)""",
    "normalize_recommendations": f"""
      WITH {_RECS}
      SELECT conv_id, turn, string_agg(coalesce(type, '-'), '|' ORDER BY step) AS types,
             string_agg(coalesce(priority, '-'), '|' ORDER BY step) AS priorities,
             CASE WHEN turn % 2 = 0 THEN 'fine' ELSE '{r.DEFAULT_FEEDBACK}' END AS general_feedback
      FROM recs GROUP BY conv_id, turn""",
    "valid_analysis": f"""
      WITH {_RECS}
      SELECT conv_id, turn, bool_and(type IS NOT NULL AND coalesce(priority IN ('high', 'medium', 'low'), false))
             AND conv_id % 7 <> 0 AND conv_id % 5 <> 0 AS valid
      FROM recs GROUP BY conv_id, turn""",
    "recommendations_by_priority": f"""
      WITH {_RECS}
      SELECT conv_id, turn, CAST(CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS priority_rank, priority,
             count(*) OVER (PARTITION BY conv_id, turn, priority) AS n,
             row_number() OVER (PARTITION BY conv_id, turn, priority ORDER BY step) AS position, type, description,
             'because' AS reason, CAST(NULL AS VARCHAR) AS example
      FROM (SELECT *, bool_and(type IS NOT NULL AND coalesce(priority IN ('high', 'medium', 'low'), false)) OVER (PARTITION BY conv_id, turn) AS valid FROM recs)
      WHERE valid""",
    "accept_optimized": f"""
      SELECT p_partkey, p_partkey % 4 = 0 AS is_optimized,
        CASE p_partkey % 4 WHEN 0 THEN 'flatter' WHEN 1 THEN 'flatter' || chr(10) || chr(10) || 'The proposed optimized schema had validation errors and couldn''t be applied.'
          ELSE '{r.DEFAULT_REASONING}' END AS reasoning,
        CASE p_partkey % 4 WHEN 0 THEN 'c1' WHEN 1 THEN 'c1|{r.FAILED_CHANGE}' ELSE '' END AS changes_made,
        CASE WHEN p_partkey % 4 = 0 THEN
          '{{"main_class":"M","classes":[{{"name":"M","description":"m"}}],"fields":[{{"name":"' || lower(p_brand)
          || '","field_type":"str","parent_class":"M","description":"x","enum_values":[{{"name":"' || p_type
          || '","description":"' || upper(p_type[1]) || lower(p_type[2:]) || '"}}]}}]}}'
        ELSE '{{"main_class":"' || p_name || '"}}' END AS final_schema
      FROM part""",
    "verification_status": """
      SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'unverified' ELSE 'failed' END AS status,
             CASE WHEN conv_id % 3 = 1 THEN 'r' || turn || '; r2' END AS reasons,
             CASE WHEN conv_id % 3 < 2 THEN CAST(s.n AS BIGINT) END AS position,
             CASE WHEN conv_id % 3 < 2 THEN 's' || (s.n + 1) END AS suggestion
      FROM conversations, (VALUES (0), (1)) AS s(n) WHERE s.n = 0 OR conv_id % 3 = 1""",
    "transcript": """
      SELECT conv_id, CAST(turn // 1000 AS BIGINT) AS part,
             string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript
      FROM conversations GROUP BY conv_id, turn // 1000""",
    "eligible_conversations": """
      SELECT * FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4)""",
    "build_messages": f"""
      SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS position, 'system' AS role, '{_SYSTEM}' AS content FROM conversations
      UNION ALL SELECT conv_id, turn + 1, role, text FROM conversations
      UNION ALL
      SELECT conv_id, max(turn) + 2, 'user', max_by(text, turn) FILTER (role = 'user') FROM conversations GROUP BY conv_id
      HAVING count(*) FILTER (role = 'user') > 0""",
    "base_model": f"WITH {_CALLS} SELECT conv_id, turn, model, lower(split_part(split_part(model, ':', 1), '@', 1)) AS base_model FROM calls",
    "price_lookup": f"WITH {_CALLS} SELECT conv_id, turn, price_key, prompt_price, completion_price FROM priced",
    "call_cost": f"""WITH {_CALLS} SELECT conv_id, turn, round(prompt_cost, 9) AS prompt_cost,
      round(completion_cost, 9) AS completion_cost, round(total_cost, 9) AS total_cost FROM costed""",
    "cost_breakdown": f"""WITH {_CALLS}
      SELECT CASE WHEN grouping(agent) = 1 THEN 'Total' ELSE agent END AS agent, round(sum(total_cost), 8) AS cost, count(*) AS calls
      FROM costed GROUP BY ROLLUP (agent)""",
    "cost_report": f"""WITH {_CALLS},
      agents AS (SELECT agent, sum(total_cost) AS cost, count(*) AS calls, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM costed GROUP BY agent)
      SELECT '{{"total_cost":' || round(sum(cost), 8) || ',"breakdown":{{' || string_agg('"' || agent || '":' || round(cost, 8), ',' ORDER BY agent)
        || '}},"api_calls":{{' || string_agg('"' || agent || '":' || calls, ',' ORDER BY agent)
        || '}},"models_used":{{' || string_agg('"' || agent || '":"' || models || '"', ',' ORDER BY agent) || '}}}}' AS report
      FROM agents""",
}
