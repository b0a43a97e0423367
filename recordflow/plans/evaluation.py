"""Queries of scoring, sampling, run logs, document text and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.operators import documents as d
from recordflow.operators import extraction as e
from recordflow.operators import runs, sampling, scoring
from recordflow.operators.schema import target
from recordflow.plans.base import VISITS_SCHEMA, long_source, table
from recordflow.runtime import scratch_path

_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _gold(spark, sf_dir):
    """Labels, unknown for some documents."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("quality")).alias("quality"), "toxic"
    )


def _pred(spark, sf_dir):
    """A rule on document length, silent below a floor."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(n < 300, F.lit(None)).when(n < 2500, 1).otherwise(0).cast("int").alias("quality"),
        F.when(n >= 400, (n % 7 == 0).cast("int")).alias("toxic"),
    )


def q_score_fields(spark, sf_dir):
    return scoring.score_fields(_gold(spark, sf_dir), _pred(spark, sf_dir), "doc_id", ["quality", "toxic"])


def q_edge_cases(spark, sf_dir):
    return scoring.edge_cases(_gold(spark, sf_dir), _pred(spark, sf_dir), "doc_id", ["quality", "toxic"], 2)


def q_valid_option_rate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return scoring.valid_option_rate(orders, {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})


def q_cluster_sample(spark, sf_dir):
    return sampling.cluster_sample(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 5)


def q_cluster_sample_kmeans(spark, sf_dir):
    found = sampling.assign_clusters(table(spark, sf_dir, "embeddings"), "embedding", 8)
    return sampling.cluster_sample(found, "vec_id", "embedding", "cluster", 3)


_CONFIGS = [
    e.PromptConfig("plain", "You extract.", "", "small", 0.0),
    e.PromptConfig("guided", "You extract with care.", "Read the text and fill the fields.", "large", 0.2),
]


def q_build_extraction_prompts(spark, sf_dir):
    return e.build_extraction_prompts(table(spark, sf_dir, "documents"), "text", ["doc_id"], _CONFIGS, [("a b", '{"n": 2}')])


def stub_factory():
    """Factory of a stand-in client that answers with the text's length and refuses short texts.

    Nested functions travel to the tasks by value, so workers need not import this module.
    """
    def make_client():
        def client(texts):
            if any(len(one) < 400 for one in texts):
                raise ValueError("text too short")
            return [f'Sure: {{"n": {len(one)}, "kind": "{"long" if len(one) > 3000 else "short"}"}}' for one in texts]
        return client
    return make_client


def _extracted(spark, sf_dir):
    return e.batch_extract(table(spark, sf_dir, "documents"), "text", ["doc_id"], stub_factory())


def q_batch_extract(spark, sf_dir):
    return _extracted(spark, sf_dir).drop("execution_time")


_ANSWER_SCHEMA = T.StructType([
    target("n", "int", required=True), target("kind", "str", required=True, options=["long"]), target("note", "str"),
])


def q_parse_generation(spark, sf_dir):
    return e.parse_generation(_extracted(spark, sf_dir), _ANSWER_SCHEMA, ["doc_id"])


def q_resume_pending(spark, sf_dir):
    results = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return runs.resume_pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), results, "doc_id", "ok")


def _results(spark, sf_dir):
    """A run per event: its type is the configuration, its value the time in seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"), (F.col("event_id") % 9 != 0).alias("success"),
        F.round(F.col("value") * 1000).cast("bigint").alias("time_ms"),
        (F.col("user_id") + 100).alias("tokens"), ((F.col("event_id") % 10) / 10).alias("cost"),
    )


def q_run_report(spark, sf_dir):
    return runs.run_report(_results(spark, sf_dir), "config")


def _sweep(spark, sf_dir):
    return long_source(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("prompt"),
        F.concat(F.lit("c"), F.col("event_id") % 6).alias("config"),
        F.col("k").cast("bigint").alias("score"),
    )


def q_best_config(spark, sf_dir):
    return runs.best_config(_sweep(spark, sf_dir), "prompt", "config", "score")


def _iterations(spark, sf_dir):
    """Mean k per event type and stretch of twenty events."""
    logged = long_source(spark, sf_dir).select(
        F.col("event_type").alias("prompt"), F.floor(F.col("event_id") / 20).cast("bigint").alias("iteration"),
        F.col("k").cast("bigint").alias("k"),
    )
    return logged.groupBy("prompt", "iteration").agg((F.sum("k") / F.count("k")).alias("score"))


def q_iteration_delta(spark, sf_dir):
    return runs.iteration_delta(_iterations(spark, sf_dir), "prompt", "iteration", "score")


def q_evidence_spans(spark, sf_dir):
    word = F.translate(F.get(F.split("text", " "), F.lit(3)), "abcdefghijklm", "ABCDEFGHIJKLM")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.lit("@absent@")).otherwise(word).alias("value")
    )
    return d.evidence_spans(docs, "text", "value").drop("text")


def q_pseudonymize(spark, sf_dir):
    masked = d.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "salt-1")
    return masked.drop("text")


def q_merge_keys(spark, sf_dir):
    """The key table over two batches of documents, the second holding texts of the first again."""
    docs = table(spark, sf_dir, "documents")
    first = d.merge_keys(None, docs.where("doc_id % 3 < 2"), "text", "salt-1", 0)
    path = scratch_path(spark, "keys")
    first.write.parquet(path)
    return d.merge_keys(spark.read.parquet(path), docs.where("doc_id % 3 > 0"), "text", "salt-1", 1)


def q_html_to_text(spark, sf_dir):
    return d.html_to_text(table(spark, sf_dir, "pages"), "html").drop("html", "url")


def q_unify_labels(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    noisy = (
        F.when(kind == 0, F.col("p_type")).when(kind == 1, F.concat(F.lit(" "), F.lower("p_type"), F.lit("!")))
        .when(kind == 2, F.concat(F.substring("p_type", 1, 1), F.substring("p_type", 3, 99)))
        .when(kind == 3, F.concat("p_type", F.lit("s"))).otherwise(F.col("p_name"))
    )
    return d.unify_labels(table(spark, sf_dir, "part").select("p_partkey", noisy.alias("raw")), "raw", _TYPES)


def q_unify_many_labels(spark, sf_dir):
    """Thousands of labels, the names of the parts, against names with a letter lost, put in, changed or all of them."""
    part = table(spark, sf_dir, "part")
    labels = part.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("label_no"))
    kind, name = F.col("p_partkey") % 5, F.col("p_name")
    noisy = (
        F.when(kind == 0, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 99)))
        .when(kind == 1, F.concat(F.lit("q"), name, F.lit("!"))).when(kind == 2, F.concat(F.substring(name, 2, 99), F.lit("zz")))
        .when(kind == 3, F.upper(name)).otherwise(F.reverse(name)))
    return d.unify_labels(part.select("p_partkey", noisy.alias("raw")), "raw", labels)


def q_extend_enum(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    registry = part.select(F.col("p_type").alias("value"))
    batch = part.select(
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("value"), "p_partkey"
    )
    return d.extend_enum(registry, batch, "value", "p_partkey")


def q_parse_nested_generation(spark, sf_dir):
    """Answers with three levels of lists: good ones, a wrong number, a missing member, no list, an unknown option."""
    key = F.col("c_custkey")
    kind = key % 6
    dose = F.when(kind == 1, F.lit('"much"')).otherwise((key % 9).cast("string"))
    second = F.when(kind == 2, F.lit("{}")).when(kind == 3, F.lit('{"code":"Z"}')).otherwise(F.lit('{"code":"O","drugs":[]}'))
    visits = F.concat(
        F.lit('[{"code":"F","drugs":[{"name":"'), F.col("c_mktsegment"), F.lit('","doses":[{"mg":'), key.cast("string"),
        F.lit('},{"mg":'), dose, F.lit("}]}]},"), second, F.lit("]"))
    answer = F.concat(F.lit('So: {"order_id":'), key.cast("string"), F.lit(',"visits":'), F.when(kind == 4, F.lit('"none"')).otherwise(visits), F.lit("}"))
    answers = table(spark, sf_dir, "customer").select("c_custkey", answer.alias("raw_response"), F.lit(None).cast("string").alias("error"))
    return e.parse_generation(answers, VISITS_SCHEMA, ["c_custkey"])


QUERIES = {
    "parse_nested_generation": q_parse_nested_generation,
    "score_fields": q_score_fields,
    "valid_option_rate": q_valid_option_rate,
    "edge_cases": q_edge_cases,
    "cluster_sample": q_cluster_sample,
    "cluster_sample_kmeans": q_cluster_sample_kmeans,
    "build_extraction_prompts": q_build_extraction_prompts,
    "batch_extract": q_batch_extract,
    "parse_generation": q_parse_generation,
    "resume_pending": q_resume_pending,
    "run_report": q_run_report,
    "best_config": q_best_config,
    "iteration_delta": q_iteration_delta,
    "evidence_spans": q_evidence_spans,
    "pseudonymize": q_pseudonymize,
    "merge_keys": q_merge_keys,
    "html_to_text": q_html_to_text,
    "unify_labels": q_unify_labels,
    "unify_many_labels": q_unify_many_labels,
    "extend_enum": q_extend_enum,
}

_PAIRS = """
  gold AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN quality END AS quality, toxic FROM labels),
  pred AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN NULL WHEN n_chars < 2500 THEN 1 ELSE 0 END AS quality,
                  CASE WHEN n_chars >= 400 THEN CAST(n_chars % 7 = 0 AS INT) END AS toxic FROM documents),
  pairs AS (
    SELECT 'quality' AS field, g.quality AS gold, p.quality AS pred FROM gold g FULL JOIN pred p USING (doc_id)
    UNION ALL SELECT 'toxic', g.toxic, p.toxic FROM gold g FULL JOIN pred p USING (doc_id)
  )"""

_KIND = f"""CASE WHEN contains(h, '@') THEN 'EMAIL' WHEN regexp_full_match(h, '{d.PII_PATTERNS["IP"]}') THEN 'IP'
          WHEN regexp_full_match(h, '{d.PII_PATTERNS["ID"]}') THEN 'ID' ELSE 'PHONE' END"""

_EXTRACTED = """
  extracted AS (
    SELECT doc_id, length(text) >= 400 AS generation_success,
      CASE WHEN length(text) >= 400 THEN 'Sure: {"n": ' || length(text) || ', "kind": "' || CASE WHEN length(text) > 3000 THEN 'long' ELSE 'short' END || '"}' END AS raw_response,
      CASE WHEN length(text) < 400 THEN 'text too short' END AS error, length(text) AS n
    FROM documents
  )"""

_ITERATIONS = """
  iterations AS (
    SELECT event_type AS prompt, event_id // 20 AS iteration,
           sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / count(*) AS score
    FROM events GROUP BY 1, 2
  )"""

_UNIFY = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_TYPES))
_VISIBLE = "html"
for _part in ("script", "style", "head", "noscript", "template"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_part}(?:\\s[^>]*)?>.*?</{_part}\\s*>', ' ', 'g')"
_VISIBLE = f"regexp_replace({_VISIBLE}, '(?s)<!--.*?-->', '', 'g')"
_VISIBLE = f"regexp_replace({_VISIBLE}, '[\\r\\n]', ' ', 'g')"
_VISIBLE = (
    f"regexp_replace({_VISIBLE}, '(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|main|blockquote|pre)"
    "(?:\\s[^>]*)?/?>', chr(10), 'g')"
)
_VISIBLE = f"regexp_replace({_VISIBLE}, '<[^>]*>', '', 'g')"


def _clean(text: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)"
_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

ORACLE = {
    "score_fields": f"""WITH {_PAIRS},
      c AS (SELECT field, count(*) FILTER (gold = pred) AS tp,
        count(*) FILTER ((gold IS NULL AND pred IS NOT NULL) OR gold <> pred) AS fp,
        count(*) FILTER ((gold IS NOT NULL AND pred IS NULL) OR gold <> pred) AS fn,
        count(*) FILTER (gold IS NULL AND pred IS NULL) AS tn, count(*) AS n FROM pairs GROUP BY field)
      SELECT field, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
             round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / n, 6) AS accuracy FROM c""",
    "valid_option_rate": """
      SELECT 'o_orderstatus' AS field, count(*) AS n, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS valid_rate
      FROM orders WHERE o_orderstatus <> 'P'
      UNION ALL SELECT 'o_orderpriority', count(*), round(count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) / count(*), 6) FROM orders""",
    "edge_cases": f"""WITH {_PAIRS},
      n AS (SELECT field, CAST(gold AS VARCHAR) AS gold, CAST(pred AS VARCHAR) AS pred, count(*) AS n FROM pairs
            WHERE gold IS DISTINCT FROM pred GROUP BY ALL)
      SELECT field, rank, gold, pred, n FROM (
        SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, gold NULLS FIRST, pred NULLS FIRST) AS rank FROM n) WHERE rank <= 2""",
    "cluster_sample": """
      WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      centers AS (SELECT label, i, avg(x) AS c FROM cells GROUP BY label, i),
      near AS (SELECT vec_id, label, sum((x - c) * (x - c)) AS dist FROM cells JOIN centers USING (label, i) GROUP BY vec_id, label),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM near)
      SELECT vec_id, label, rank, round(dist, 5) AS distance FROM ranked WHERE rank <= 5""",
    "build_extraction_prompts": """
      SELECT doc_id, c.config, c.system_message, c.model_name, CAST(c.temperature AS DOUBLE) AS temperature,
             c.lead || 'Text: a b' || chr(10) || 'Answer: {"n": 2}' || chr(10) || chr(10) || text AS prompt
      FROM documents, (VALUES ('plain', 'You extract.', 'small', 0.0, ''),
        ('guided', 'You extract with care.', 'large', 0.2, 'Read the text and fill the fields.' || chr(10) || chr(10))) AS c(config, system_message, model_name, temperature, lead)""",
    "batch_extract": f"WITH {_EXTRACTED} SELECT doc_id, generation_success, raw_response, error FROM extracted",
    "parse_generation": f"""WITH {_EXTRACTED}
      SELECT doc_id, n > 3000 AS parsing_success, CASE WHEN n > 3000 THEN '{{"n":' || n || ',"kind":"long"}}' END AS parsed_response,
             CASE WHEN n < 400 THEN error WHEN n <= 3000 THEN 'kind: enum' END AS error FROM extracted""",
    "resume_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "run_report": """
      WITH r AS (SELECT event_type AS config, event_id % 9 <> 0 AS success, CAST(round(value * 1000) AS BIGINT) AS time_ms,
                        user_id + 100 AS tokens, (event_id % 10) / 10 AS cost FROM events)
      SELECT config, count(*) AS runs, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
             round(CAST(sum(time_ms) AS BIGINT) / count(*) / 1000, 6) AS mean_time, round(quantile_disc(time_ms, 0.95) / 1000, 6) AS p95_time,
             CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost
      FROM r GROUP BY config""",
    "best_config": """
      WITH m AS (SELECT 'u' || (user_id % 20) AS prompt, 'c' || (event_id % 6) AS config,
                        CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) / count(*) AS best_score, count(*) AS runs
                 FROM events GROUP BY 1, 2)
      SELECT prompt, config, best_score, runs FROM (
        SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY best_score DESC, config) AS n FROM m) WHERE n = 1""",
    "iteration_delta": f"""WITH {_ITERATIONS},
      l AS (SELECT *, lag(score) OVER (PARTITION BY prompt ORDER BY iteration) AS previous_score FROM iterations)
      SELECT prompt, iteration, score, previous_score, round(score - previous_score, 6) AS delta,
             CASE WHEN score > previous_score THEN 'gain' WHEN score < previous_score THEN 'regression' WHEN score = previous_score THEN 'same' END AS verdict
      FROM l""",
    "evidence_spans": """
      WITH v AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN '@absent@' ELSE translate(string_split(text, ' ')[4], 'abcdefghijklm', 'ABCDEFGHIJKLM') END AS value FROM documents),
      f AS (SELECT *, CASE WHEN length(value) > 0 THEN nullif(strpos(lower(text), lower(value)), 0) END AS found FROM v)
      SELECT doc_id, value, found - 1 AS span_start, found - 1 + length(value) AS span_end FROM f""",
    "pseudonymize": f"""
      WITH m AS (SELECT doc_id, regexp_split_to_array(text, '{d.PII_PATTERN}') AS pieces, regexp_extract_all(text, '{d.PII_PATTERN}') AS hits FROM documents)
      SELECT doc_id, len(hits) AS n_masked,
        array_to_string(list_transform(list_zip(pieces, list_transform(hits, lambda h:
          '[' || {_KIND} || '_' || sha256('salt-1' || h)[1:12] || ']')),
          lambda z: z[1] || coalesce(z[2], '')), '') AS masked
      FROM m""",
    "merge_keys": f"""
      WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{d.PII_PATTERN}')) AS h FROM documents)
      SELECT h AS original, '[' || {_KIND} || '_' || sha256('salt-1' || h)[1:12] || ']' AS token, false AS is_long,
        min((doc_id % 3 = 2)::BIGINT) AS batch FROM m GROUP BY h""",
    "html_to_text": f"SELECT page_id, {_clean(_TITLE)} AS title, {_clean(_VISIBLE)} AS visible_text FROM pages",
    "unify_labels": f"""
      WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN ' ' || lower(p_type) || '!' WHEN 2 THEN p_type[1] || p_type[3:]
                   WHEN 3 THEN p_type || 's' ELSE p_name END AS raw FROM part),
      c AS (SELECT p_partkey, raw, l.label, l.ord, levenshtein({_NORM.format("raw")}, lower(l.label)) AS dist
            FROM n, (VALUES {_UNIFY}) AS l(ord, label)),
      b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY dist, ord) AS n FROM c)
      SELECT p_partkey, raw, CASE WHEN dist <= 2 THEN label END AS label,
             CASE WHEN dist = 0 THEN 'exact' WHEN dist <= 2 THEN 'near' ELSE 'none' END AS match, CASE WHEN dist <= 2 THEN dist END AS distance
      FROM b WHERE n = 1""",
    "parse_nested_generation": """
      SELECT c_custkey, c_custkey % 6 IN (0, 5) AS parsing_success,
        CASE WHEN c_custkey % 6 IN (0, 5) THEN '{"order_id":' || c_custkey || ',"visits":[{"code":"F","drugs":[{"name":"' || c_mktsegment
          || '","doses":[{"mg":' || c_custkey || '},{"mg":' || c_custkey % 9 || '}]}]},{"code":"O","drugs":[]}]}' END AS parsed_response,
        CASE c_custkey % 6 WHEN 1 THEN 'visits::0::drugs::0::doses::1::mg: int_parsing' WHEN 2 THEN 'visits::1::code: enum'
          WHEN 3 THEN 'visits::1::code: enum' WHEN 4 THEN 'visits: list_type' END AS error
      FROM customer""",
    "unify_many_labels": f"""
      WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name[1:2] || p_name[4:] WHEN 1 THEN 'q' || p_name || '!' WHEN 2 THEN p_name[2:] || 'zz'
                   WHEN 3 THEN upper(p_name) ELSE reverse(p_name) END AS raw FROM part),
      l AS (SELECT p_name AS label, min(p_partkey) AS ord FROM part GROUP BY p_name),
      c AS (SELECT p_partkey, raw, l.label, l.ord, levenshtein({_NORM.format("raw")}, {_NORM.format("l.label")}) AS dist FROM n, l),
      b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY dist, ord) AS n FROM c)
      SELECT p_partkey, raw, CASE WHEN dist <= 2 THEN label END AS label,
             CASE WHEN dist = 0 THEN 'exact' WHEN dist <= 2 THEN 'near' ELSE 'none' END AS match, CASE WHEN dist <= 2 THEN dist END AS distance
      FROM b WHERE n = 1""",
    "extend_enum": """
      SELECT value, count(*) AS n, min(p_partkey) AS first_seen
      FROM (SELECT CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_type || ' ' || p_brand END AS value, p_partkey FROM part)
      WHERE value NOT IN (SELECT p_type FROM part) GROUP BY value""",
}
