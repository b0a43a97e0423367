"""The named queries of this folder and, where SQL can state them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordflow.llm import (
    alignment, bpe_chunks, conversation_trie, exact_dedup, line_dedup, mixing, pii, quality, simhash, token_counts, topk, toxicity, url_filter)
from recordflow.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe_chunks.tokenizer_spec(public_tokenizers.path("word_bpe_49k.json"))
    return bpe_chunks.encode_decode(table(spark, sf_dir, "documents"), spec)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_matches(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    spec = bpe_chunks.tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json"))
    return alignment.alignment(table(spark, sf_dir, "documents"), spec, model)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe_chunks.tokenizer_spec(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), spec)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe_chunks": op2_bpe_chunks,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_va_file": op10_va_file,
    "op11_alignment": op11_alignment,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_counts": op13_token_counts,
}

ORACLE = {
    "op1_url_filter": r"""
        WITH RECURSIVE rules(verdict, rule, h, p) AS (
            VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                   ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
        tags AS (
            SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag
            FROM pages WHERE contains(url, '://')),
        targets AS (
            SELECT url AS base, trim(replace(CASE
                WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
                THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1)
                WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
                THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1) END, '&amp;', '&')) AS href
            FROM tags),
        edges AS (
            SELECT regexp_extract(base, '^[^#]*') AS a, regexp_extract(CASE
                WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
                WHEN starts_with(href, '//') THEN regexp_extract(base, '^[^/?#]*:') || href
                WHEN starts_with(href, '/') THEN regexp_extract(base, '^[^/?#]*://[^/?#]*') || href
                WHEN starts_with(href, '?') THEN regexp_extract(base, '^[^?#]*') || href
                ELSE regexp_extract(regexp_extract(base, '^[^?#]*'), '^.*/') || href END, '^[^#]*') AS b
            FROM targets WHERE length(href) > 0),
        both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
        reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
        split AS (
            SELECT u AS url, regexp_extract(u, '://([^/?#]*)', 1) AS host0,
                   regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT url AS u FROM pages UNION SELECT b FROM edges) WHERE u IS NOT NULL),
        judged AS (
            SELECT s.url, lower(host0) AS host, s.path, r.rule, r.verdict
            FROM split s LEFT JOIN rules r
              ON (lower(host0) = r.h OR ends_with(lower(host0), '.' || r.h)) AND starts_with(s.path, r.p)
            QUALIFY row_number() OVER (PARTITION BY s.url ORDER BY length(r.rule) DESC NULLS LAST) = 1),
        classes AS (
            SELECT r.a, min(least(r.a, r.b)) AS alias_class, bool_or(j.verdict = 'block') AS blocks, bool_or(j.verdict = 'allow') AS allows
            FROM reach r JOIN judged j ON regexp_extract(j.url, '^[^#]*') = r.b GROUP BY r.a)
        SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule,
               coalesce(j.verdict, CASE WHEN coalesce(c.blocks, false) AND NOT coalesce(c.allows, false) THEN 'block' ELSE 'allow' END) AS verdict,
               c.alias_class
        FROM pages p LEFT JOIN judged j ON j.url = p.url LEFT JOIN classes c ON c.a = regexp_extract(p.url, '^[^#]*')
    """,
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op10_va_file": """
        WITH sound AS (
            SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.r, q.vec_id AS query_id, b.vec_id, b.r AS other,
                   list_sum([z[1] * z[2] for z in list_zip(q.v, b.v)])::BIGINT AS score
            FROM sound q JOIN sound b ON q.r <> b.r AND len(q.v) = len(b.v) WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) <= 5
    """,
    "op12_conversation_trie": """
        WITH own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
            FROM conversations WHERE conv_id IS NOT NULL),
        plan AS (
            SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
                list_concat([4294967295::UBIGINT], [ascii(c)::UBIGINT for c in string_split(conv_id::VARCHAR, '')]),
                lambda x, y: list_reduce(list_concat([xor(x, y)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                    lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384::UBIGINT) ELSE p >> 1 END)),
                4294967295::UBIGINT)::BIGINT % 9 AS h
            FROM own),
        rebuilt AS (
            SELECT p.conv_id, o.n AS place, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.base AND o.n <= p.h
            UNION ALL SELECT p.conv_id, o.n + 9, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.conv_id AND o.n > p.h),
        turns AS (
            SELECT p.conv_id, coalesce(list({'r': role, 't': text} ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS seq
            FROM plan p LEFT JOIN rebuilt r ON r.conv_id = p.conv_id GROUP BY p.conv_id),
        steps AS (SELECT conv_id, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq FROM turns),
        nodes AS (
            SELECT list_slice(seq, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256,
                   bool_and(size = depth)::BIGINT AS leaf
            FROM steps GROUP BY ALL),
        valued AS (
            SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].t) ELSE 0 END AS saved FROM nodes),
        below AS (
            SELECT a.conv_id, a.depth, sum(b.leaf)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens,
                   count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children
            FROM valued a JOIN valued b ON b.depth >= a.depth AND list_slice(b.path, 1, a.depth) = a.path GROUP BY ALL)
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, b.n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
        FROM valued v JOIN below b ON b.conv_id = v.conv_id AND b.depth = v.depth
        LEFT JOIN valued p ON p.depth = v.depth - 1 AND p.path = list_slice(v.path, 1, v.depth - 1)
    """,
}
