"""The operators as named queries over the standard tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from basketlore.llm.byte_bpe import encode
from basketlore.llm.conversation_trie import prefix_trie
from basketlore.llm.embedding_whitening import whiten_embeddings
from basketlore.llm.exact_dedup import exact_dedup
from basketlore.llm.fingerprint import fingerprint_edits
from basketlore.llm.katz import katz_scores
from basketlore.llm.license_scan import license_scan
from basketlore.llm.mixing import mix
from basketlore.llm.ngram_join import ngram_jaccard_join
from basketlore.llm.quality import quality_classifier
from basketlore.llm.secret_scan import secret_scan
from basketlore.llm.shared import documents, labels
from basketlore.llm.token_files import encode_to_files
from basketlore.llm.tool_calls import link_conversations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_exact_dedup(spark, folder):
    return exact_dedup(documents(spark, folder), keep="largest")


ORACLE_SQL["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


@query
def op10_secret_scan(spark, folder):
    return secret_scan(documents(spark, folder))


@query
def op4_byte_bpe(spark, folder):
    return encode(documents(spark, folder), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_fingerprint(spark, folder):
    return fingerprint_edits(documents(spark, folder))


@query
def op6_license_scan(spark, folder):
    return license_scan(documents(spark, folder))


@query
def op8_ngram_join(spark, folder):
    return ngram_jaccard_join(documents(spark, folder))


@query
def op3_quality(spark, folder):
    return quality_classifier(documents(spark, folder), labels(spark, folder))


@query
def op9_katz(spark, folder):
    return katz_scores(documents(spark, folder))


@query
def op7_tool_calls(spark, folder):
    return link_conversations(spark.read.parquet(f"{folder}/conversations.parquet"))


ORACLE_SQL["op7_tool_calls"] = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
    CASE role WHEN 'assistant' THEN 'call' WHEN 'user' THEN 'result' ELSE coalesce(role, 'unknown') END AS kind
  FROM conversations
),
c AS (
  SELECT DISTINCT a.conv_id, a.turn, r.turn IS NOT NULL AS answered
  FROM m a LEFT JOIN m r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1 AND r.kind = 'result'
  WHERE a.kind = 'call'
),
l AS (
  SELECT c.conv_id, c.turn, c.answered, 0 AS level
  FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 AND p.answered
  WHERE p.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, c.answered, l.level + 2
  FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2 WHERE l.answered
)
SELECT m.conv_id, m.turn, m.kind,
  CASE m.kind WHEN 'call' THEN m.conv_id || ':' || m.turn WHEN 'result' THEN m.conv_id || ':' || (m.turn - 1) END AS call_id,
  CASE m.kind WHEN 'call' THEN l.level WHEN 'result' THEN l.level + 1 END AS level,
  CASE WHEN m.kind = 'call' THEN CASE WHEN l.answered THEN 'linked' ELSE 'open' END
    WHEN m.kind = 'result' THEN CASE WHEN l.turn IS NULL THEN 'orphan' ELSE 'linked' END
    ELSE 'plain' END AS status,
  CASE WHEN m.kind <> 'call' THEN '' WHEN length(m.text) < 1 THEN 'chars: below 1'
    WHEN length(m.text) > 1500 THEN 'chars: above 1500' ELSE '' END AS errors,
  CASE WHEN m.kind = 'call' THEN '{"arguments":{"chars":' || length(m.text) || ',"text":' || to_json(m.text) || '},"id":"'
      || m.conv_id || ':' || m.turn || '","name":"answer","type":"call"}'
    WHEN m.kind = 'result' THEN '{"content":' || to_json(m.text) || ',"id":"' || m.conv_id || ':' || (m.turn - 1) || '","type":"result"}'
    ELSE '{"content":' || to_json(m.text) || ',"type":' || to_json(m.kind) || '}' END AS json
FROM m LEFT JOIN l ON l.conv_id = m.conv_id AND l.turn = CASE m.kind WHEN 'call' THEN m.turn WHEN 'result' THEN m.turn - 1 END
"""


@query
def op2_mixing(spark, folder):
    return mix(documents(spark, folder))


@query
def op11_prefix_trie(spark, folder):
    return prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet")).drop("name")


# The lookup table of CRC-32 is computed from its polynomial.
ORACLE_SQL["op11_prefix_trie"] = """
WITH tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i:
    CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t
),
m AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
      list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
      lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM m), tab
),
r AS (
  SELECT c.conv_id, 0 AS own, m.pos, m.role, m.text FROM c JOIN m ON m.conv_id = c.base AND m.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, m.pos, m.role, m.text FROM c JOIN m ON m.conv_id = c.conv_id AND m.pos > c.h
),
s AS (
  SELECT conv_id, role, text, row_number() OVER w AS depth,
    list(sha256(length(role) || ':' || role || text)) OVER w AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
),
p AS (
  SELECT conv_id, depth, sha256(node::VARCHAR) AS node, sha256(node[:-2]::VARCHAR) AS parent,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM s
  UNION ALL
  SELECT conv_id, 0, sha256('[]'), NULL, 0 FROM c
),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (
  SELECT p.node, any_value(p.depth) AS depth, any_value(p.parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(p.words) AS saved,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.len = p.depth), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY p.node
),
k AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
t AS (
  SELECT p.node, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN k ON k.node = n.node
  GROUP BY p.node
)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN t ON t.node = n.node LEFT JOIN n q ON q.node = n.parent LEFT JOIN k ON k.node = n.node
"""


@query
def op12_whitening(spark, folder):
    return whiten_embeddings(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op13_token_files(spark, folder):
    return encode_to_files(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
