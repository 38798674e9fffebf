"""The operators' queries over the shared tables, each with production parameters, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from srcquarry.llm import (
    bpe,
    chat_format,
    conversation_repair,
    conversation_trie,
    decontamination,
    fingerprints,
    html_extract,
    ngram_join,
    quality_rules,
    secrets,
    token_counts,
    token_output,
    toxicity,
)
from srcquarry.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.model())


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations")).drop("problems")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.borrowed_heads_trie(table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_output,
        op2_html_extract,
        op3_ngram_join,
        op4_quality_rules,
        op5_toxicity,
        op6_decontamination,
        op7_secrets,
        op8_chat_format,
        op9_token_counts,
        op10_bpe,
        op11_prefix_trie,
        op12_fingerprints,
        op13_structure_repair,
    )
    return {f.__name__: f for f in every}


#: Plain dialogues; texts that are tool calls in JSON do not occur in the shared tables.
OP8_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text, role IS NOT DISTINCT FROM 'user' AS ask, role IS NOT DISTINCT FROM 'assistant' AS answer,
         CASE WHEN role = 'user' THEN conv_id || ':' || turn WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
calls AS (SELECT conv_id, call_id, count(*) AS calls FROM m WHERE ask GROUP BY ALL),
results AS (SELECT conv_id, call_id, count(*) AS results FROM m WHERE answer GROUP BY ALL)
SELECT m.conv_id, m.turn, 0 AS seq, CASE WHEN ask THEN 'call' WHEN answer THEN 'result' ELSE 'message' END AS kind, m.call_id,
       CASE WHEN ask THEN CASE WHEN calls IS NOT NULL THEN 0 END WHEN answer THEN CASE WHEN calls IS NOT NULL THEN 1 END ELSE 0 END AS depth,
       calls IS NOT NULL AND results IS NOT NULL AS linked,
       CASE WHEN ask THEN coalesce(length(text), 0) > 0 END AS valid,
       CASE WHEN ask THEN '{"arguments":{' || coalesce('"text":' || to_json(text) || ',', '') || '"turn":' || m.turn || '},"call_id":' || to_json(m.call_id) || ',"name":"ask","role":"user"}'
            ELSE '{' || coalesce('"call_id":' || to_json(m.call_id) || ',', '') || coalesce('"content":' || to_json(text) || ',', '') || '"role":' || to_json(role) || '}' END AS json
FROM m LEFT JOIN calls ON m.conv_id = calls.conv_id AND m.call_id = calls.call_id
       LEFT JOIN results ON m.conv_id = results.conv_id AND m.call_id = results.call_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": OP8_SQL}
