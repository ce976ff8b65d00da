"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bag_minhash, chat, decontaminate, language_id, licenses, order_minhash, packing, quality, secrets, sharding
from .common import table


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns(table(spark, sf_dir, "conversations"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_quality": op2_quality,
    "op3_order_minhash": op3_order_minhash,
    "op4_secret_scan": op4_secret_scan,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_chat_format": op9_chat_format,
    "op10_license_scan": op10_license_scan,
    "pipeline": corpus_pipeline.run,
    "license_phrases": license_phrases,
}

_CHAT = """WITH t AS (SELECT conv_id, turn, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS part,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations),
whole AS (SELECT conv_id, string_agg(part, '' ORDER BY place) AS text FROM t GROUP BY conv_id)
SELECT t.conv_id, place, turn::BIGINT AS turn, role, (sum(length(part)) OVER w - length(part))::BIGINT AS start, (sum(length(part)) OVER w)::BIGINT AS "end", false AS rewrites, NULL::VARCHAR AS error,
CASE WHEN place = 0 THEN whole.text END AS text FROM t JOIN whole ON t.conv_id IS NOT DISTINCT FROM whole.conv_id WINDOW w AS (PARTITION BY t.conv_id ORDER BY place)"""

_NOTICES = ", ".join(f"('{phrase}', '{identifier}')" for phrase, identifier in licenses.PHRASES.items())
_LICENSES = f"""WITH p(phrase, identifier) AS (VALUES {_NOTICES}),
d AS (SELECT doc_id, regexp_replace(lower(text), '\\s*\\n\\s*((/\\*+|//+|\\*+|#+|;+|--|%+|>+|<!--)[ \\t]*)?|[ \\t\\r\\f\\v]{{2,}}|[\\t\\r\\f\\v]', ' ', 'g') AS low FROM documents),
c AS (SELECT doc_id, identifier, phrase, low FROM d, p WHERE contains(low, phrase)),
n AS (SELECT doc_id, identifier, len(list_filter(range(length(low)), lambda i: substr(low, i + 1, length(phrase)) = phrase AND (i = 0 OR NOT regexp_full_match(substr(low, i, 1), '[\\pL\\pN]')) AND NOT regexp_full_match(substr(low, i + 1 + length(phrase), 1), '[\\pL\\pN]'))) AS n FROM c)
SELECT doc_id, identifier, sum(n)::BIGINT AS n FROM n WHERE n > 0 GROUP BY ALL"""

#: The others are networks, sketches, searches and iterations: the tests compare them with plain versions.
ORACLES: dict[str, str] = {"op9_chat_format": _CHAT, "license_phrases": _LICENSES}
