"""Registered queries of the text operators, with checking SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scarpline.llm import (
    block_trie, byte_bpe, common, cube_divergence, hash_tree, pairwise_quality, pii, pivot_index, simhash_grid, suffix_dedup, suffix_tree_lm, syncmers, tiling, url_lm,
)


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(common.table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"))


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(common.table(spark, sf_dir, "documents"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return url_lm.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(common.table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_benchmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_rows(common.table(spark, sf_dir, "documents"))


def op10_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_grid.classes(common.table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_trie.trie(common.table(spark, sf_dir, "conversations"))


def op12_cube_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_divergence.audit(common.table(spark, sf_dir, "documents"))


def op13_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.classes(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pairwise_quality, op2_suffix_array_dedup, op3_personal_data, op4_syncmer_fingerprints, op5_url_verdicts, op6_suffix_tree_scores,
        op7_byte_bpe, op8_benchmark_tiles, op9_hash_tree_shards, op10_simhash_classes,
        op11_conversation_trie, op12_cube_divergences, op13_pivot_permutations,
    )
}

# The spans in SQL: base patterns as the contract writes them, positions from the pieces between matches.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1),
  lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT)
    ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS INT) * 2 - 9 * CAST(CAST(substr(reverse({_DIGITS}), i, 1) AS INT) > 4 AS INT) END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 + 1000 ELSE ascii(c) - 48 END)),
  lambda a, v: CASE WHEN v >= 1000 THEN (a * 100 + v - 1000) % 97 ELSE (a * 10 + v) % 97 END) = 1"""
_KEPT = {
    "email": "TRUE",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT) > 255, TRUE))) = 0",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": _MOD97,
    "ssn": "regexp_matches(near, '(^|[^a-z])(?:ssn|social|security)')",
}
_NEAR = f"lower(substr(text, greatest(start - {pii.NEAR}, 0) + 1, least(start, {pii.NEAR})) || ' ' || substr(text, stop + 1, {pii.NEAR}))"


def _kind_sql(rank: int, kind: str) -> str:
    return f"""SELECT row_no, {rank} AS rank, '{kind}' AS kind, start, stop FROM (SELECT *, {_NEAR} AS near FROM (
  SELECT row_no, text, m, start, start + length(m) AS stop FROM (
    SELECT row_no, text, found[i] AS m,
      CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT row_no, text, regexp_extract_all(text, '{_PATTERNS[kind]}') AS found, string_split_regex(text, '{_PATTERNS[kind]}') AS pieces FROM d
      WHERE regexp_matches(text, '{_PATTERNS[kind]}'))))))
WHERE {_KEPT[kind]}"""


_BASE_KINDS = ", ".join(f"'{k}'" for k in pii.BASE)
_COUNTS = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)
_ONE = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rank"

SQL: dict[str, str] = {
    "op3_personal_data": f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_kind_sql(r, k) for r, k in enumerate(pii.NAMES))})
SELECT any_value(d.doc_id) AS doc_id, {_COUNTS},
  sha256(coalesce(string_agg({_ONE}) FILTER (WHERE kind IN ({_BASE_KINDS})), '')) AS base_sha256,
  coalesce(string_agg({_ONE}), '') AS spans
FROM d LEFT JOIN s USING (row_no) GROUP BY row_no""",
    "op11_conversation_trie": block_trie.SQL,
    "op12_cube_divergences": cube_divergence.SQL,
}
