"""The registered queries of this subpackage: each applies its operator to a whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reprise.llm import brown, mixing, packing, pu, quality_rules, secrets, simhash, spotsigs, substrings, token_files
from reprise.llm.common import table
from reprise.storage import materialize


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialize(pu.described(docs), "described")
    return pu.score_described(rows, pu.fit_quality(docs, table(spark, sf_dir, "labels"), rows=rows))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op5_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(table(spark, sf_dir, "documents"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_quality_rules, op3_pu_quality, op4_substring_dedup, op5_bin_packing, op6_source_mix, op7_secret_scan, op8_token_files, op9_brown_lm, op10_spotsigs)
    return {f.__name__: f for f in own}


#: SQL for the one query that it can express whole; the others hold learned models, packing plans or hashes that DuckDB hasn't got.
SUBSTRING_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
  win as (select doc_id, s, md5(array_to_string(ws[s + 1 : s + 50], ' ')) as k from w, unnest(range(0, len(ws) - 49)) as t(s) where len(ws) >= 50),
  low as (select k, min(doc_id) as first from win group by k),
  gone as (select distinct doc_id, s + j as i from win join low using (k), unnest(range(0, 50)) as u(j) where doc_id > first),
  words as (select doc_id, i, ws[i + 1] as word from w, unnest(range(0, len(ws))) as t(i)),
  kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as kept from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": SUBSTRING_SQL}
