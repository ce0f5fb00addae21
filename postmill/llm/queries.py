"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann, bpe, conversations, crf, ctw, packing, parity_join, pii, quality_rules, secrets, sharding, simhash, vector_codes
from .common import small_batches
from .common import table as _table

#: The vocabulary file of the two tokenising queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return _table(spark, sf_dir, name)


def op1_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), sharding.balanced_tree(8), new_shard=8)


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality_report(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked_documents(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(table(spark, sf_dir, "conversations")), F.col("present"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_ivf_pq, op2_secret_links, op3_context_tree, op4_tree_bpe, op5_hash_tree, op6_crf_quality, op7_covering_simhash, op8_pii, op9_tiered_packing, op10_risk_rules, op11_parity_join, op12_conversation_repair, op13_vector_codes)
}
ORACLE_SQL: dict[str, str] = {
    # crc32 of an id is worked out bit by bit; windows of three words are rows, counted per text.
    "op10_risk_rules": r"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, case when lang in ('en', 'de', 'fr', 'es') then lang else 'other' end as stratum,
  coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ord(c)::bigint)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: case when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)), 4294967295::bigint) % 3, 0) as fold from documents),
 split as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from docs),
 windows as (select rid, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from split where len(w) >= 3),
 triples as (select rid, i, count(*) over (partition by rid, g) as n from windows),
 repeated as (select rid, count(distinct i + k) as n from triples, (select unnest([0, 1, 2]) as k) u where n > 1 group by rid),
 f as (select rid, doc_id, stratum, fold, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words from split left join repeated r using (rid)),
 b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  least(256, floor(n_symbols / greatest(word_chars, 1) * 256)) as symbols, least(256, floor(n_dup_lines / greatest(n_lines, 1) * 64)) as dup_lines, least(256, floor(n_repeat_words / greatest(n_words, 1) * 64)) as repeats, least(256, floor(word_chars / greatest(n_words, 1) * 8)) as word_length from f),
 truth as (select doc_id, max(quality) as quality from labels where doc_id is not null and quality is not null group by 1),
 marked as (select b.*, quality from b join truth using (doc_id)),
 levels as (select unnest([0.0, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05]::double[]) as q, unnest(range(11)) as level),
 tall as (select stratum, rule, bin, count(*) as n from (unpivot (select stratum, symbols, dup_lines, repeats, word_length from marked where fold <> 1 and quality = 1) on symbols, dup_lines, repeats, word_length into name rule value bin) group by 1, 2, 3),
 reach as (select stratum, rule, bin, sum(n) over (partition by stratum, rule order by bin desc) / sum(n) over (partition by stratum, rule) as share from tall),
 path as (select stratum, level, max(case when rule = 'symbols' then cutoff end) as c_symbols, max(case when rule = 'dup_lines' then cutoff end) as c_dup_lines, max(case when rule = 'repeats' then cutoff end) as c_repeats, max(case when rule = 'word_length' then cutoff end) as c_word_length
  from (select stratum, rule, level, max(bin) + 1 as cutoff from reach, levels where share > q group by 1, 2, 3) c group by 1, 2),
 tested as (select m.stratum, level, count_if(quality = 1) as good, count_if(quality = 1 and hit) as rejected_good, count_if(quality <> 1 and hit) as rejected_bad
  from (select m.stratum, level, quality, symbols >= c_symbols or dup_lines >= c_dup_lines or repeats >= c_repeats or word_length >= c_word_length as hit from marked m join path p on p.stratum = m.stratum where fold = 1) m group by 1, 2),
 tails as (select *, case when rejected_good >= good * 0.02 then 1 else list_sum(list_transform(range(rejected_good::bigint + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln(0.02) + (good - i) * ln(0.98)))) end as tail from tested),
 certified as (select *, max(tail) over (partition by stratum order by level) as worst from tails),
 chosen as (select stratum, level from certified where worst <= 0.01 and rejected_bad > 10 * rejected_good qualify row_number() over (partition by stratum order by rejected_bad - 10 * rejected_good desc, level) = 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(symbols >= c_symbols or dup_lines >= c_dup_lines or repeats >= c_repeats or word_length >= c_word_length, false) as kept, b.stratum
from b left join (select p.* from path p join chosen using (stratum, level)) c on c.stratum = b.stratum""",
}
