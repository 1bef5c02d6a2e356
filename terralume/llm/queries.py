"""The queries of the operators in this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralume.llm import crf_quality, minhash, mixing, ngram_join, packing, pii, quality_rules, sharding, toxicity, url_filter
from terralume.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.with_score(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = crf_quality.with_score(docs.select("doc_id", "text"), crf_quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= crf_quality.THRESHOLD).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_ngram_join, op4_url_filter, op5_quality_rules, op6_minhash, op7_mixing, op8_quality, op9_sharding, op10_pii, pipeline)}


def oracle_sql() -> dict[str, str]:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    kept = " and ".join(f"({ratio}) between {least} and {most}" for _, ratio, least, most in quality_rules.RULES)
    op5 = rf"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
    p as (select r, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) > 2),
    g as (select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as n from p),
    q as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from g where n > 1) group by r),
    c as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, len(regexp_extract_all(t, '!!')) as n_bangs,
        len(list_filter(ws, lambda x: x in ({stops}))) as n_stop_words, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) as n_same_as_last
        from w left join q using (r)),
    f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({kept}, false) as kept from f"""
    return {"op5_quality_rules": op5}
