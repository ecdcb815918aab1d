"""The thin queries of the operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    crf_language,
    filter_audit,
    learned_partitions,
    lexical_buckets,
    ngram_ratio,
    ordinal_quality,
    packing,
    partenum_join,
    simhash_vptree,
    suffix_tree_lm,
    token_planes,
    warc,
)
from .common import crc_bucket, pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                         "window", "step_group")


@register
def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register
def op3_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = ngram_ratio.trusted_ids(table(spark, sf_dir, "labels"))
    return ngram_ratio.judge(table(spark, sf_dir, "documents"), trusted)


@register
def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) == 2)


@register
def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    model = ordinal_quality.train(docs, ordinal_quality.graded(table(spark, sf_dir, "labels")))
    return ordinal_quality.score(docs, model).drop("text")


@register
def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf_language.train(docs, crc_bucket("doc_id", 4) != 2)
    held_out = (crc_bucket("doc_id", 4) == 2).alias("held_out")
    rows = pick(docs, doc_id="long", text="string").select("doc_id", "text", held_out)
    return crf_language.label(rows, model).drop("text")


@register
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0))


@register
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


@register
def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_planes.read_planes(token_planes.write_planes(docs, vocabulary("byte_bpe_50k.json"), end_id=2))


@register
def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.join(table(spark, sf_dir, "documents"))


@register
def op11_lexical_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_buckets.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE_SQL["op11_lexical_buckets"] = lexical_buckets.ORACLE_SQL


@register
def op12_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.join(table(spark, sf_dir, "documents"))


@register
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op13_filter_audit"] = filter_audit.oracle()
