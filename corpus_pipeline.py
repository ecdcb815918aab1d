"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``.

Edge cases: a document with null or empty text has no word, so the quality classifier
rejects it; texts may be of any length; a null language takes no part in training; ratings
with nulls are not used; a document without id is scored like any other, is no near
duplicate of any, and is packed; rows that repeat an id are scored each, and the near
duplicates stage keeps one of them, the text that hashes lowest; of documents that tie in a
group the smallest id stays; empty tables give empty results; further columns are carried
along as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.llm import crf_language, ordinal_quality, packing, partenum_join
from panelstats.llm.common import among, crc_bucket, ship, table, written
from panelstats.llm.queries import vocabulary

#: A document stays if its language's share of the word posteriors is at least this.
LEAST_LANGUAGE_SCORE = 0.5
#: Bytes of text that packing takes at a time, beside what the workers hold from the stages before.
PACKED_BYTES = 4_000_000


#: Columns that the operators read; all others get neutral names while an operator adds its own.
READ = ("doc_id", "text", "lang")


def where(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: Column | str) -> DataFrame:
    """The rows of ``docs`` for which the columns that ``judge`` adds meet ``condition``."""
    neutral = [c if c in READ else f"own_{i}" for i, c in enumerate(docs.columns)]
    return judge(docs.toDF(*neutral)).where(condition).select(*neutral).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half."""
    ship(spark)
    model = ordinal_quality.train(docs, ordinal_quality.graded(table(spark, sf_dir, "labels")))
    return where(docs, lambda d: ordinal_quality.score(d, model), "kept")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one recognised language; learned from those not held out."""
    ship(spark)
    model = crf_language.train(docs, crc_bucket("doc_id", 4) != 2)
    told = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return where(docs, lambda d: crf_language.label(d, model), told)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, once; documents
    without an id stay."""
    ship(spark)
    groups = written(partenum_join.join(docs), "groups").where("doc_id = component_id")
    ids = written(groups.select("doc_id").distinct(), "kept")
    kept = among(docs, ids, "doc_id")
    if groups.count() > ids.count():  # rows that repeat an id
        least = F.min_by(F.struct("*"), F.struct(F.xxhash64("text"), F.col("text")))
        kept = kept.groupBy(F.col("doc_id").alias("of")).agg(least.alias("row")).select("row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, most=PACKED_BYTES, lasting=False)


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("packing", pack)]
#: Fitted models and iterative grouping: not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


#: Rows that go to a Python worker at a time: a batch of whole texts is held on both sides at once.
BATCH_ROWS = 1_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    finally:
        spark.conf.set(key, before)
    return docs
