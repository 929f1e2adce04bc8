"""Corpus pipeline: language ID, line dedup, near-duplicate join, mixing, packing.

Every stage takes the documents that its predecessor kept, all of them, and all
but the last return the columns of ``documents``.  Extra columns pass through.

* ``language_id`` drops documents whose language is undetermined (no letter, or
  no language more likely than all others together).
* ``line_dedup`` cuts lines that stand on many sources, but at their first
  place; ``n_chars`` follows the text.  A document that is as a whole a copy of
  an earlier one is left to the next stage.
* ``near_duplicates`` keeps the document with the smallest id (null last) of
  each group linked by shingles of five words at a similarity of 0.8 or more.
  Every row is a document of its own, whatever its id: of rows that repeat one
  stays, and rows that share an id but not a text, or have none, are compared
  like others.
* ``mixing`` repeats or leaves out documents so that sources meet their targets.
* ``packing`` tokenises what is left and packs it into sequences.

A null text has no letter, so it goes in the first stage; later stages take
null or empty texts as their operators define.  SQL can't express the stages
(models, balanced sampling, packing), so the tests hold them against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import cube_mixing, line_spread, lp_packing, metric_join, unigram_langid
from folio.llm._common import staged
from folio.llm.queries import LEAST_SITES, PIECE_VOCABULARY, WORD_TOKENIZER
from folio.tables import table

LEAST_POSTERIOR = 0.5
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = unigram_langid.fit(docs, PIECE_VOCABULARY)
    found = unigram_langid.identify(docs, model, keep=tuple(docs.columns), names=("__pred", "__score"))
    return found.where((F.col("__pred") != unigram_langid.UNDETERMINED) & (F.col("__score") >= LEAST_POSTERIOR)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_spread.dedup(docs, LEAST_SITES, spare_copies=True, counts=("__lines", "__removed"))
    n_chars = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = metric_join.classify(rows, key="__row", size=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    members = staged(groups.where("component_id IS NOT NULL").join(rows.select("__row", "doc_id"), "__row").select("__row", "doc_id", "component_id"), "members")
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("kept"), F.count("*").alias("n")).where("n > 1")
    copies = staged(members.join(metric_join.small(kept), "component_id").where("__row <> kept").select("__row"), "copies")
    return rows.join(metric_join.small(copies), "__row", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = cube_mixing.mix(docs, keep=tuple(docs.columns), copies="__copies")
    nth = "_" * (1 + max(map(len, docs.columns)))  # longer than any column, so none clashes
    return mixed.where("__copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias(nth)).drop(nth)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lp_packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
