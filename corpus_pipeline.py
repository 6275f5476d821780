"""A corpus pipeline of operators from corpusloom.llm.

STAGES run in this order, each on what the one before kept: language identification, near duplicates, repeated
passages, benchmark leaks, mixing. Each stage's result is written as Parquet to the shared folder and read again as
the documents of the next, so that a lost executor costs one stage at most; what the stage before it wrote is deleted then. What the last stage reads is
deleted when the application ends, as its result is computed where the caller asks for it.

Defined cases: a null in any column passes every stage but the first, which drops null texts. Rows that share a doc_id, or have
none, are documents of their own. Other columns are kept whatever their names, but for those two that the first stage adds for itself
(``_language``, ``_language_score``) and mix_copy and mix_order, which the last replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontaminate import Decontaminate
from corpusloom.llm.jaccard_join import JaccardJoin
from corpusloom.llm.language_id import LanguageId, held_out
from corpusloom.llm.mixing import PoissonMix
from corpusloom.llm.suffix_dedup import SuffixDedup
from corpusloom.session import checkpoint_folder, delete_at_exit, delete_folder, durable, read_table

#: Each stage but the last returns the columns of the table ``documents``.
ORACLE_SQL = None  # the stages' suffix comparisons and trained model have no SQL; tests compare with brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    model = LanguageId().fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    told = model.annotate(docs, names=("_language", "_language_score"))
    return told.where(F.col("_language") != "und").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id."""
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key"))
    if not unclear.isEmpty():
        # doc_id doesn't tell rows apart: number them, and keep the numbers.
        held = durable(held.withColumn("key", F.monotonically_increasing_id()))
    groups = JaccardJoin().components(held.select("key", F.col("doc")["text"].alias("text")), id_col="key")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("key"))
    return held.join(gone, "key", "left_anti").select("doc.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 400-byte passages that stand elsewhere too; n_chars follows the text. Shorter passages stay, as the operator's contract has it."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = SuffixDedup().dedup(docs, with_text=True, carry=carry)
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    hits = Decontaminate().annotate_hits(docs, read_table(spark, sf_dir, "benchmark"), with_text=True, carry=carry)
    return hits.where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order."""
    return PoissonMix().mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4()}"
    delete_at_exit(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
