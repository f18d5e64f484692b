"""A cleaning pipeline over ``documents``: each stage takes (spark, docs, folder) and works on all its predecessor kept.

Stages: documents without a recognised language go; one document of each SimHash group of near copies stays; documents that hold a
benchmark item go; secrets are masked; what is left is packed into sequences. All stages but the last return the columns of
``documents``, whatever further columns the table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, langid, near_copies, packing, secrets, shared
from pagemill.llm.sampling import fold
from pagemill.llm.tokens import public_file
from pagemill.session import prepare

#: No SQL can train the language model or run the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose text has letters, and so a language; the model is learned from the labelled rows of ``docs``. Without
    any label the letters alone decide."""
    langs, matrix = langid.train(docs.filter(fold("doc_id", 5) != 0))
    if not langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = langid.identify(docs, langs, matrix)
    return judged.filter(F.col("lang_pred") != langid.UNKNOWN).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of texts alike in 0.8 or more of their five-word shingles: the least id, a null one last; rows that
    share an id are told apart by their contents."""
    return near_copies.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet")
    return decontaminate.without_leaks(docs, benchmark)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The same documents with secrets masked; ``n_chars`` follows the new text where the table has it."""
    masked = secrets.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", length)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack_documents(docs, public_file("byte_bpe_50k.json"), remember=False)  # workers of other stages stay small


STAGES = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written below the shared folder and read again."""
    prepare(spark)
    folder = shared.new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
