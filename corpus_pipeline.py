"""The corpus pipeline: language, toxicity, near duplicates, decontamination, packing.

Each stage takes what the one before it kept, decides on every document of it, and all but the last return the columns
of `documents`. The stages stand on the operators in reviewloom.llm and go with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import decontaminate, language, near_duplicates, packing, toxicity
from reviewloom.llm.catalog import vocabulary
from reviewloom.llm.shared import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told surely enough; null texts and texts without letters go."""
    told = language.predict(docs.select(*COLUMNS), language.train(docs))
    return told.where(~F.col("rejected")).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half.

    Null and empty texts have no toxic window and stay; repeated rows stay or go together; without labels of both kinds
    the score is constant, so that all stay unless every label is toxic.
    """
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.where("score < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id, a null id last."""
    return near_duplicates.keep_one(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark takes nothing out.
    """
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows of 4096 tokens.

    A null text is the end token alone; repeated rows are packed each; an empty table gives no piece.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 4096, 2)


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("packing", packed)]

#: SQL cannot express learnt filters, so the pipeline is tested against its stages' own brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
