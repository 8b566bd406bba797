"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adquanta.llm.compression import CLASS_BYTES, CUT, PER_CLASS, fit_compression, score_quality
from adquanta.llm.exact import drop_exact
from adquanta.llm.fit import labelled_sample, remainder
from adquanta.llm.minhash import drop_near
from adquanta.llm.packing import pack
from adquanta.llm.suffixes import remove_repeats
from adquanta.llm.words import unused
from adquanta.session import stage
from adquanta.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality",
                             remainder("doc_id", 5) != 0, PER_CLASS, CLASS_BYTES)
    score = unused("_quality", docs.columns)
    scored = score_quality(docs, fit_compression(sample), out=score)
    return scored.where(F.col(score) >= CUT).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return drop_near(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that occur twice; ``n_chars`` follows the text."""
    cut = remove_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(
            docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
