"""The corpus pipeline: documents in, packed sequences out; each stage is written and read again by its runner.

Cases that hold for every stage: an empty table stays empty; columns beyond
COLUMNS are left out; repeated rows are documents of their own until the stage
of near-duplicates, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import lines, mixing, packing, quality, simhash
from changelens.llm.base import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; a null or empty text is scored like any other, a score of 0.7 is kept, a null id counts as no labelled row."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows a text that was cut. A null text stays null, a null source is one site, a text of such lines alone becomes empty and stays."""
    cut = lines.remove_boilerplate(docs)
    n_chars = F.when(F.col("n_cut") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 and more. Of a group the smallest id stays; null and empty texts are one group, texts without a word are like equal ones only."""
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for: not at all, once or twice; a null source is one source, and the last."""
    return mixing.apply_mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("lines", cut_lines),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read as the next one's input."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
