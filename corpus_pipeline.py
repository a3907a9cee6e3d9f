"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads it back from Parquet.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import jaccard, language, lines, mixing, packing
from skirmish.llm.common import documents, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null and empty texts, those
    without a letter, and those with an ambiguous decoding.  Equal rows are judged
    alike."""
    return language.keep_known(docs, language.train(language.training_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages of two or more lines out of the texts; a text that
    consisted of nothing else goes.  Null and empty texts, and rows without a
    doc_id, stay as they are; of equal rows all stay, as one place of their text."""
    out = lines.dedup_lines(docs).where(~((F.col("n_removed") > 0) & (F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) == 0)))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of the least doc_id.
    Of equal rows one stays; different texts of one doc_id stay each unless they
    link; rows without a doc_id, and different texts without a word, stay."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out sources to their target weights.  Texts without a word are
    never drawn; a null source is one of its own; equal rows are drawn each."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place.  A null text counts as empty and
    has its end id; every row is packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trained models, hashed permutations and tokenizers have no SQL; the tests
#: hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
