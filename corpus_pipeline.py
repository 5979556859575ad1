"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next.

All stages but the last return the columns of ``documents``; the last returns packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common, lines, mixing, packing, simhash, toxicity
from milemark.llm.langid import fold


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The network learns from labelled documents whose fold is not 0, as in op8."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), "_toxicity")
    return scored.where("_toxicity < 0.5").select(*common.names(docs))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and texts of which nothing is left; ``n_chars`` follows the text."""
    left = lines.dedup(docs, counts=("_lines", "_removed")).where("_removed = 0 or _removed < _lines")
    n_chars = F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*common.names(docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, grouped as in op6: shingles of three words, two differing bits."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target shares: a row for each time that a document is taken."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return packing.pack(common.stored(packing.pieces(docs)))


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", repeated_lines_out),
    ("simhash", near_copies_out),
    ("mixing", mixed),
    ("packing", packed),
]
# A network, fingerprints and a tokenizer have no SQL form; tests/llm holds lines, SimHash and packing against
# brute force, not the toxicity and mixing stages as they run here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
