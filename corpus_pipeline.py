"""A document table made ready for training: toxic documents, copies, near copies and leaks go, the rest is encoded.

Every stage takes all rows that the stage before kept, and all but the last return them with their
columns. Null or empty texts are clean, and count as equal texts; an empty table passes
through every stage. Each stage's rows are stored in the shared folder, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.llm import bpe, decontamination, exact_dedup, near_dedup, toxicity
from lodgeframe.llm.queries import PATTERN, RANKS, benchmark, documents, labels
from lodgeframe.llm.storage import stored

#: Documents with this score or more are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on all labelled rows, does not call toxic."""
    model = toxicity.train(docs, labels(spark, sf_dir), F.lit(True))
    return toxicity.score(docs, model).where(F.col("_score") < TOXIC).drop("_score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for A-Z in upper or lower case."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also with other names, numbers or units."""
    return decontamination.decontaminate(docs, benchmark(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left."""
    return bpe.encode_ids(docs, RANKS, PATTERN).withColumnRenamed("_ids", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: A trained classifier, MinHash components and BPE are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
