"""Documents to training tokens: quality, near duplicates, personal data, mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. Between
stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickweave.llm.common import crc_mod, table
from tickweave.llm.line_quality import keep_good, train_quality
from tickweave.llm.mixing import mixed_rows
from tickweave.llm.pii import session_key, with_pseudonyms
from tickweave.llm.sentencepiece_trie import encode
from tickweave.llm.simhash import keep_one
from tickweave.session import stage

#: The stages call fitted models and hash functions that SQL does not have.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores at 0.7 or more."""
    may_learn = crc_mod(F.col("doc_id"), 4) != 2
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels"), may_learn))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of SimHash neighbours."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; n_chars follows the text."""
    return with_pseudonyms(docs, secret=session_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text with its SentencePiece ids."""
    return encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
