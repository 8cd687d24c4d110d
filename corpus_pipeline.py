"""A corpus from raw documents to packed sequences: each stage calls one operator of bibspark.llm.

A stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; all but the last return the columns
of documents.  Rows without a text count as empty ones: they are rated by an empty text's score, have no lines and no words, so no
copies, keep a null text, and are packed as the end mark alone.  Rows without an id are rated, cut and packed like others
but are nobody's copy; rows of equal ids stay or go together.  An empty table passes every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import line_dedup, ngram_join, packing, quality, secrets_scan
from bibspark.llm.common import drop_folder, read_table, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are poor or toxic by the fitted grades go."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.rated(docs, model).filter("keep").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later occurrences of three-line windows go; a document that loses all its lines goes too."""
    found = line_dedup.dedup_lines(docs)
    kept = found.filter("n_removed = 0 OR n_removed < n_lines")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark."""
    return secrets_scan.redact(docs).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", rate),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again, and goes when the next one is written.

    The last stage's table is what the result reads, so it stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(place), place
    return docs


#: SQL can't express the first, third, fourth and last stage; they are tested against brute force.
ORACLE_SQL = None
