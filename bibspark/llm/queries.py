"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import anchors, bytebpe, ibf, line_dedup, ngram_join, ogg, packing, quality, secrets_scan, warc
from bibspark.llm.common import read_table


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.rated(docs, model).select("doc_id", "score", "expected_grade", "tail_probability", "keep")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(read_table(spark, sf_dir, "pages"))


def op3_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(read_table(spark, sf_dir, "documents"))


def op5_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.dedup(read_table(spark, sf_dir, "documents"), with_text=False)


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(read_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read_table(spark, sf_dir, "documents"))


def op10_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibf.compare_versions(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_ordinal_quality, op2_warc_derivatives, op3_residual_packing, op4_ogg_media, op5_anchor_dedup, op6_entropy_secrets, op7_byte_bpe, op8_ngram_jaccard, op9_line_windows, op10_invertible_sketch, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_derivatives": warc.sql(), "op5_anchor_dedup": anchors.SQL, "op9_line_windows": line_dedup.SQL_DIGESTS}
