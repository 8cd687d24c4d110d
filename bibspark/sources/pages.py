"""Pages of documents: where their text comes from, and lines from recognised words.

PDF and image decoding need libraries and programs outside Spark; page text and word tables are inputs here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATIVE_LEAST = 80
PAGE_BUDGET = 2
TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def in_ocr_budget(index, page_count, budget: int | None):
    """Whether a page (from 0) is read by OCR: all without a budget, none for 0, else the first ones, the last page taking the last place from a budget of 2 on."""
    if budget is None:
        return F.lit(True)
    if budget <= 0:
        return F.lit(False)
    if budget == 1:
        return index == 0
    return (page_count <= budget) | (index < budget - 1) | (index == page_count - 1)


def routed(pages: DataFrame, ocr: DataFrame | None = None, *, budget: int | None = PAGE_BUDGET) -> DataFrame:
    """doc_id, page_number, text, method, character_count, confidence, diagnostic_code from (doc_id, page_number, native_text).

    Native text of 80 characters or more stands; other pages within the budget take the OCR result (doc_id, page_number, text, confidence,
    diagnostic_code), unavailable without one; the rest are skipped.
    """
    from pyspark.sql import Window as W

    native = F.trim(F.coalesce("native_text", F.lit("")))
    rows = pages.withColumn("page_count", F.count(F.lit(1)).over(W.partitionBy("doc_id"))).withColumn("is_native", F.length(native) >= NATIVE_LEAST)
    wanted = in_ocr_budget(F.col("page_number") - 1, F.col("page_count"), budget)
    if ocr is None:
        rows = rows.withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_confidence": F.lit(None).cast("double"), "ocr_code": F.lit("ocr_not_available")})
    else:
        rows = rows.join(ocr.select("doc_id", "page_number", F.col("text").alias("ocr_text"), F.col("confidence").alias("ocr_confidence"), F.col("diagnostic_code").alias("ocr_code")), ["doc_id", "page_number"], "left")
    method = F.when(F.col("is_native"), "native").when(~wanted, "skipped").when(F.col("ocr_text").isNull(), "unavailable").otherwise("ocr")
    rows = rows.withColumn("method", method)
    text = F.when(F.col("method") == "native", F.col("native_text")).when(F.col("method") == "ocr", F.col("ocr_text")).otherwise("")
    return rows.select("doc_id", "page_number", text.alias("text"), "method", F.length(text).alias("character_count"), F.when(F.col("method") == "ocr", F.col("ocr_confidence")).alias("confidence"), F.when(F.col("method") == "unavailable", F.col("ocr_code")).alias("diagnostic_code"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word tables that an OCR program writes as tab-separated values."""
    return spark.read.csv(path, sep="\t", header=True, schema=TSV, quote="")


def lines(words: DataFrame, *, keys: list[str], line: list[str], text: str = "text", order: str = "ord") -> DataFrame:
    """keys and text: words joined by spaces to lines, lines by line feeds, in the order of the line's numbers and of arrival.

    Blank words and words of confidence -1 don't count.
    """
    used = words.filter(F.trim(text) != "")
    if "conf" in words.columns:
        used = used.filter(F.coalesce("conf", F.lit(0.0)) >= 0)
    one = used.groupBy(*keys, *line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("w")))), lambda x: x["w"]), " ").alias("line_text"))
    return one.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*line, "line_text"))), lambda x: x["line_text"]), "\n").alias("text"))


def mean_confidence(words: DataFrame, *, keys: list[str]) -> DataFrame:
    """Mean of the confidences that aren't negative, as a share from 0 to 1; 0 without any."""
    mean = F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100
    return words.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mean, F.lit(0.0)))).alias("confidence"))


def recognition_command(program: Column | str, image: Column, output: Column, *, languages: str, page_mode: int = 3, models: str | None = None) -> Column:
    """The arguments, as an array, with which a recogniser writes a table of a page's words; running it is left to who has the program."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    folder = ["--tessdata-dir", models] if models else []
    return F.array(lit(program), image, output, *[F.lit(a) for a in ("-l", languages, "--oem", "1", "--psm", str(page_mode), *folder, "-c", "tessedit_create_tsv=1")])
