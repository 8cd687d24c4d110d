from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHES = ["key", "row", "grp", "doc", "lines", "h", "cell", "rep", "band", "id", "k", "node", "score", "keep", "links", "media", "sequence_id", "offset", "pos"]


def documents(spark, rows, clash=False):
    """rows: (doc_id, text)."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d"), (6, "line one\nline two\nline three\nline four"), (7, "line one\nline two\nline three\nline four"),
    (8, "Zoë's naïve café — 東京 123 !!\r\n  it's we're they'll   x"), (9, "word " * 3000), (10, "\n\n\n\n\n"), (None, "no id here at all"), (11, "x" * 5000), (11, "x" * 5000), (12, "<|endoftext|> and <|endoftext|>"), (-5, "line one\nline two\nline three"),
]
