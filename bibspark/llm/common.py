"""Small helpers that the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.operators.rounds import checkpointed, components, shared_folder

__all__ = ["checkpointed", "components", "drop_folder", "mix64", "read_table", "shared_folder", "shuffle_width", "text_batches", "text_or_empty"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder from the store that its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(table_batches, column: str | tuple[str, str] = "text", most: int = 1 << 20, nulls: bool = False):
    """(batch, texts) with record batches cut so that the texts of one hold about `most` characters (one longer text stands alone).

    column may name a field of a struct column.  Null texts are empty ones, or None where nulls are wanted.
    """
    for batch in table_batches:
        values = batch.column(column) if isinstance(column, str) else batch.column(column[0]).field(column[1])
        texts = values.to_pylist() if nulls else [t or "" for t in values.to_pylist()]
        first = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if size and size + n > most:
                yield batch.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += n
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer with full avalanche on unsigned 64-bit values (constants of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
