"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word is a run of characters other than space and U+0009 to U+000D
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: rows that a task takes out of an Arrow batch at a time: a worker keeps the memory of its largest piece
FEW = 500


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words of a text; each becomes one character, so no word is a string of its own."""
    return F.length(F.regexp_replace(F.btrim(text, F.lit(BLANKS)), f"{WORD}[\\x20\\x09-\\x0D]*", ".")).cast("long")


def pieces(batch: pa.RecordBatch, rows: int = FEW) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a few rows, none for an empty one."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch, from its ``row`` where that carries them; null is read as empty."""
    own = "text" in batch.schema.names
    return [t or "" for t in (batch.column("text") if own else batch.column("row").field("text")).to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Have Spark remove the shuffle files of every job run inside once it has ended: what it wrote replaces them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
