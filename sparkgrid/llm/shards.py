"""Sharding by weighted rendezvous hashing, with gapless places inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.llm.tables import text_of

#: parts of a shard whose rows are ordered independently; a task orders one part
PARTS = 4096


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard that wins ``key``.

    Every shard draws a uniform number u from the hash of (key, shard) and the
    smallest ``-ln(u) / weight`` wins, so a shard gets rows in proportion to
    its weight.  Shards draw independently: adding one moves rows only into
    it, removing one moves only its own rows.  A null key draws like a value
    of its own.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive and name one shard at least")

    def draw(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        return F.struct((-F.log((bits + 0.5) / 2.0**53) / weight).alias("score"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[draw(s, w) for s, w in sorted(weights.items())]))["shard"]


def number_rows(rows: DataFrame, shard: str, parts: int = PARTS) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... inside each shard, in a hash-shuffled order.

    Equal rows are counted before the shuffle and spread out again at the end,
    so repeated rows are no hot key.  Each shard is cut into ``parts`` by a
    hash; the parts' sizes become first slots by a prefix sum over at most
    shards x parts rows, which is also the bound of what is broadcast.
    """
    values = [c for c in rows.columns if c != shard]
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    counted = counted.withColumn("_part", F.pmod(F.xxhash64(*values), F.lit(parts)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        counted.groupBy(shard, "_part").agg(F.sum("_copies").alias("_size"))
        .select(shard, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(shard, "_part").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_base") + F.coalesce(F.col("_ahead"), F.lit(0))
    return (
        counted.withColumn("_ahead", F.sum("_copies").over(inside))
        .join(F.broadcast(bases), [shard, "_part"])
        .withColumn("slot", F.explode(F.sequence(first, first + F.col("_copies") - 1)))
        .select(*rows.columns, "slot")
    )


def shard_documents(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None) -> DataFrame:
    """One row per document with its shard, its slot and its shard once grown.

    The record key is ``doc_id``; rows without one are keyed by the checksum
    of their text.  ``size`` is the text's UTF-8 bytes plus 1, a null text has
    none.  Repeated rows each get a row and a slot of their own; an empty
    table gives no rows; other columns are not read.
    """
    text = text_of(docs)
    crc = F.crc32(text)
    key = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), crc.cast("string")))
    rows = docs.select(
        docs["doc_id"], (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_rows(rows, "shard")


def write_shards(docs: DataFrame, weights: dict[int, float], path: str, files: int = 64) -> str:
    """Write whole rows as Parquet below ``path``, one folder a shard, and return the name of the folders' column.

    A shard is written by up to ``files`` tasks, so none holds a whole shard.
    The column is ``shard``, with underscores behind it while the table has a
    column of that name.  Rows without doc_id are keyed by the checksum of their
    text, a null text being empty; repeated rows are all written; an empty
    table writes no folder.
    """
    key = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), F.crc32(text_of(docs)).cast("string")))
    taken, name = {c.lower() for c in docs.columns}, "shard"
    while name in taken:
        name += "_"
    placed = docs.select(*[docs[f"`{c}`"] for c in docs.columns], rendezvous(key, weights).alias(name))
    part = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition(name, part).write.partitionBy(name).parquet(path)
    return name
