"""Packing token documents into sequences: dominance reduction, then best fit, on counts of lengths."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import attach, settle
from sparkgrid.llm.tables import text_of
from sparkgrid.llm.tokenize import Encoder

#: documents that a task hands over at a time
FEW = 500
PIECES = "doc_id long, piece int, start long, length int, ids binary, run int, nth long"
#: a bin's content: how many items of which length, the first ones at its start
Pattern = tuple[tuple[int, int], ...]


@functools.cache
def wide_encoder(path: str) -> Encoder:
    """An encoder whose ids are little-endian unsigned 32-bit integers whatever the vocabulary."""
    coder = Encoder(path)
    coder.width, coder.code = np.dtype("<u4"), "I"
    return coder


def cut_documents(docs: DataFrame, tokenizer: str, limit: int, end_id: int) -> DataFrame:
    """Documents as pieces of at most ``limit`` ids: (doc_id, piece, start, length, ids, run, nth).

    A longer document is cut so that only its first piece is shorter.  ``ids``
    are packed 32-bit integers.  ``nth`` counts the pieces of one length in
    ``run``, the task that cut them; both are written with the rows, so they
    hold however often the table is read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, run = wide_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = [0] * (limit + 1)
        for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
            out: list[tuple] = []
            encoded = coder.encode_all(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                packed = ids + end
                size = len(packed) // 4
                piece, at, length = 0, 0, size % limit or limit
                while at < size:
                    out.append((doc_id, piece, at, length, packed[4 * at : 4 * (at + length)], run, seen[length]))
                    seen[length] += 1
                    piece, at, length = piece + 1, at + length, limit
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids", "run", "nth"])

    return rows.mapInArrow(cut, PIECES)


def dominating_set(item: int, counts: np.ndarray, limit: int) -> tuple[int, ...] | None:
    """Items that, beside ``item``, are at least as good as any other way to fill its bin; None if unproven.

    A set dominates another if the other's items can be dealt out to items of
    the set none of which is smaller than what it gets: swapping them in any
    packing leaves it no worse.  Proofs are for bins that no third further
    item fits into, and for exact pairs:

    * nothing fits: the item alone;
    * some item fills the bin exactly: it takes in whatever would lie there;
    * only one fits: the largest that does;
    * two fit, but no pair sums to more than the largest single: that single;
    * two fit, and every pair has its smaller item at most b, where b is the
      largest partner of the largest single a: a and b.
    """
    room = limit - item
    others = counts.copy()
    others[item] -= 1
    present = np.flatnonzero(others)
    fits = present[present <= room]
    if not len(fits):
        return ()
    if fits[-1] == room:
        return (room,)
    largest = int(fits[-1])
    smallest = np.repeat(present[:3], np.minimum(others[present[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[:2].sum() > room:
        return (largest,)
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    partner = np.searchsorted(fits, np.minimum(fits, room - fits), side="right") - 1
    alone = (partner >= 0) & (fits[partner] == fits) & (others[fits] < 2)
    partner = np.where(alone, partner - 1, partner)
    sums = np.where(partner >= 0, fits + fits[partner], 0)
    if sums.max() <= largest:
        return (largest,)
    if partner[-1] < 0:
        return None
    second = int(fits[partner[-1]])
    above = present[present > second]
    two = np.repeat(above[:2], np.minimum(others[above[:2]], 2))[:2]
    return (largest, second) if len(two) < 2 or two.sum() > room else None


def reduce_by_dominance(counts: np.ndarray, limit: int) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Martello and Toth's reduction on counts of lengths: fixed bins, and the counts of what is left.

    Items are tried from the largest down until a whole pass fixes nothing.
    Each proof survives the removal of its own items, so it is applied as
    often as they last.
    """
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for item in range(limit, 0, -1):
            while counts[item]:
                found = dominating_set(item, counts, limit)
                if found is None:
                    break
                need = Counter((item, *found))
                times = min(int(counts[length]) // n for length, n in need.items())
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                for length, n in need.items():
                    counts[length] -= n * times
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray, limit: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing on counts: each item goes where least room is left, alike bins at once."""
    bins: dict[int, list[tuple[Pattern, int]]] = {limit: []}
    free = np.zeros(limit + 1, dtype=bool)

    def put(room: int, pattern: Pattern, times: int) -> None:
        bins.setdefault(room, []).append((pattern, times))
        free[room] = True

    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            rooms = np.flatnonzero(free[length:])
            room = length + int(rooms[0]) if len(rooms) else limit
            each = min(room // length, left)
            if len(rooms):
                pattern, there = bins[room].pop()
                free[room] = bool(bins[room])
            else:
                pattern, there = (), left // each
            times = min(there, left // each)
            if there > times:
                put(room, pattern, there - times)
            put(room - each * length, (*pattern, (length, each)), times)
            left -= each * times
    return [group for room in sorted(bins) for group in bins[room]]


def packing_plan(counts: np.ndarray, limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: rows (length, first, until, sequence, each, place).

    Items ``first`` to ``until`` of a length lie in sequences from ``sequence``
    on, ``each`` in one, from ``place`` on.  A group of alike bins uses up a
    length or leaves less of it than a bin holds, so the rows are bounded by
    ``limit`` alone, whatever the number of documents.
    """
    fixed, rest = reduce_by_dominance(counts, limit)
    rows, sequence, used = [], 0, np.zeros(limit + 1, dtype=np.int64)
    for pattern, times in [*fixed, *best_fit(rest, limit)]:
        place = 0
        for length, each in pattern:
            rows.append((length, int(used[length]), int(used[length]) + each * times, sequence, each, place))
            used[length] += each * times
            place += each * length
        sequence += times
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their sequence and offset: (doc_id, piece, start, length, ids, sequence_id, offset).

    Only the counts of lengths, ``limit`` numbers, are packed on the driver.
    Pieces of a length are numbered by a prefix sum over the tasks that cut
    them and take their places from the plan, so a length that a third of all
    documents share is no hot key.

    A null text is empty and is its end id alone; rows without doc_id and
    repeated rows are documents each; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    pieces = settle(cut_documents(docs, tokenizer, limit, end_id))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = settle(
        pieces.groupBy("length", "run").agg(F.count("*").alias("n"))
        .select("length", "run", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    counts = np.zeros(limit + 1, dtype=np.int64)
    for row in runs.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    plan = spark.createDataFrame(packing_plan(counts, limit), "length int, first long, until long, sequence long, each long, place long")
    rank = F.col("base") + F.col("nth")
    ranked = attach(pieces, runs.drop("n"), ["run", "length"], settled=True).withColumn("rank", rank)
    placed = ranked.join(F.broadcast(plan), "length").filter("rank >= first AND rank < until")  # bounded by ``limit``
    inside = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("sequence") + F.floor(inside / F.col("each"))).alias("sequence_id"),
        (F.col("place") + F.col("length") * (inside % F.col("each"))).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): whole sequences, at most ``limit`` ids each, and where their pieces start."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id",
        F.aggregate("_parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"),
        F.transform("_parts", lambda p: p["offset"]).alias("starts"),
    )
