"""Near duplicates by SimHash, found with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import attach, settle
from sparkgrid.llm.groups import cells_of, components, forest, map_runs
from sparkgrid.llm.tables import pieces, text_of

SHINGLE = 4
SEED = 42
#: fingerprints with at most this many differing bits are linked
DISTANCE = 4
#: blocks a fingerprint is cut into; at most DISTANCE of them can differ
BLOCKS = 7
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str) -> int:
    """Majority bits of the hashes of a text's shingles; zero without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit integer."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces(whole)):
            found = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return ids.mapInArrow(signed, "doc_id long, fp long")


def masks() -> list[int]:
    """Masks of every choice of blocks that must agree, as signed integers."""
    bounds = np.linspace(0, 64, BLOCKS + 1).astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    chosen = [sum(c) for c in combinations(blocks, BLOCKS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def link_runs(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Links that join all close fingerprints of each run, at most one a member but for short runs."""
    values = table.column("fp").to_numpy().view(np.uint64)
    lengths = np.diff(starts)
    run = np.repeat(np.arange(len(lengths)), lengths)
    a, b = [], []
    short = lengths <= 8
    for step in range(1, 8):
        i = np.flatnonzero((run[:-step] == run[step:]) & short[run[:-step]])
        close = i[np.bitwise_count(values[i] ^ values[i + step]) <= DISTANCE]
        a.append(values[close])
        b.append(values[close + step])
    for r in np.flatnonzero(~short):
        own = np.unique(values[starts[r] : starts[r + 1]])
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= DISTANCE
        root = forest(near)
        moved = root != np.arange(len(own))
        a.append(own[moved])
        b.append(own[root[moved]])
    both = [np.concatenate(x).view(np.int64) for x in (a, b)]
    return pa.table(both, names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    Fingerprints of at most ``DISTANCE`` differing bits are linked, and
    component_id is the smallest doc_id that links lead to.  Of ``BLOCKS``
    blocks, ``BLOCKS - DISTANCE`` agree in any such pair, so each choice of
    that many blocks is a bucket key.  Equal fingerprints are one value before
    that; large buckets are compared in bounded cells and yield a spanning
    forest rather than pairs.

    A null text is empty and has fingerprint zero like all texts without
    words.  Rows without doc_id take part; the component of such rows alone is
    null.  Repeated rows stay rows; an empty table gives none; other columns
    are not read.
    """
    rows = settle(fingerprints(docs))
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks())])
    buckets = values.select("fp", F.explode(keys).alias("key"))
    links = map_runs(cells_of(buckets, "key", "fp"), ["key", "cell"], link_runs, "a long, b long")
    roots = components(links)
    rooted = settle(values.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = attach(rooted, first, ["root"]).select("fp", "component_id")
    return attach(rows, named, ["fp"]).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id.

    Rows that repeat a doc_id are one document, of which the row with the
    smallest text stays, a null text being empty.  Rows without doc_id all
    stay; an empty table gives none.  Other columns are kept, whatever their
    names.
    """
    members = settle(near_duplicates(docs))
    kept = members.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    packed = docs.select(docs["doc_id"].alias("id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    found = packed.join(kept, "id")
    again = found.filter("n > 1").groupBy("id").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    once = found.filter("n = 1").select("row.*")
    return once.unionByName(again.select("row.*")).unionByName(docs.filter(docs["doc_id"].isNull()))
