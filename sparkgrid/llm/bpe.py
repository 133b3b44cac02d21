"""BPE encoding through a table of distinct words, and decoding through a table of pieces."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import reusable
from sparkgrid.llm.tables import partitions, text_of
from sparkgrid.llm.tokenize import byte_characters, words_of

#: characters after which a task starts a new block of documents
BLOCK = 32_000_000
#: documents that a task handles at a time
FEW = 500
WORDS = "block long, slice int, check long, numbers binary, words array<string>"
ENTRIES = "block long, check long, kind int, doc_id long, numbers binary, sizes binary, ids binary"


def number_blocks(batches: Iterator[pa.RecordBatch], tokenizer: str, limit: int) -> Iterator[tuple[int, dict, list]]:
    """Split the task's documents into words and number the words of each block as they come.

    Yields (block, numbers, [(doc_id, word numbers)]) every few documents;
    ``numbers`` maps the block's words so far to their number.
    """
    at, size = 0, 0
    split = words_of(tokenizer).split
    numbers: dict[str, int] = {}
    for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
        found = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = split(text)
            for word in words:
                if word not in numbers:
                    numbers[word] = len(numbers)
            found.append((doc_id, np.fromiter(map(numbers.__getitem__, words), dtype="<u4", count=len(words))))
            size += len(text)
        yield batch.column("task")[0].as_py() << 20 | at, numbers, found
        if size > limit:
            at, size, numbers = at + 1, 0, {}


def planes(values: np.ndarray) -> bytes:
    """32-bit integers byte plane by byte plane, which compresses well in a shuffle."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def words_of_blocks(rows: DataFrame, tokenizer: str, slices: int, limit: int) -> DataFrame:
    """The distinct words of each block, dealt into slices by the hash of the word."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(block: int, numbers: dict[str, int]) -> pa.RecordBatch:
            dealt: list[list[str]] = [[] for _ in range(slices)]
            for word in numbers:
                dealt[zlib.crc32(word.encode("utf-8", "surrogatepass")) % slices].append(word)
            kept = [(i, words) for i, words in enumerate(dealt) if words]
            return pa.RecordBatch.from_arrays([
                pa.array([block] * len(kept), pa.int64()), pa.array([i for i, _ in kept], pa.int32()),
                pa.array([len(numbers)] * len(kept), pa.int64()),
                pa.array([planes(np.fromiter((numbers[w] for w in words), dtype="<u4")) for _, words in kept], pa.binary()),
                pa.array([words for _, words in kept], pa.list_(pa.string())),
            ], names=["block", "slice", "check", "numbers", "words"])

        last = None
        for block, numbers, _ in number_blocks(batches, tokenizer, limit):
            if last is not None and last[0] != block:
                yield finish(*last)
            last = (block, numbers)
        if last is not None:
            yield finish(*last)

    return rows.mapInArrow(deal, WORDS)


def encode_words(words: DataFrame, tokenizer: str, slices: int) -> DataFrame:
    """The word table joined back to its blocks: every distinct word is encoded once, in its slice."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words_of(tokenizer)
        current, known = None, {}
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            for row in batch.to_pylist():
                if row["slice"] != current:
                    current, known = row["slice"], {}
                for word in row["words"]:
                    if word not in known:
                        known[word] = coder.encode(word)
                ids = [known[w] for w in row["words"]]
                packed = np.fromiter(chain.from_iterable(ids), dtype="<u2" if coder.size <= 1 << 16 else "<u4")
                yield entry(row["block"], row["check"], 0, [None], [row["numbers"]], [planes(np.array([len(i) for i in ids]))], [packed.tobytes()])

    return words.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(encode, ENTRIES)


def entry(block: int, check: int, kind: int, doc_ids: list, numbers: list, sizes: list, ids: list) -> pa.RecordBatch:
    n = len(doc_ids)
    return pa.RecordBatch.from_arrays([
        pa.array([block] * n, pa.int64()), pa.array([check] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
        pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.binary()), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary()),
    ], names=["block", "check", "kind", "doc_id", "numbers", "sizes", "ids"])


def number_documents(rows: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """Every document as the numbers of its words, by position."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, numbers, found in number_blocks(batches, tokenizer, limit):
            n = len(found)
            yield entry(block, len(numbers), 1, [d for d, _ in found], [planes(c) for _, c in found], [None] * n, [None] * n)

    return rows.mapInArrow(number, ENTRIES)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start : start + size]`` of every pair, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def batches_of_lists(names: list[str], ids: list, lists: list[np.ndarray], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < len(ids):
        until, size = at, 0
        while until < len(ids) and (until == at or size + len(lists[until]) <= most):
            size += len(lists[until])
            until += 1
        part = lists[at:until]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
        values = pa.array(np.concatenate(part).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at:until], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=names)
        at = until


def encode_documents(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of every row, ids as the tokenizer file encodes the whole text; see :func:`numbered_words`."""
    return numbered_words(docs, tokenizer, block_chars).mapInArrow(assembler(tokenizer), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK) -> DataFrame:
    """(doc_id, ids, decoded): :func:`encode_documents` and :func:`decode_documents` without leaving the task between."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces(tokenizer))
    assemble = assembler(tokenizer)
    both = lambda batches: decoded_batches(assemble(batches), shared.value)
    return numbered_words(docs, tokenizer, block_chars).mapInArrow(both, "doc_id long, ids array<int>, decoded string")


def numbered_words(docs: DataFrame, tokenizer: str, block_chars: int) -> DataFrame:
    """Blocks' dictionaries of ids beside their documents as word numbers, together by block.

    A task reads documents in blocks and numbers the distinct words of each.
    The words travel to their slice of the word table, where each distinct word
    is encoded once, and their ids back to the block; there the documents,
    sent as word numbers by position, take up the ids.  A block's dictionary
    is the most that a task holds; neither side moves texts.

    A null text is empty and has no ids; rows without doc_id and repeated rows
    have a row each; an empty table gives none; other columns are not read.
    """
    slices = partitions(docs.sparkSession)
    rows = reusable(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    rows = rows.withColumn("task", F.spark_partition_id())  # the same in both passes over a table
    table = encode_words(words_of_blocks(rows, tokenizer, slices, block_chars), tokenizer, slices)
    numbered = number_documents(rows, tokenizer, block_chars)
    return table.unionByName(numbered).repartition(slices, "block").sortWithinPartitions("block", "kind")


def assembler(tokenizer: str):
    """The task that puts a block's ids in the places of its documents' word numbers."""
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = words_of(tokenizer).size <= 1 << 16
        current, parts, ready = None, [], None
        for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
            ids, lists = [], []
            for row in batch.to_pylist():
                if row["block"] != current:
                    current, parts, ready = row["block"], [], None
                if row["kind"] == 0:
                    parts.append((from_planes(row["numbers"]), from_planes(row["sizes"]), np.frombuffer(row["ids"], dtype="<u2" if small else "<u4")))
                    continue
                if ready is None and parts:
                    numbers = np.concatenate([p[0] for p in parts])
                    lengths = np.concatenate([p[1] for p in parts]).astype(np.int64)
                    size, start = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
                    size[numbers] = lengths
                    start[numbers] = np.cumsum(lengths) - lengths
                    ready, parts = (np.concatenate([p[2] for p in parts]), start, size), []
                own = from_planes(row["numbers"])
                if len(own) and (ready is None or row["check"] > len(ready[2])):
                    raise ValueError(f"block {current} has no words for its documents")
                ids.append(row["doc_id"])
                lists.append(ragged(ready[0], ready[1][own], ready[2][own]) if len(own) else np.zeros(0, np.int32))
            yield from batches_of_lists(["doc_id", "ids"], ids, lists)

    return assemble


def pieces(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes, and start and size by id."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    table = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    found = [table.get(i, b"") for i in range(max(table) + 1)]
    size = np.array([len(p) for p in found], dtype=np.int64)
    return np.frombuffer(b"".join(found), dtype=np.uint8), np.cumsum(size) - size, size


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded): ids joined to their pieces, which are dense in id and bounded by the vocabulary.

    Bytes that are no UTF-8 become U+FFFD; no ids give an empty text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer))
    return encoded.mapInArrow(lambda batches: decoded_batches(batches, shared.value), "doc_id long, ids array<int>, decoded string")


def decoded_batches(batches: Iterator[pa.RecordBatch], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Join ids to pieces and read the pieces of a document as UTF-8."""
    flat, start, size = table
    for batch in batches:
        lists = batch.column("ids")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        texts = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = values[a:b]
            texts.append(ragged(flat, start[own], size[own]).tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and checksums of ids and decoded text."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
