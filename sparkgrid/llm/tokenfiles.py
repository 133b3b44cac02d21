"""Token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgrid.core import ensure_checkpoint_dir, settle
from sparkgrid.llm.tables import partitions, text_of
from sparkgrid.llm.tokenize import encoder

#: documents that a task encodes at a time
FEW = 500
MANIFEST = "part int, id_bytes int, docs long, nulls long, tokens long"


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI; local files are memory-mapped."""
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return (pafs.LocalFileSystem(use_mmap=True) if fs.type_name == "local" else fs), path


def stem(path: str, part: int) -> str:
    return f"{path}/part-{part:06d}"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; return the manifest.

    Part p has three files: ``.tokens``, the ids as little-endian unsigned
    integers of ``id_bytes``; ``.offsets``, unsigned 64-bit places at which each
    document starts, with the end; ``.docs``, the doc_ids as 64-bit integers.
    ``end_id`` follows each document.  Parts are ranges of doc_id, so part order
    is document order; ties go by the text's hash.

    A null text is an empty document; rows without doc_id come first, the
    manifest's ``nulls`` of the first part(s); repeated rows are documents each;
    an empty table has an empty manifest.  Tasks write under a name of their
    own and rename, so a repeated task leaves the same files.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        name, own = stem(path, task.partitionId()), f".{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        coder = encoder(tokenizer)
        width = coder.width
        end = b"" if end_id is None else np.array([end_id], dtype=width).tobytes()
        ids, sizes = [], []
        with fs.open_output_stream(f"{name}.tokens{own}") as out:
            for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
                for encoded in coder.encode_all(batch.column("text").to_pylist()):
                    packed = encoded + end
                    out.write(packed)
                    sizes.append(len(packed) // width.itemsize)
                ids.append(batch.column("doc_id"))
        column = pa.concat_arrays([pa.array([], pa.int64()), *ids])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        for kind, data in (("offsets", offsets), ("docs", column.fill_null(0).to_numpy().astype("<i8"))):
            with fs.open_output_stream(f"{name}.{kind}{own}") as out:
                out.write(data.tobytes())
        for kind in ("tokens", "offsets", "docs"):
            fs.move(f"{name}.{kind}{own}", f"{name}.{kind}")
        row = [task.partitionId(), width.itemsize, len(sizes), column.null_count, int(offsets[-1])]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "id_bytes", "docs", "nulls", "tokens"])

    return settle(ordered.mapInArrow(write, MANIFEST)).filter("docs > 0")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Add ``base``: ids in all parts before, a prefix sum over one row a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files.

    ``start`` counts the ids of all documents before.  Parts are mapped into
    memory and copied out a few documents at a time.
    """
    parts = with_bases(manifest).repartition(partitions(manifest.sparkSession), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            files = [fs.open_input_file(f"{stem(path, row['part'])}.{kind}") for kind in ("tokens", "offsets", "docs")]
            kinds = [f"<u{row['id_bytes']}", "<u8", "<i8"]
            tokens, offsets, docs = (np.frombuffer(f.read_buffer(), dtype=k) for f, k in zip(files, kinds, strict=True))
            at = 0
            while at < len(docs):
                until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 1_000_000)) - 1)
                first, last = int(offsets[at]), int(offsets[until])
                lists = pa.LargeListArray.from_arrays(
                    pa.array((offsets[at : until + 1] - offsets[at]).astype(np.int64)), pa.array(tokens[first:last].astype(np.int32)))
                ids = pa.array(docs[at:until].astype(np.int64), mask=np.arange(at, until) < row["nulls"])
                starts = pa.array(offsets[at:until].astype(np.int64) + row["base"])
                yield pa.RecordBatch.from_arrays([ids, starts, lists.cast(pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])
                at = until

    return parts.mapInArrow(read, "doc_id long, start long, ids array<int>")


def checksums(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(manifest, folder).mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
