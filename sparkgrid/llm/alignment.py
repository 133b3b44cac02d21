"""Aligning two tokenizers over the same bytes: divide and conquer at shared cuts."""

from __future__ import annotations

import functools
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import attach, settle
from sparkgrid.llm.bpe import from_planes, pieces, planes, ragged
from sparkgrid.llm.tables import partitions, text_of
from sparkgrid.llm.tokenize import words_of

#: characters after which a task starts a new block of documents
BLOCK = 32_000_000
#: documents that a task handles at a time
FEW = 500
#: segments, and characters of segments, that a worker remembers before it starts afresh
MEMORY, MEMORY_CHARS = 500_000, 16_000_000
#: how piece models write a blank
BLANK = "▁"
ROWS = ("block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "numbers binary, counts binary, number long, pair long, n long")
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def shared_groups(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Cut two token sequences at all their common ends: ranges (a0, a1, b0, b1), in order.

    ``a`` and ``b`` are ascending ends over the same bytes and end alike.  An
    interval is divided at the common end that a walk outward from the middle
    of its ``b`` ends meets first, each looked up among the ``a`` ends by
    bisection; both halves are divided in turn.  An interval without one is a
    group.
    """
    groups: list[tuple[int, int, int, int]] = []
    todo = [(0, len(a), 0, len(b))] if a else []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a1 - a0 > 1 and b1 - b0 > 1:
            k = (b0 + b1 - 2) >> 1
            at = bisect_left(a, b[k], a0, a1)
            if a[at] != b[k]:
                for k in outward(k, b0, b1 - 2):
                    at = bisect_left(a, b[k], a0, a1)
                    if a[at] == b[k]:
                        break
                else:
                    break
            todo.append((at + 1, a1, k + 1, b1))
            a1, b1 = at + 1, k + 1
        groups.append((a0, a1, b0, b1))
    return groups


def outward(middle: int, first: int, last: int) -> Iterator[int]:
    """Places from ``first`` to ``last`` but ``middle``, the nearest to it first."""
    for step in range(1, max(middle - first, last - middle) + 1):
        if middle + step <= last:
            yield middle + step
        if middle - step >= first:
            yield middle - step


class Numbers(dict):
    """Keys to 0, 1, 2 ... as they are asked for."""

    def __missing__(self, key: int) -> int:
        number = self[key] = len(self)
        return number


class Aligner:
    """Two tokenizer files, and what they make of every segment met so far.

    A segment is text between cuts that both tokenizers have whatever stands
    around: ends of words of the byte-level split pattern between two
    characters that no piece of the other model holds side by side, so that
    none can reach across.  Each distinct segment is encoded and aligned once.
    """

    def __init__(self, bytes_file: str, pieces_file: str) -> None:
        self.words = words_of(bytes_file)
        self.size_a = pieces(bytes_file)[2]
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        every = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in every]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in zip(every, names)]
        self.size_b = np.array(list(map(len, self.bytes_b)))
        self.lead = self.model.encode("\n")
        if self.bytes_b[self.lead[-1]] != b"\n" or any("\n" in p for p in names):
            raise ValueError("a piece model without pieces that hold a line end is expected")
        self.classes, self.joined = self.neighbours([p.replace(BLANK, " ") for i, p in zip(every, names) if not self.model.is_byte(i)])
        self.forget()

    @staticmethod
    def neighbours(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class of every code point, and which classes stand side by side in a piece; 0 is any other code point."""
        number = {c: i + 1 for i, c in enumerate(sorted(set("".join(names))))}
        classes = np.zeros(0x110000, dtype=np.uint16)
        classes[[ord(c) for c in number]] = list(number.values())
        joined = np.zeros((len(number) + 1,) * 2, dtype=bool)
        for name in names:
            for x, y in zip(name, name[1:]):
                joined[number[x], number[y]] = True
        return classes, joined

    def units(self, text: str) -> list[int]:
        """Where no piece can reach across, with the text's end."""
        kinds = self.classes[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        return [*(np.flatnonzero(~self.joined[kinds[:-1], kinds[1:]]) + 1).tolist(), len(text)]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs = Numbers()  # a id << 32 | b id -> number
        self.texts: list[str] = []  # segment -> its groups
        self.sizes = array("q")  # segment -> n_a, n_b, n_groups, whether B gives its bytes
        self.flat, self.starts = array("I"), array("q", [0])  # segment -> numbers of its links' pairs
        self.weight = 0

    def full(self) -> bool:
        return len(self.known) > MEMORY or self.weight > MEMORY_CHARS

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Pieces of segments alone: the blank that the model puts before a text stays before a line end."""
        return [ids[len(self.lead) :] for ids in self.model.encode(["\n" + s for s in segments], num_threads=1)]

    def learn(self, segments: list[str]) -> None:
        """Encode and align segments not met before, in one sequence: their ends are cuts like all others."""
        a = [list(chain.from_iterable(map(self.words.encode, self.words.find(s)))) for s in segments]
        b = self.encode_b(segments)
        data = [s.encode() for s in segments]
        same = [b"".join(map(self.bytes_b.__getitem__, own)) == d for own, d in zip(b, data, strict=True)]
        a, b = ([own if ok else [] for own, ok in zip(side, same, strict=True)] for side in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(side), dtype=np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        borders = np.cumsum([len(d) * ok for d, ok in zip(data, same, strict=True)])
        groups = shared_groups(ends_a.tolist(), ends_b.tolist())
        names_a, names_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        written = [
            f"{names_a[a0]}|{names_b[b0]}" if a1 - a0 == 1 == b1 - b0 else f"{','.join(names_a[a0:a1])}|{','.join(names_b[b0:b1])}"
            for a0, a1, b0, b1 in groups
        ]
        until = np.searchsorted(ends_a[[g[1] - 1 for g in groups]], borders, side="right") if groups else np.zeros(len(data), np.int64)
        before = np.concatenate([[0], until[:-1]])
        self.texts += [";".join(written[i:j]) for i, j in zip(before.tolist(), until.tolist(), strict=True)]
        pairs, until_link = self.links(flat_a, flat_b, ends_a, ends_b, borders)
        self.starts.extend((len(self.flat) + until_link).tolist())
        self.flat.extend(map(self.pairs.__getitem__, pairs.tolist()))
        sizes = np.stack([list(map(len, a)), list(map(len, b)), until - before, same], axis=1)
        self.sizes.extend(sizes.ravel().tolist())
        self.known |= zip(segments, range(len(self.known), len(self.known) + len(segments)))
        self.weight += sum(map(len, segments))

    @staticmethod
    def links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id pairs of all links, one for each stretch between ends of either side, and how many end by each border."""
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
        return pairs, np.searchsorted(ends, borders, side="right")

    def segments(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the segments of blank + text, divided at the cuts that words and pieces share."""
        found = [self.cut(" " + text) if text and BLANK not in text else [] for text in texts]
        new = [s for s in dict.fromkeys(chain.from_iterable(found)) if s not in self.known]
        if new:
            self.learn(new)
        return [list(map(self.known.__getitem__, own)) for own in found]

    def cut(self, text: str) -> list[str]:
        ends = list(accumulate(map(len, self.words.find(text))))
        cuts = [ends[group[1] - 1] for group in shared_groups(ends, self.units(text))]
        return [text[i:j] for i, j in zip([0, *cuts], cuts)]


@functools.cache
def aligner(bytes_file: str, pieces_file: str) -> Aligner:
    """One instance per worker process and pair of files, which every task must be able to read."""
    return Aligner(bytes_file, pieces_file)


def align_blocks(docs: DataFrame, bytes_file: str, pieces_file: str, digest: bool = False, block_chars: int = BLOCK) -> DataFrame:
    """Blocks of documents (kind 1) with the id pairs that they link (kind 0).

    A document has its counts, its groups as text or as the SHA-256 of that,
    and the numbers of its pairs with how often it links each.  A pair row has
    the number of the pair in its block and how often the block links it.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    kinds = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                       ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("numbers", pa.binary()),
                       ("counts", pa.binary()), ("number", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])

    def batch_of(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(bytes_file, pieces_file)
        task, at, chars, totals = TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int64)

        def finish() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(totals)
            pairs = np.fromiter(own.pairs, dtype=np.int64, count=len(own.pairs))
            for part in np.array_split(used, len(used) // 50_000 + 1):
                yield batch_of(len(part), block=np.full(len(part), task << 20 | at), kind=np.zeros(len(part), np.int32),
                               number=part, pair=pairs[part], n=totals[part])

        for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
            if chars > block_chars or own.full():
                yield from finish()
                at, chars, totals = at + 1, 0, np.zeros(0, np.int64)
                if own.full():
                    own.forget()
            texts = batch.column("text").to_pylist()
            found = own.segments(texts)
            chars += sum(map(len, texts))
            sizes = np.array(own.sizes, dtype=np.int64).reshape(-1, 4)
            found = [f if sizes[f, 3].all() else [] for f in found] if not sizes[:, 3].all() else found
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(offsets[-1]))
            sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(sizes[flat, :3], axis=0)])
            n_a, n_b, n_groups = (sums[offsets[1:]] - sums[offsets[:-1]]).T
            starts = np.array(own.starts, dtype=np.int64)
            lengths = (starts[1:] - starts[:-1])[flat]
            pair = ragged(np.array(own.flat, dtype=np.int64), starts[flat], lengths)
            of = np.repeat(np.repeat(np.arange(len(found)), np.diff(offsets)), lengths)
            keys, counts = np.unique(of << 32 | pair, return_counts=True)
            numbers, cuts = keys & 0xFFFFFFFF, np.searchsorted(keys >> 32, np.arange(len(found) + 1))
            totals = np.pad(totals, (0, len(own.pairs) - len(totals)))
            np.add.at(totals, numbers, counts)
            groups = [";".join(map(own.texts.__getitem__, f)) for f in found]
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield batch_of(
                len(found), block=np.full(len(found), task << 20 | at), kind=np.ones(len(found), np.int32), doc_id=batch.column("doc_id"),
                n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_a + n_b - n_groups, groups=groups,
                numbers=[planes(numbers[i:j]) for i, j in spans], counts=[planes(counts[i:j]) for i, j in spans])
        yield from finish()

    return rows.mapInArrow(align, ROWS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count, best): how many links hold an id pair, and whether no other A id is linked oftener to its B id."""
    totals = settle(blocks.filter("kind = 0").groupBy("pair").agg(F.sum("n").alias("count")).select(
        "pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "count"))
    highest = totals.groupBy("b_id").agg(F.max("count").alias("highest"))
    return attach(totals, highest, ["b_id"]).select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, bytes_file: str, pieces_file: str, digest: bool = False, block_chars: int = BLOCK) -> DataFrame:
    """One row per document: tokens, groups and links of both tokenizers, and the corpus-wide counts of its links.

    Text is read with a blank before it, which the piece model adds itself.
    ``groups`` is written ``a1,a2|b1;a3|b2,b3``, or is the SHA-256 of that.
    ``count_sum`` adds the corpus-wide counts of the document's links,
    ``n_best`` counts the links whose count is the highest of their B id.

    Blocks of documents number their id pairs, so pairs are counted and
    joined once a block: no token is a row, and no frequent pair a hot key.
    A null or empty text, and one that the pieces do not spell (it holds
    U+2581), has no tokens: zeros and an empty ``groups``; rows without doc_id
    and repeated rows have a row each; an empty table gives none; other
    columns are not read.
    """
    blocks = settle(align_blocks(docs, bytes_file, pieces_file, digest, block_chars))
    counts = pair_counts(blocks).select("pair", "count", F.col("best").cast("long").alias("best"))
    pairs = attach(blocks.filter("kind = 0").select("block", "kind", "number", "pair"), counts, ["pair"])
    own = blocks.filter("kind = 1").drop("pair", "n", "number")
    both = own.unionByName(pairs.drop("pair"), allowMissingColumns=True)
    ordered = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table = None, [], np.zeros((0, 2), np.int64)
        for batch in batches:
            ids, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(ids, prepend=-1) | np.diff(kind, prepend=-1)) if len(ids) else []
            for i, j in zip(edges, [*edges[1:], len(ids)], strict=True):
                part = batch.slice(i, j - i)
                if ids[i] != block:
                    block, parts, table = ids[i], [], np.zeros((0, 2), np.int64)
                if kind[i] == 0:
                    parts.append(np.stack([part.column(c).to_numpy() for c in ("number", "count", "best")], axis=1))
                    continue
                if parts:
                    rows = np.concatenate(parts)
                    table, parts = np.zeros((rows[:, 0].max() + 1, 2), np.int64), []
                    table[rows[:, 0]] = rows[:, 1:]
                sums = [from_planes(n.as_py()) for n in part.column("numbers")]
                sums = [from_planes(c.as_py()).astype(np.int64) @ table[n] for n, c in zip(sums, part.column("counts"), strict=True)]
                count, best = np.array(sums, dtype=np.int64).reshape(-1, 2).T
                columns = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best), pa.array(count), part.column("groups")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return ordered.mapInArrow(total, OUT)
