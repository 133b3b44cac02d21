"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited in order of their bounds."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import attach, finite, settle
from sparkgrid.llm.bpe import ragged

#: vectors that the codebooks are fitted on, those with the smallest hash
SAMPLE = 20_000
#: distinct vectors that a cell should hold, and codewords of a half at most
PER_CELL, MOST_WORDS = 256, 1024
#: distinct vectors in a slice of a cell, the unit that queries are scored against
SLICE = 1024
#: distinct vectors that the first round of a search looks at
FIRST_LOOK = 1024
#: queries that a task sends to a cell together
TOGETHER = 256
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
EVERYTHING = 1 << 62


@dataclass
class Index:
    """Codebooks and what is known of the cells; its size is bounded by ``MOST_WORDS`` squared."""

    words: tuple[np.ndarray, np.ndarray]  # codewords of either half
    radii: tuple[np.ndarray, np.ndarray]  # largest distance of a half vector from its codeword
    sizes: np.ndarray  # distinct vectors of each cell
    slices: DataFrame | None = None

    def bounds(self, vector: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bounds of the score's two halves over the members of every codeword."""
        upper, lower = [], []
        for half, words, radii in zip(np.split(vector, [self.words[0].shape[1]]), self.words, self.radii, strict=True):
            middle, reach = words @ half, radii * np.linalg.norm(half) * (1 + 1e-9) + 1e-3
            upper.append(middle + reach)
            lower.append(middle - reach)
        return upper, lower

    def visit(self, vector: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of all cells, highest upper bound first: a multi-sequence heap."""
        upper, lower = self.bounds(vector)
        orders = [np.argsort(-u, kind="stable") for u in upper]
        ranked = [u[o].tolist() for u, o in zip(upper, orders, strict=True)]
        rows, columns = map(len, ranked)
        heap, seen = [(-(ranked[0][0] + ranked[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            i, j = int(orders[0][a]), int(orders[1][b])
            yield -bound, float(lower[0][i] + lower[1][j]), i * columns + j
            for x, y in ((a + 1, b), (a, b + 1)):
                if x < rows and y < columns and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(ranked[0][x] + ranked[1][y]), x, y))


def vectors_of(data: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), dtype="<i4").reshape(-1, width)


def quantize(rows: DataFrame, scale: int = 256) -> tuple[DataFrame, int]:
    """(vec_id, label, vec): whole-number vectors as packed 32-bit integers, and their width.

    Rows with a null id, label or vector, or any null or non-finite
    component, take no part.  Shorter vectors are filled up with zeros.
    """
    usable = rows.select(
        rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("int").alias("label"), rows["embedding"].cast("array<double>").alias("embedding"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: finite(x)))
    width = max(2, usable.agg(F.max(F.size("embedding"))).first()[0] or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.iinfo(np.int32)
        for batch in batches:
            lists = batch.column("embedding")
            lengths = lists.value_lengths().to_numpy()
            flat = np.clip(np.floor(lists.flatten().to_numpy() * scale), limits.min, limits.max)
            whole = np.zeros((len(lengths), width), dtype="<i4")
            places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            whole[np.repeat(np.arange(len(lengths)), lengths), places] = flat
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in whole], pa.binary())], names=["vec_id", "label", "vec"])

    return usable.mapInArrow(pack, "vec_id long, label int, vec binary"), width


def codebook(half: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's codewords of the sampled half vectors."""
    distinct = np.unique(half, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds):
        own = nearest(half, words)[0]
        sums, n = np.zeros_like(words), np.bincount(own, minlength=len(words))
        np.add.at(sums, own, half)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def nearest(half: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.argmin((words**2).sum(axis=1) - 2 * (half @ words.T), axis=1)
    return own, np.linalg.norm(half - words[own], axis=1)


def build_index(items: DataFrame, width: int) -> Index:
    """Fit codebooks on at most ``SAMPLE`` vectors and put every distinct vector into its cell.

    Cells are stored in slices of about ``SLICE`` vectors by the hash of the
    vector, so a cell that holds a large part of the table is many rows.
    """
    spark, left = items.sparkSession, width // 2
    n = items.count()
    k = int(min(MOST_WORDS, max(1, np.ceil(np.sqrt(n / PER_CELL)))))
    sample = items.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    halves = np.split(vectors_of([r.vec for r in sample], width).astype(float), [left], axis=1)
    words = tuple(codebook(half, k) for half in halves)
    columns = len(words[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = np.split(vectors_of(batch.column("vec").to_pylist(), width).astype(float), [left], axis=1)
                (i, r0), (j, r1) = (nearest(half, w) for half, w in zip(both, words, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(i.astype(np.int32) * columns + j.astype(np.int32)), pa.array(r0), pa.array(r1)],
                    names=["vec", "label", "ids", "cell", "r0", "r1"])

    placed = settle(items.select("vec", "label", "ids").mapInArrow(place, "vec binary, label int, ids array<long>, cell int, r0 double, r1 double"))
    sizes, radii = np.zeros(len(words[0]) * columns, np.int64), tuple(np.zeros(len(w)) for w in words)
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1")).collect():
        sizes[row.cell] = row.n
        for radius, at, r in zip(radii, divmod(row.cell, columns), (row.r0, row.r1), strict=True):
            radius[at] = max(radius[at], r)
    known = spark.createDataFrame([(int(c), int(-(-sizes[c] // SLICE))) for c in np.flatnonzero(sizes)], "cell int, n_slices int")
    cut = placed.join(F.broadcast(known), "cell").withColumn("slice", F.pmod(F.xxhash64("vec", "label"), F.col("n_slices")).cast("int"))
    slices = cut.groupBy("cell", "slice").agg(F.collect_list(F.struct("vec", "label", "ids")).alias("members"))
    return Index(words, radii, sizes, settle(slices))


def send(index: Index, state: DataFrame, width: int, first: bool) -> DataFrame:
    """Which slices each query is scored against: (cell, slice, queries) with the queries packed.

    The first round visits cells in order until they hold ``FIRST_LOOK``
    vectors.  The second goes on from there to the last cell whose upper bound
    reaches the lowest score that any window still needs.  Cells whose lower
    bound is above all windows are passed over.
    """
    bare = Index(index.words, index.radii, index.sizes)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            rows = batch.to_pylist()
            going: dict[int, list[int]] = defaultdict(list)
            for at, row in enumerate(rows):
                need = min((w["need"] for w in row["windows"]), default=EVERYTHING)
                most = max((w["hi"] for w in row["windows"]), default=-EVERYTHING)
                looked = 0
                for upper, lower, cell in bare.visit(np.frombuffer(row["vec"], dtype="<i4").astype(float)):
                    if upper < need or first and looked >= FIRST_LOOK:
                        break
                    passed = lower > most or not bare.sizes[cell]
                    if not passed and (first or looked >= FIRST_LOOK):
                        going[cell].append(at)
                    looked += 0 if passed else int(bare.sizes[cell])
            out = []
            for cell, members in going.items():
                queries = [{k: rows[at][k] for k in ("q", "label", "vec", "windows")} for at in members]
                out += [{"cell": cell, "slice": s, "queries": queries} for s in range(-(-int(bare.sizes[cell]) // SLICE))]
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_pylist(out[i : i + 16], schema=VISITS)

    return state.mapInArrow(visits, "cell int, slice int, queries array<struct<q: long, label: int, vec: binary, windows: array<struct<w: long, lo: long, hi: long, need: long>>>>")


WINDOW = pa.struct([("w", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("need", pa.int64())])
VISITS = pa.schema([("cell", pa.int32()), ("slice", pa.int32()), ("queries", pa.list_(pa.struct(
    [("q", pa.int64()), ("label", pa.int32()), ("vec", pa.binary()), ("windows", pa.list_(WINDOW))])))])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum stays below 2**53, else in 64-bit integers."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def scored(visits: DataFrame, slices: DataFrame, width: int, same: bool, most: int) -> DataFrame:
    """(q, w, score, id): the ``most`` first rows of every window in each visited slice."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            members, queries = row["members"], row["queries"]
            labels = np.array([m["label"] for m in members])
            counts = np.array([len(m["ids"]) for m in members])
            flat, starts = np.array([i for m in members for i in m["ids"]], dtype=np.int64), np.cumsum(counts) - counts
            windows = [(at, w["w"], w["lo"], w["hi"], w["need"]) for at, q in enumerate(queries) for w in q["windows"]]
            if not windows:
                continue
            of, w, lo, hi, need = np.array(windows, dtype=np.int64).T
            scores = products(vectors_of([q["vec"] for q in queries], width), vectors_of([m["vec"] for m in members], width))[of]
            alike = np.array([q["label"] for q in queries])[of][:, None] == labels[None, :]
            allowed = (alike == same) & (scores >= np.maximum(lo, need)[:, None]) & (scores <= hi[:, None])
            if len(labels) > most:
                best = np.partition(np.where(allowed, scores, -EVERYTHING), -most, axis=1)[:, -most]
                allowed &= scores >= best[:, None]
            r, c = np.nonzero(allowed)
            n = counts[c]
            r, score, ids = np.repeat(r, n), np.repeat(scores[r, c], n), ragged(flat, starts[c], n)
            order = np.lexsort((ids, -score, r))
            r, score, ids = r[order], score[order], ids[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < most
            r = r[keep]
            q = np.array([x["q"] for x in queries], dtype=np.int64)[of[r]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, w[r], score[keep], ids[keep])], names=["q", "w", "score", "id"])

    return visits.join(slices.hint("merge"), ["cell", "slice"]).select("queries", "members").mapInArrow(score, "q long, w long, score long, id long")


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def search(index: Index, queries: DataFrame, width: int, same: bool, most: int) -> DataFrame:
    """(q, w, score, id, place): the first ``most`` rows of every window of every query, exact.

    ``queries`` has (q, label, vec, windows); rows of the same label are
    meant, or those of other labels.  The scores found in the first round tell
    which bounds the second has to reach: where a window has ``most`` rows, its
    last score; else its lower end.
    """
    found = settle(first_rows(scored(send(index, queries, width, True), index.slices, width, same, most), most))
    last = found.filter(F.col("place") == most).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
    raised = lambda x: F.struct(x["w"].alias("w"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.coalesce(F.try_element_at("last", x["w"]), x["lo"]).alias("need"))
    later = queries.join(last, "q", "left").withColumn("windows", F.transform("windows", raised)).drop("last")
    more = scored(send(index, later, width, False), index.slices, width, same, most)
    return first_rows(found.drop("place").unionByName(more), most)


def hard_negatives(rows: DataFrame, anchors_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of every anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose ``vec_id`` is divisible by ``anchors_every``; their
    positives are the ``positives`` first other rows of the label, and the
    negatives the first rows of other labels whose score is from ``low`` to
    ``high`` per cent of the positive's.  Higher inner products come first, ties
    by smaller id.  All searches are exact over all rows.

    Equal vectors of a label are one entry of the index with the smallest ids,
    as many as an answer can hold, and anchors that are copies are one query,
    so copies cost nothing; windows are keyed by their positive score.
    Rows with a null id, label or vector or a null or non-finite component
    take no part; repeated rows count once; components are kept to 32 bits and
    scores to 64; an empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    packed, width = quantize(rows)
    packed = settle(packed)
    order = Window.partitionBy("vec", "label").orderBy("vec_id")
    kept = packed.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= positives + 1)
    items = settle(kept.groupBy("vec", "label").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    if items.isEmpty():
        return spark.createDataFrame([], RESULT)
    index = build_index(items, width)
    anchors = packed.filter(F.pmod("vec_id", F.lit(anchors_every)) == 0).select(F.col("vec_id").alias("anchor_id"), "vec", "label").distinct()
    queries = settle(anchors.select("vec", "label").distinct().withColumn("q", F.monotonically_increasing_id()))
    window = lambda w, lo, hi: F.struct(w.cast("long").alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), lo.cast("long").alias("need"))
    whole = F.array(window(F.lit(0), F.lit(-EVERYTHING), F.lit(EVERYTHING)))
    near = settle(search(index, queries.withColumn("windows", whole), width, True, positives + 1))

    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("near"))
    lowest, highest = F.expr(f"({low} * score + 99) div 100"), F.expr(f"{high} * score div 100")
    wanted = near.filter("score >= 0").select("q", "score").distinct()  # no score is in the window of a negative one
    wanted = wanted.select("q", window(F.col("score"), lowest, highest).alias("window"))
    wanted = wanted.groupBy("q").agg(F.collect_list("window").alias("windows"))
    far = search(index, queries.join(wanted, "q"), width, False, negatives)
    found = far.groupBy("q", "w").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("found"))

    named = attach(anchors, queries, ["vec", "label"], settled=True).select("anchor_id", "q")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    pairs = attach(named, lists, ["q"]).select("anchor_id", "q", F.explode(others).alias("p"))
    pairs = pairs.select("anchor_id", "q", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("w"))
    return attach(pairs, found, ["q", "w"]).select("anchor_id", "positive_id", "w", F.explode("found").alias("n")).select(
        "anchor_id", "positive_id", F.col("n.place").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("w").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
