"""Quality rules: counts with fixed thresholds, then a calibrated n-gram classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm.tables import text_of

LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words inside a five-word window found twice
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
THRESHOLD = 0.5
#: hash buckets of characters' and of words' n-grams
CHAR_BUCKETS = 2048
WORD_BUCKETS = 2048
CHAR_SIZES = (1, 2, 3)
WORD_SIZES = (1, 2)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(SYMBOLS)] = True
#: one odd 64-bit constant per byte value, and one to mix places
BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word: its bytes' constants times powers of an odd number, summed."""
    inside = ~SPACE[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.arange(len(raw))
    first = np.zeros(len(raw), dtype=np.int64)
    first[starts] = starts
    place = at - np.maximum.accumulate(first)
    longest = int((ends - starts).max())
    powers = np.cumprod(np.full(longest + 1, MIX, dtype=np.uint64))
    terms = np.where(inside, BYTE[raw] * powers[np.minimum(place, longest)], np.uint64(0))
    hashes = np.add.reduceat(terms, starts)
    return starts, hashes ^ (hashes >> np.uint64(29))


def counts(text: str) -> dict[str, int]:
    """The base counts of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, hashes = word_hashes(raw)
    letters = ~SPACE[raw] & ((raw & 0xC0) != 0x80) if len(raw) else np.zeros(0, bool)
    seen: set[bytes] = set()
    twice = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            twice += line in seen
            seen.add(line)
    repeated = 0
    windows = len(hashes) - WINDOW + 1
    if windows > 1:
        key = np.zeros(windows, dtype=np.uint64)
        for i in range(WINDOW):
            key = key * MIX + hashes[i : i + windows]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        covered = np.zeros(len(hashes) + 1, dtype=np.int64)
        found = np.flatnonzero(times[back] > 1)
        np.add.at(covered, found, 1)
        np.add.at(covered, found + WINDOW, -1)
        repeated = int((np.cumsum(covered)[:-1] > 0).sum())
    return {
        "n_words": len(hashes), "word_chars": int(letters.sum()), "n_symbols": int(SYMBOL[raw].sum()),
        "n_dup_lines": twice, "n_repeat_words": repeated,
    }


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of a whole text, one array per kind and size."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    values = BYTE[raw]
    key = np.zeros(len(raw), dtype=np.uint64)
    for size in range(1, max(CHAR_SIZES) + 1):
        key = key[: len(raw) - size + 1] * MIX + values[size - 1 :] if len(raw) >= size else key[:0]
        if size in CHAR_SIZES:
            yield ((key ^ np.uint64(size)) * MIX >> np.uint64(52)).astype(np.int64) % CHAR_BUCKETS
    _, words = word_hashes(raw)
    for size in WORD_SIZES:
        key = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for i in range(size):
            key = key * MIX + words[i : i + len(key)]
        yield CHAR_BUCKETS + ((key ^ np.uint64(size)) * MIX >> np.uint64(52)).astype(np.int64) % WORD_BUCKETS


def features(text: str) -> np.ndarray:
    """Root of each bucket's share, per kind and size, so that length does not matter."""
    out = np.zeros(CHAR_BUCKETS + WORD_BUCKETS, dtype=np.float32)
    for buckets in grams(text):
        if len(buckets):
            out += np.sqrt(np.bincount(buckets, minlength=len(out)) / len(buckets), dtype=np.float32)
    return out


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (x @ self.weights + self.intercept) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; the intercept is not shrunk."""
    mean = x.mean(axis=0)
    centred = x - mean
    curve = 0.25 * float(np.einsum("ij,ij->i", centred, centred).max()) + 0.25 + ridge
    w, b = np.zeros(x.shape[1]), 0.0
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(centred @ ahead.astype(x.dtype) + ahead_b, -30, 30))) - y
        new, new_b = ahead - (error.astype(x.dtype) @ centred / len(y) + ridge * ahead) / curve, ahead_b - error.mean() / curve
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t1 * (new - w), new_b + (t - 1) / t1 * (new_b - b)
        w, b, t = new, new_b, t1
    return w, float(b - mean @ w)


def train(texts: list[str], labels: list[int], ridge: float = 1e-4, steps: int = 400) -> Model:
    """Fit on four fifths of the texts, calibrate on the rest.

    Calibration fits a slope and an offset to the decision values of texts the
    weights have not seen.  With one class only, every text gets its rate.
    """
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(CHAR_BUCKETS + WORD_BUCKETS), float(np.log(rate / (1 - rate))))
    x = np.stack([features(t) for t in texts])
    fit = np.arange(len(y)) % 5 != 0
    if y[fit].min() == y[fit].max() or y[~fit].min() == y[~fit].max():
        return Model(*logistic(x, y, ridge, steps))
    model = Model(*logistic(x[fit], y[fit], ridge, steps))
    z = (x[~fit] @ model.weights + model.intercept)[:, None]
    slope, offset = logistic(z, y[~fit], 1e-3, 2000)
    model.slope, model.offset = float(max(slope[0], 1e-3)), offset
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = 2500) -> Model:
    """Train on the ``rows`` labelled documents with the smallest doc_id hash.

    Rows whose crc32(doc_id as text) mod 3 is 1 are left for measuring; null
    labels and ids are left out, a repeated label counts once (its largest).
    """
    usable = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = (
        docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(usable), "doc_id")
        .groupBy("doc_id", "quality").agg(F.max("text").alias("text")).orderBy("doc_id").toPandas()
    )
    return train(found["text"].tolist(), found["quality"].tolist())


def judge_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Counts, ``base_failed``, ``probability`` and ``kept`` of every row.

    ``base_failed``: under ``LEAST_WORDS`` words, or over ``MOST_REPEATED`` per
    cent of them in five-word windows found twice.  Such rows are not kept;
    others are if their probability of good quality reaches ``THRESHOLD``.

    A null text is a text without words and fails.  Rows stay rows, repeated
    or without doc_id; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [counts(t) for t in texts]
            columns = [pa.array([b[c] for b in base], pa.int64()) for c in COUNTS]
            scores = [float(found.probability(features(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(scores, pa.float64())], names=["doc_id", *COUNTS, "probability"])

    judged = rows.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= THRESHOLD))
