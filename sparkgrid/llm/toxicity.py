"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

The kernel compares two strings by the subsequences of three characters they
share, each weighted by ``DECAY`` per character it skips, within ``SPAN``
characters.  ``id.iot`` or ``idxiot`` therefore still look like ``idiot``.  Each
landmark's explicit subsequence vector is small, so the trained decision
function is folded into one weight per subsequence and scores whole texts by
table look-ups over arrays of character codes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm.tables import pieces, text_of, texts_of

DECAY = 0.6
SPAN = 6
#: (second, third) character offsets of a subsequence that starts at 0
STEPS = list(combinations(range(1, SPAN), 2))
#: character classes: 0 is no character to match, 1-26 are a-z, others share 19, then a word's start and end
CODES = 48
START, END = 46, 47
#: ASCII marks around a word
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GAP = SPAN  # separators between words, so that no subsequence spans two of them
THRESHOLD = 0.7


def _code_table() -> np.ndarray:
    """Class of every code point: case is folded, marks and white space are 0."""
    table = (27 + np.arange(0x110000) % 19).astype(np.uint8)
    for cp in range(0x250):
        low = chr(cp).lower()[0]
        table[cp] = 0 if not low.isalnum() else 1 + ord(low) - ord("a") if "a" <= low <= "z" else 27 + ord(low) % 19
    table[1], table[2] = START, END
    return table


class Coder:
    """Texts as one array of character codes, words kept apart."""

    #: letters set apart by single separators are read as one word: i d i o t
    spelled = re.compile(r"(?<![^\s])([^\W\d_])[\s.*_-](?=[^\W\d_](?![^\W\d_]))")

    def __init__(self) -> None:
        self.table = _code_table()

    def words(self, text: str) -> list[str]:
        """The words of a text without the marks around them, letters spelled apart joined."""
        return [w for w in (v.strip(MARKS) for v in self.spelled.sub(r"\1", text).split()) if w]

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words, their ends marked, and the index at which each word starts."""
        between = "\2" + "\0" * GAP + "\1"
        joined = "\1" + between.join(words) + between
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths + GAP + 2) - (lengths + GAP + 2)
        return self.table[points[:-1]], starts


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Index of the subsequence at every place, for each gap pattern, with its weight.

    Subsequences with a character of class 0 get index 0, whose weight is zero.
    """
    wide = np.concatenate([codes, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    n = len(codes)
    for a, b in STEPS:
        first, second, third = wide[:n], wide[a : a + n], wide[b : b + n]
        index = (first * CODES + second) * CODES + third
        index[(first == 0) | (second == 0) | (third == 0)] = 0
        yield index, DECAY ** (b - 2)


def against(coder: Coder, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Inner products of the words' subsequence vectors with each row of ``weights``.

    A word's vector is divided by the root of its summed squared weights.
    """
    codes, starts = coder.codes(words)
    total = np.zeros((len(weights), len(codes)), dtype=np.float32)
    squares = np.zeros(len(codes), dtype=np.float32)
    for index, weight in subsequences(codes):
        total += np.float32(weight) * weights[:, index]
        squares += np.float32(weight * weight) * (index > 0)
    size = np.sqrt(np.maximum(np.add.reduceat(squares, starts), 1e-6))
    return (np.add.reduceat(total, starts, axis=1) / size).T


def explicit(coder: Coder, words: list[str]) -> np.ndarray:
    """Subsequence vectors of a few words, one row each."""
    rows = np.zeros((len(words), CODES**3), dtype=np.float32)
    for row, word in zip(rows, words, strict=True):
        codes, _ = coder.codes([word])
        squares = 0.0
        for index, weight in subsequences(codes):
            np.add.at(row, index, weight)
            squares += weight * weight * (index > 0).sum()
        row[0] = 0
        row /= np.sqrt(max(squares, 1e-6))
    return rows


@dataclass
class Model:
    """One weight per subsequence, the SVM's intercept, and the calibration."""

    weights: np.ndarray
    intercept: float
    calibration: tuple[float, float, float]

    def margins(self, coder: Coder, words: list[str]) -> np.ndarray:
        """SVM decision of each word, in blocks."""
        blocks = [against(coder, words[i : i + 20_000], self.weights[None])[:, 0] for i in range(0, len(words), 20_000)]
        return np.concatenate(blocks) + self.intercept if blocks else np.zeros(0)

    def features(self, coder: Coder, texts: list[str]) -> np.ndarray:
        """The two highest word decisions of each text (the lowest value where there is none)."""
        per_text = [coder.words(t) for t in texts]
        flat = [w for words in per_text for w in words]
        margins = np.clip(self.margins(coder, flat), -1, 1)
        out, at = np.full((len(texts), 2), -1.0), 0
        for i, words in enumerate(per_text):
            if words:
                own = margins[at : at + len(words)]
                top = np.partition(own, -2)[-2:] if len(own) > 1 else own
                out[i, 2 - len(top):] = top
                out[i] = np.sort(out[i])
                at += len(words)
        return out

    def scores(self, coder: Coder, texts: list[str]) -> np.ndarray:
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(self.features(coder, texts) @ [a, b] + c, -30, 30)))


def descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hinge: bool, ridge: float, steps: int = 400) -> np.ndarray:
    """Linear model (intercept last) by accelerated gradient steps on squared hinge or log loss."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    sign = np.where(y > 0, 1.0, -1.0)
    weight = weight / weight.sum()
    curve = np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] * (2.0 if hinge else 0.25) + ridge
    w = np.zeros(x1.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        m = sign * (x1 @ ahead)
        pull = 2 * np.maximum(0, 1 - m) if hinge else 1 / (1 + np.exp(np.clip(m, -30, 30)))
        step = -(x1.T @ (weight * sign * pull)) + ridge * np.append(ahead[:-1], 0)
        new = ahead - step / curve
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w


def diverse(coder: Coder, words: list[str], limit: int, alike: float = 0.8) -> list[str]:
    """The first ``limit`` words whose kernel with every earlier pick is below ``alike``."""
    scratch, picked = np.zeros(CODES**3, np.float32), []
    for word in words:
        own = explicit(coder, [word])[0]
        at = np.flatnonzero(own)
        values = own[at] / max(1e-6, float(np.linalg.norm(own)))
        scratch[at] = values
        if all(scratch[i] @ v < alike for _, i, v in picked):
            picked.append((word, at, values))
        scratch[at] = 0
        if len(picked) == limit:
            break
    return [w for w, _, _ in picked]


def by_count(words: dict[str, int]) -> list[str]:
    return sorted(words, key=lambda w: (-words[w], w))


def telling(seen: Counter, rate: float) -> int:
    """Least number of texts so that, by chance, under 0.1 words this frequent occur in toxic texts alone."""
    sizes = Counter(seen.values())
    for n in range(2, max(sizes) + 1):
        if sum(k * rate**m for m, k in sizes.items() if m >= n) < 0.1:
            return n
    return max(sizes) + 1


def train(texts: list[str], labels: list[int], landmarks: int = 160, negatives: int = 3000, rounds: int = 6) -> Model:
    """Train on labelled texts whose toxic sentences are not marked.

    A text is a bag of words (spelled-out words joined).  First, words seen in
    several toxic texts and in no clean one label the sentences they stand in;
    then the SVM relabels: the words of toxic texts that it accepts are the
    positives of the next round, and words it rejects cease to be.  Words of clean texts are negatives, the
    hardest of them first.  A quarter of each class is kept for the calibration.
    Without both classes, or with too few texts for any word to tell, the model
    answers the base rate.
    """
    coder = Coder()
    y = np.array(labels, dtype=int)
    rate = float(np.clip(y.mean() if len(y) else 0, 1e-3, 1 - 1e-3))
    dull = Model(np.zeros(CODES**3, np.float32), -1.0, (0.0, 0.0, float(np.log(rate / (1 - rate)))))
    fit = np.ones(len(y), dtype=bool)
    for label in (0, 1):  # of both classes alike
        fit[np.flatnonzero(y == label)[::4]] = False
    if not (y[fit].any() and (y[fit] == 0).any()):
        return dull
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for text, label, used in zip(texts, y, fit, strict=True):
        if used:
            (toxic if label else clean).update({w.lower() for w in coder.words(text)})
    only = {w: n for w, n in toxic.items() if w not in clean and len(w) > 2}
    least = telling(toxic + clean, float(y[fit].mean()))
    seeds = by_count({w: n for w, n in only.items() if n >= least})
    if not seeds:
        return dull
    plain = by_count(clean)
    half = negatives // 2
    usual = plain[:half] + plain[half :: max(1, len(plain) // half)]
    hard: list[str] = []
    for _ in range(rounds):
        negative = list(dict.fromkeys(hard + usual))
        spots = diverse(coder, seeds, landmarks * 3 // 4) + negative[:: max(1, len(negative) * 4 // landmarks)]
        basis = explicit(coder, spots)
        values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
        keep = values > 1e-4 * values[-1]
        whiten = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem: K(x, landmarks) -> features
        words = seeds + negative
        kernel = np.vstack([against(coder, words[i : i + 512], basis) for i in range(0, len(words), 512)])
        target = np.r_[np.ones(len(seeds)), np.zeros(len(negative))]
        weight = np.r_[[toxic[v] for v in seeds], np.full(len(negative), sum(toxic[v] for v in seeds) / len(negative))]
        w = descend(kernel @ whiten, target, weight, hinge=True, ridge=1e-5, steps=800)
        share = whiten @ w[:-1]
        # in parts, as NumPy makes a copy in 64 bits; and the basis goes before the next round has its own
        folded = np.concatenate([basis[:, i : i + CODES**2].T @ share for i in range(0, CODES**3, CODES**2)])
        folded[0], basis = 0, None
        model = Model(folded.astype(np.float32), float(w[-1]), dull.calibration)
        names = by_count(only)
        margins = dict(zip(names, model.margins(coder, names), strict=True))
        known = set(seeds)
        kept = by_count({w: only[w] for w, m in margins.items() if m > (0.3 if w in known else 0.5) and only[w] > 1})
        seeds = kept or seeds
        order = np.argsort(-model.margins(coder, plain))
        hard = list(dict.fromkeys([*hard, *(plain[i] for i in order[:half])]))
    held = [t for t, f in zip(texts, fit, strict=True) if not f]
    x = model.features(coder, held)
    even = np.ones(len(x))
    line = descend(x, y[~fit], even, hinge=False, ridge=1e-6, steps=3000)
    if line[:2].min() < 0:  # a score must not fall as a decision rises
        one = descend(x.mean(axis=1, keepdims=True), y[~fit], even, hinge=False, ridge=1e-6, steps=3000)
        line = np.array([one[0] / 2, one[0] / 2, one[1]])
    model.calibration = (float(line[0]), float(line[1]), float(line[2]))
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = 3000) -> Model:
    """Train on the ``rows`` labelled documents with the smallest doc_id hash.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are used.  Null labels
    and null ids are left out; a repeated label counts once.
    """
    usable = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = (
        docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(usable), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy("doc_id").toPandas()
    )
    return train(found["text"].tolist(), found["toxic"].tolist())


def score_documents(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (doc_id) of every row with ``score`` of its whole text.

    A null or empty text has the score of a text without toxic words.  Labels,
    lang, source and doc_id are not read.  Rows stay rows, repeated or not.
    """
    return score_rows(docs, model, carry or ["doc_id"]).select("row.*", "score")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below ``THRESHOLD``, with all their columns."""
    return score_rows(docs, model, docs.columns).filter(F.col("score") < THRESHOLD).select("row.*")


def score_rows(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``row``, a struct of the ``carry`` columns, and ``score``; a carried text is sent once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one bounded weight table
    kept = [docs[f"`{c}`"] for c in carry]
    own = [] if "text" in carry else [text_of(docs).alias("text")]
    rows = docs.select(F.struct(*kept).alias("row"), *own)
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, found = Coder(), shared.value
        for batch in (b for whole in batches for b in pieces(whole)):
            texts = texts_of(batch)
            scores = np.concatenate([found.scores(coder, texts[i : i + 64]) for i in range(0, len(texts), 64)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], names=["row", "score"])

    return rows.mapInArrow(score, schema)
