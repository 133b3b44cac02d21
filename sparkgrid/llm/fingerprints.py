"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import settle
from sparkgrid.llm.tables import partitions, text_of

#: samples in a fingerprint; the likeness of two is a mean over them
SAMPLES = 64
#: samples drawn from one row of a term; more would make code too long to be compiled
STEP = 4
#: hex digits written per sample
DIGITS = 4
SPACES = " \t\n\x0b\f\r"
SEPARATOR = r"[\x20\x09-\x0D]+"


#: equal shares of the Gamma(2, 1) distribution that draws are taken from; the ``TAIL`` outermost ones, which the
#: smallest values of long texts come from, are cut ``FINE`` times more
QUANTILES, TAIL, FINE = 4096, 16, 256


def gamma_quantiles(share: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Values x at which 1 - (1 + x) exp(-x) is ``share`` and (1 + x) exp(-x) is ``rest``, each exact where it is small."""
    low, high = np.full(len(share), 1e-9), np.full(len(share), 60.0)
    for _ in range(80):
        middle = np.sqrt(low * high)
        small = middle**2 * (1 / 2 - middle * (1 / 3 - middle * (1 / 8 - middle * (1 / 30 - middle / 144))))
        under = np.where(middle < 0.1, small, 1 - (1 + middle) * np.exp(-middle))
        below = np.where(share < 0.5, under < share, (1 + middle) * np.exp(-middle) > rest)
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high


def gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middles of all shares, of the finer shares at the low end and of those at the high end, from the outside inwards."""
    coarse, fine = (np.arange(QUANTILES) + 0.5) / QUANTILES, (np.arange(TAIL * FINE) + 0.5) / (QUANTILES * FINE)
    return gamma_quantiles(coarse, 1 - coarse), gamma_quantiles(fine, 1 - fine), gamma_quantiles(1 - fine, fine)


def table(values: np.ndarray) -> Column:
    """A constant array: the optimizer folds the text into one literal."""
    return F.split(F.lit(",".join(f"{v:.12g}" for v in values)), ",").cast("array<double>")


def sample(term: Column, draw: Column, log_weight: Column, i: int, gamma: list[Column], log_gamma: list[Column]) -> Column:
    """Draw i of a weighted term, packed so that the smallest value of a text is its sample.

    With r and c from Gamma(2, 1), b uniform and t = floor(ln w / r + b), the
    term with the smallest ln c - r (t - b) - r is sampled together with t.
    All draws come from ``draw``, a hash of the term, and i, so texts agree in a sample
    with the probability of their generalised Jaccard similarity.  The value's
    high 31 bits order the draws, the low 32 name (term, t).
    """
    bits = F.xxhash64(draw.bitwiseXOR(F.lit((i + 1) * 0x1E3779B97F4A7C15 % (1 << 62))))
    digit = lambda first, size: F.shiftrightunsigned(bits, first).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")
    outer, inner = digit(0, QUANTILES), digit(12, QUANTILES)
    # a large r and a small c make small values: those ends are drawn finely
    r = F.when(outer >= TAIL, F.get(gamma[0], QUANTILES - 1 - outer)).otherwise(F.get(gamma[1], outer * FINE + digit(32, FINE)))
    log_c = F.when(inner >= TAIL, F.get(log_gamma[0], inner)).otherwise(F.get(log_gamma[1], inner * FINE + digit(24, FINE)))
    b = F.shiftrightunsigned(bits, 40).cast("double") / float(1 << 24)
    t = F.floor(log_weight / r + b)
    order = log_c - r * (t - b) - r
    name = term.bitwiseXOR(t * 40503).bitwiseAND(F.lit((1 << 32) - 1))
    return F.shiftleft(((order + 64.0) * float(1 << 24)).cast("long"), 32).bitwiseOR(name)


def fingerprint_texts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per ``keys`` with the ``fingerprint`` of its text as hex digits.

    Terms are words, weighted by how often they occur; a text without words
    has one empty term.  ``texts`` must be partitioned by the first key: words
    are counted and sampled where their text is, without a shuffle.
    """
    words = F.explode(F.split(F.btrim(F.col(text), F.lit(SPACES)), SEPARATOR))
    counted = texts.select(*keys, words.alias("_word")).select(*keys, F.xxhash64("_word").alias("_term"))
    counted = counted.groupBy(*keys, "_term").agg(F.count("*").alias("_n"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // STEP - 1)))
    weighted = counted.select(*keys, "_term", F.log(F.col("_n").cast("double")).alias("_w"), steps.alias("_step"))
    weighted = weighted.withColumn("_draw", F.xxhash64("_term", "_step"))
    middle, small, large = gamma_tables()
    tables = [table(middle), table(large)], [table(np.log(middle)), table(np.log(small))]
    sampled = weighted.groupBy(*keys, "_step").agg(
        *[F.min(sample(F.col("_term"), F.col("_draw"), F.col("_w"), i, *tables)).alias(f"_{i}") for i in range(STEP)]
    )
    named = [F.xxhash64(F.col(f"_{i}").bitwiseAND(F.lit((1 << 32) - 1))) for i in range(STEP)]
    digits = F.concat(*[F.substring(F.lpad(F.hex(n), 16, "0"), -DIGITS, DIGITS) for n in named])
    parts = F.array_sort(F.collect_list(F.struct("_step", digits.alias("digits"))))
    return sampled.groupBy(*keys).agg(F.lower(F.array_join(F.transform(parts, lambda p: p["digits"]), "")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an estimate of the texts' generalised Jaccard similarity."""
    same = lambda n, i: n + (F.substr(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, i * DIGITS + 1, F.lit(DIGITS))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0), same) / float(SAMPLES)


def in_order(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_chars, copies, next_key): each document with the next by ascending doc_id.

    Only ids move: they are sorted in ranges, and the last of a range takes
    the first of the next range that has rows; after the last comes the first.
    """
    ids = docs.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    ranged = settle(
        ids.repartitionByRange(partitions(docs.sparkSession), "doc_id", "key").withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "key")
    parts = Window.orderBy("part")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "key"))["key"].alias("head")).select(
        "part", F.coalesce(F.lead("head").over(parts), F.first("head").over(parts)).alias("after"))
    return (
        ranged.withColumn("_next", F.lead("key").over(inside)).join(F.broadcast(firsts), "part")
        .select("key", "doc_id", "n_chars", "copies", F.coalesce("_next", "after").alias("next_key"))
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited form, and their likeness.

    The edited form has its last floor(n_chars / 4) characters replaced by the
    first as many (or all) of the next document in ascending doc_id; the next
    of the last is the first.

    A null text is empty; texts without words are alike.  Rows without doc_id
    come first; rows that repeat a doc_id are documents in the order of a hash
    of their text; equal rows are one document and give equal rows.  A single
    document is its own next; an empty table gives no rows; other columns are
    not read.
    """
    wide = 4 * partitions(docs.sparkSession)  # word counts of a part stay in memory
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], F.xxhash64(docs["doc_id"], text).alias("key"), text.alias("text"))
    order = settle(in_order(rows.select("doc_id", "key", F.char_length("text").alias("n_chars"))))
    texts = rows.select("key", "text").repartition(wide, "key").groupBy("key").agg(F.first("text").alias("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    heads = (
        texts.join(order.select(F.col("key").alias("owner"), F.col("next_key").alias("key"), quarter.alias("_quarter")), "key")
        .select(F.col("owner").alias("key"), F.substr("text", F.lit(1), "_quarter").alias("_head"))
        .repartition(wide, "key")
    )
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars") - quarter), "_head")
    met = texts.join(order, "key").join(heads, "key").withColumn("edited", edited)
    forms = F.explode(F.array(
        F.struct(F.lit(0).alias("form"), F.col("text").alias("body")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("body")),
    ))
    bodies = met.select("key", forms.alias("f")).select("key", "f.form", "f.body")
    sums = met.select("key", F.sha2("edited", 256).alias("edited_sha256"))  # from the same shuffles, in the same job
    prints = settle(fingerprint_texts(bodies, ["key", "form"], "body").join(sums, "key"))
    own = prints.filter("form = 0").select("key", "fingerprint")
    changed = prints.filter("form = 1").select("key", "edited_sha256", F.col("fingerprint").alias("edited_fingerprint"))
    following = own.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("_next"))
    return (
        order.join(own, "key").join(changed, "key").join(following, "next_key")
        .select(
            "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
            F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
        ).drop("_copy")
    )
