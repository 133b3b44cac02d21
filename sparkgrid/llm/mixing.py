"""Mixing sources to target weights by budgets on a domain-language-source tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import attach, settle
from sparkgrid.llm.tables import count_words, text_of

LEVELS = ["mix_domain", "mix_lang", "mix_source"]
#: leading hex digits of the order key that name a part of a leaf (4,096 parts)
PART_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Targets of a mixture.

    ``share`` of all available tokens is the budget.  Weights are relative
    among siblings; a name without one weighs 1, a weight of 0 shuts a branch.
    A leaf is read at most ``epochs`` times, each time in an order of its own
    drawn from ``seed``.
    """

    share: float = 1.0
    epochs: int = 3
    seed: int = 7
    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)

    def weights(self) -> list[dict[str, int]]:
        return [self.domains, self.langs, self.sources]


def domain_of(source: Column) -> Column:
    """Domain by the number that ends the source's name, for tables without a domain column."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), F.pmod(number, F.lit(3)) + 1)


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, weight in weights.items():
        out = F.when(name == key, F.lit(weight)).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children: add ``given``.

    Every child wants ``weight x level``; one that has less capacity gets what
    it has, and the level rises so that its siblings take the rest.  Sorted by
    capacity per weight, the level at child i is what is left for it and its
    followers per weight; the highest of these is the one that uses the budget up.
    """
    among = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ranked = among.orderBy((F.col("cap") / F.col("weight")), *LEVELS[: len(parent) + 1])
    level = (
        (F.col(budget) - F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    )
    return (
        nodes.withColumn("level", level)
        .withColumn("given", F.least("cap", F.floor(F.col("weight") * F.max("level").over(among) + 1e-6).cast("long")))
        .drop("level")
    )


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Budgets of the tree's leaves: one row a leaf with its ``tokens`` and ``budget``.

    A child never gets more than its subtree can hold, so a shortage inside a
    subtree first goes to the siblings there; only what the whole subtree lacks
    reaches the siblings of its ancestors.  The tables hold one row per node.
    """
    weights = [weight_of(F.col(c), w) for c, w in zip(LEVELS, mix.weights(), strict=True)]
    positive = (weights[0] > 0) & (weights[1] > 0) & (weights[2] > 0)
    leaves = leaves.withColumn("cap", F.when(positive, F.col("tokens") * mix.epochs).otherwise(F.lit(0)))
    above = leaves.agg(
        F.least(F.sum("cap"), F.floor(F.sum("tokens") * F.lit(float(mix.share))).cast("long")).alias("budget")
    )
    for depth in range(3):
        keys = LEVELS[: depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", F.greatest(weights[depth], F.lit(1)))
        nodes = nodes.join(above, keys[:-1]) if depth else nodes.join(F.broadcast(above))
        above = share_out(nodes, keys[:-1], "budget").select(*keys, F.col("given").alias("budget"))
    return leaves.select(*LEVELS, "tokens").join(above, LEVELS)


def mix_sources(docs: DataFrame, mix: Mix) -> DataFrame:
    """Rows of ``docs`` in the mixture, repeated per epoch, with ``mix_*`` columns.

    Tokens are words.  A leaf with budget b and t tokens gives all its rows
    b // t times and, in one epoch more, the longest prefix of that epoch's
    order with at most b % t tokens.  The order is by the hash of seed, epoch
    and doc_id.  A leaf is never ordered as a whole: hash parts have token
    sums, and only the part in which the prefix ends is ordered inside.

    Null lang, source or doc_id is a value of its own; a null text has no
    tokens; rows without tokens come with whole epochs, and with a prefix that
    ends after them; repeated rows each count; an empty table gives no rows.
    Other columns are kept as they are, whatever their names.
    """
    columns = docs.columns
    none = F.lit("(none)")
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"),
        F.coalesce(docs["doc_id"].cast("string"), none).alias("mix_key"),
        domain_of(F.coalesce(docs["source"], none)).alias("mix_domain"),
        F.coalesce(docs["lang"], none).alias("mix_lang"),
        F.coalesce(docs["source"], none).alias("mix_source"),
        count_words(text_of(docs)).alias("mix_tokens"),
    )
    counted = settle(rows.drop("row"))  # words are counted once for both sums below
    leaves = counted.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    plan = settle(leaf_budgets(settle(leaves), mix).select(
        *LEVELS, whole.alias("mix_whole"), (F.col("budget") - whole * F.col("tokens")).alias("mix_rest"),
    ))

    def ordered(rows: DataFrame, leaf_table: DataFrame) -> DataFrame:
        """Rows with their place in the leaf's last, partly read epoch."""
        order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("mix_whole").cast("string"), F.col("mix_key")).cast("binary"))
        placed = attach(rows, leaf_table, LEVELS, settled=True).withColumn("mix_order", order)
        return placed.withColumn("mix_part", F.substring("mix_order", 1, PART_DIGITS))

    parts = ordered(counted, plan).groupBy(*LEVELS, "mix_part", "mix_rest").agg(F.sum("mix_tokens").alias("size"))
    upto = Window.partitionBy(*LEVELS).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.withColumn("total", F.sum("size").over(upto)).filter(F.col("total") > F.col("mix_rest")).groupBy(*LEVELS).agg(
        F.min("mix_part").alias("mix_end"), F.min(F.col("total")).alias("_total"), F.min_by("size", "mix_part").alias("_size"),
    ).select(*LEVELS, "mix_end", (F.col("_total") - F.col("_size")).alias("mix_before"))
    placed = ordered(rows, settle(plan.join(ends, LEVELS, "left")))

    last = F.coalesce(F.col("mix_end"), F.lit("g"))  # a leaf without an end has no tokens, or all parts fit
    inside = Window.partitionBy(*LEVELS, "mix_part").orderBy("mix_order", "mix_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ending = (
        placed.filter(F.col("mix_part") == last)
        .withColumn("_fits", (F.sum("mix_tokens").over(inside) + F.col("mix_before") <= F.col("mix_rest")) & (F.col("mix_rest") > 0))
        .drop("mix_before", "mix_end")
    )
    others = placed.filter(F.col("mix_part") != last).withColumn(
        "_fits", (F.col("mix_part") < last) & (F.col("mix_rest") > 0)).drop("mix_before", "mix_end")
    copies = F.col("mix_whole") + F.col("_fits").cast("long")
    return (
        others.unionByName(ending).withColumn("_copies", copies).filter("_copies > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select("row", *LEVELS, "mix_tokens", "mix_epoch")
    )
