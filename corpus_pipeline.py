"""A training-corpus pipeline: each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgrid.core import settle
from sparkgrid.llm import bpe, mixing, secrets, simhash, tables, toxicity
from sparkgrid.llm.queries import TOKENIZER

#: targets for the filtered corpus: at most two epochs, so that little is repeated
MIX = mixing.Mix(
    share=1.0, epochs=2, seed=7, domains={"web": 3, "books": 2, "forum": 2},
    langs={"en": 6, "de": 2, "fr": 2, "es": 1},
)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the table, does not call toxic."""
    model = toxicity.fit_documents(docs, tables.read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; those of later epochs are rows once more."""
    return mixing.mix_sources(docs, MIX).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the decoded text's and the ids' checksums."""
    return bpe.digests(bpe.round_trip(docs, TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: the classifier, the fingerprints and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = tables.read(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
