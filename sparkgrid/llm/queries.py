"""The operators as registered queries with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_file

from sparkgrid.llm import alignment, bpe, fingerprints, mixing, negatives, packing, paragraphs, quality, secrets, shards, simhash, tokenfiles, toxicity
from sparkgrid.llm.tables import read

#: byte-level BPE of 50,257 ids
TOKENIZER = tokenizer_file("byte_bpe_50k.json")

#: BPE with byte fallback of 32,000 pieces
PIECES = tokenizer_file("piece_bpe_32k.model")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = dict.fromkeys(range(8), 1.0)
    placed = shards.shard_documents(read(spark, sf_dir), eight, eight | {8: 1.0})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


MIX = mixing.Mix(
    share=0.7, epochs=3, seed=7, domains={"web": 5, "books": 3, "forum": 2},
    langs={"en": 5, "de": 2, "fr": 2, "es": 2}, sources={"src0": 3},
)


@query
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir), MIX)
    return mixed.select(
        "row.doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"),
        F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"),
    )


def mix_sql(mix: mixing.Mix, table: str = "documents") -> str:
    """The mixture of ``table`` in DuckDB's SQL: CTEs that end in ``mixed``."""
    def weight(column: str, weights: dict[str, int]) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
        return f"CASE {column} {cases} ELSE 1 END" if cases else "1"

    levels = ["dom", "lng", "src"]
    weights = [weight(c, w) for c, w in zip(levels, mix.weights(), strict=True)]
    out = f"""
    rows AS (
        SELECT *, CASE coalesce(try_cast(regexp_extract(coalesce(source, '(none)'), '([0-9]{{1,9}})$', 1) AS INT), 0) % 3
                WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forum' END AS dom,
            coalesce(lang, '(none)') AS lng, coalesce(source, '(none)') AS src,
            coalesce(CAST(doc_id AS VARCHAR), '(none)') AS k,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tok
        FROM {table}),
    leaves AS (
        SELECT dom, lng, src, CAST(sum(tok) AS BIGINT) AS tokens,
            CASE WHEN ({weights[0]}) * ({weights[1]}) * ({weights[2]}) > 0
                THEN CAST(sum(tok) AS BIGINT) * {mix.epochs} ELSE 0 END AS cap
        FROM rows GROUP BY dom, lng, src),
    given0 AS (
        SELECT CAST(least(sum(cap), floor(CAST(sum(tokens) AS DOUBLE) * {float(mix.share)})) AS BIGINT) AS given FROM leaves)"""
    for depth in range(3):
        keys, above = ", ".join(levels[: depth + 1]), ", ".join(levels[:depth])
        using = f"JOIN given{depth} USING ({above})" if depth else f"CROSS JOIN given{depth}"
        out += f""",
    nodes{depth} AS (
        SELECT {keys}, cap, greatest({weights[depth]}, 1) AS weight, given AS budget
        FROM (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY {keys}) {using}),
    levels{depth} AS (
        SELECT *, CAST(budget - coalesce(sum(cap) OVER (PARTITION BY {above or '0'} ORDER BY cap / weight, {keys}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (PARTITION BY {above or '0'} ORDER BY cap / weight, {keys}
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM nodes{depth}),
    given{depth + 1} AS (
        SELECT {keys}, least(cap, CAST(floor(weight * max(level) OVER (PARTITION BY {above or '0'}) + 1e-6) AS BIGINT)) AS given
        FROM levels{depth})"""
    return out + f""",
    plan AS (
        SELECT dom, lng, src, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole,
            CASE WHEN tokens > 0 THEN given % tokens ELSE given END AS rest
        FROM leaves JOIN given3 USING (dom, lng, src)),
    placed AS (
        SELECT *, sum(tok) OVER (PARTITION BY dom, lng, src ORDER BY md5('{mix.seed}:' || whole || ':' || k), tok
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM rows JOIN plan USING (dom, lng, src)),
    mixed AS (
        SELECT *, unnest(range(CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch
        FROM placed)"""


ORACLES["op10_mix"] = f"""
WITH {mix_sql(MIX).strip()}
SELECT doc_id, epoch, tok AS tokens, dom AS domain, lng AS lang, src AS source FROM mixed"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    model = toxicity.fit_documents(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
    )


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.scan(read(spark, sf_dir)).select(
        "doc_id", *map(count, base), F.sha2(secrets.written(own), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@query
def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.new_folder(spark)
    manifest = tokenfiles.write_tokens(read(spark, sf_dir), TOKENIZER, folder, end_id=0)
    return tokenfiles.checksums(manifest, folder)


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read(spark, sf_dir), TOKENIZER))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    model = quality.fit_documents(docs, read(spark, sf_dir, "labels"))
    return quality.judge_documents(docs, model)


@query
def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(read(spark, sf_dir))


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir), TOKENIZER, limit=1024, end_id=2)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset",
    )


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_documents(read(spark, sf_dir), TOKENIZER, PIECES, digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return negatives.hard_negatives(rows.withColumn("label", moved), anchors_every=50, positives=5, negatives=3, low=50, high=95)


ORACLES["op12_negatives"] = """
WITH items AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, i.vec_id AS id, a.label = i.label AS same, CAST(list_dot_product(a.v, i.v) AS BIGINT) AS score
    FROM items a, items i WHERE a.vec_id % 50 = 0 AND a.vec_id <> i.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scores n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3"""
