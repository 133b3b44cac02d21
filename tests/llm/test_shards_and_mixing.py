import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkgrid.llm import mixing, shards

EIGHT = dict.fromkeys(range(8), 1.0)


def test_shards_hold_every_row_in_gapless_slots(edges):
    got = shards.shard_documents(edges, EIGHT, EIGHT | {8: 1.0}).collect()
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in edges.select("doc_id", "text").collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(spark):
    ids = spark.range(20_000).select("id", shards.rendezvous(F.col("id"), {0: 1.0, 1: 3.0}).alias("a"),
                                     shards.rendezvous(F.col("id"), {0: 1.0, 1: 3.0, 2: 1.0}).alias("b")).collect()
    assert abs(sum(r.a for r in ids) / 20_000 - 0.75) < 0.02
    moved = [r for r in ids if r.a != r.b]
    assert all(r.b == 2 for r in moved) and abs(len(moved) / 20_000 - 0.2) < 0.02


def test_many_equal_rows_get_slots_of_their_own(spark):
    rows = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    got = shards.shard_documents(rows, EIGHT).collect()
    assert sorted(r.slot for r in got) == list(range(5000)) and len({r.shard for r in got}) == 1


def test_shards_of_nothing_and_written_shards(nothing, edges, tmp_path):
    assert shards.shard_documents(nothing, EIGHT).count() == 0
    name = shards.write_shards(edges, EIGHT, str(tmp_path / "out"))
    back = edges.sparkSession.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and set(back.columns) == {*edges.columns, name}
    assert sorted(map(str, back.select(edges.columns).collect())) == sorted(map(str, edges.collect()))
    want = {(r.doc_id, r.shard) for r in shards.shard_documents(edges, EIGHT).collect()}
    assert {(r.doc_id, r[name]) for r in back.select("doc_id", name).collect()} == want
    assert shards.write_shards(edges.select("doc_id", "text"), EIGHT, str(tmp_path / "plain")) == "shard"


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)],
        "mix_domain string, mix_lang string, mix_source string, tokens long")
    mix = mixing.Mix(share=800 / 3010, epochs=1, seed=1)
    got = {r.mix_source: r.budget for r in mixing.leaf_budgets(leaves, mix).collect()}
    # web and books get 400 each, en and de 200 each; a lacks 90, which its sibling b takes
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}


def test_a_short_subtree_spills_to_its_ancestors_siblings(spark):
    leaves = spark.createDataFrame(
        [("web", "en", "a", 10), ("web", "en", "b", 20), ("web", "de", "c", 1000), ("books", "en", "d", 1000)],
        "mix_domain string, mix_lang string, mix_source string, tokens long")
    got = {r.mix_source: r.budget for r in mixing.leaf_budgets(leaves, mixing.Mix(share=800 / 2030, epochs=1, domains={"books": 0})).collect()}
    assert got == {"a": 10, "b": 20, "c": 770, "d": 0}


def test_mixture_of_edges(edges):
    whole = mixing.mix_sources(edges, mixing.Mix(share=2.0, epochs=2)).collect()
    counts = Counter((r.row.doc_id, r.row.text) for r in whole)
    rows = Counter((d, t) for d, t in edges.select("doc_id", "text").collect() if t and t.strip(" \t\n\x0b\x0c\r"))
    assert all(counts[k] == 2 * n for k, n in rows.items())
    assert {r.mix_epoch for r in whole} == {0, 1}
    assert whole[0].row.part == "p"


def test_prefixes_keep_to_the_budget(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mix = mixing.Mix(share=0.4, epochs=1, seed=3)
    got = mixing.mix_sources(docs, mix).groupBy(*mixing.LEVELS).agg(F.sum("mix_tokens").alias("n"))
    leaves = mixing.mix_sources(docs, mixing.Mix(share=1.0, epochs=1)).groupBy(*mixing.LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    for r in got.join(mixing.leaf_budgets(leaves, mix), mixing.LEVELS).collect():
        assert r.n <= r.budget
    assert mixing.mix_sources(nothing, mix).count() == 0
