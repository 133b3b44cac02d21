import random
import tracemalloc

from pyspark.sql import functions as F

import corpus_pipeline
from sparkgrid.llm import bpe, mixing, secrets, simhash, tables, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table with enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mix", "bpe"]
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4] > 0


def test_stages_take_edges_and_nothing(spark, edges, nothing, monkeypatch):
    monkeypatch.setattr(toxicity, "fit_documents", lambda docs, labels: toxicity.train([], []))
    for table in (edges, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0


def test_run_equals_stage_by_stage(spark):
    """The pipeline's rows against the operators' own results, stage by stage."""
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.toPandas()
    rows = rows[model.scores(toxicity.Coder(), rows.text.tolist()) < toxicity.THRESHOLD]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows)).collect()}
    rows = rows[[groups[d] == d for d in rows.doc_id]].copy()
    for i, text in zip(rows.index, rows.text, strict=True):
        spans = sorted(s for r in secrets.RULES for s in secrets.matches(r, __import__("re").compile(r.pattern), text))
        rows.loc[i, "text"] = secrets.replaced(text, spans, "[secret]")
    mixed = mixing.mix_sources(spark.createDataFrame(rows), corpus_pipeline.MIX).select("row.*")
    want = bpe.digests(bpe.decode_documents(bpe.encode_documents(mixed, corpus_pipeline.TOKENIZER), corpus_pipeline.TOKENIZER))
    assert got == sorted(tuple(r) for r in want.collect())


def inputs_of_python(frame):
    """Column names that the tasks of a mapInArrow get."""
    node, names = frame._jdf.queryExecution().optimizedPlan(), []
    while True:
        if node.nodeName() == "MapInArrow":
            names = [node.child().output().apply(i).name() for i in range(node.child().output().length())]
        if node.children().length() != 1:
            return names
        node = node.children().head()


def test_a_carried_text_is_sent_to_python_once(edges, nothing):
    model = toxicity.train([], [])
    assert inputs_of_python(toxicity.keep_clean(edges, model)) == ["row"]
    assert inputs_of_python(toxicity.score_documents(edges, model)) == ["row", "text"]
    assert sorted(inputs_of_python(secrets.redact(edges))) == ["anonymous", "kinds", "row"]
    assert "text" in inputs_of_python(secrets.scan(edges))
    shown = secrets.scan_rows(edges, secrets.RULES, edges.columns, "[secret]").select("row.text", F.col("text").alias("new"), "spans").collect()
    assert all((r.new is None) == (not r.spans) for r in shown) and any(r.spans for r in shown)


def test_training_holds_one_basis():
    """Of float32, subsequences x landmarks: no second one, no copy in 64 bits."""
    texts = [f"plain words of text {i} on a river bank number{i % 50}" + " grumbold wackerdoo" * (i % 4 == 0) for i in range(400)]
    tracemalloc.start()
    toxicity.train(texts, [int(i % 4 == 0) for i in range(400)], landmarks=160)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spots = max(len(words) for words in seen_spots(texts))
    assert peak < 1.5 * spots * toxicity.CODES**3 * 4


def seen_spots(texts):
    """The landmark words of every round of a training."""
    seen, explicit = [], toxicity.explicit

    def watched(coder, words):
        seen.append(words)
        return explicit(coder, words)

    toxicity.explicit = watched
    try:
        toxicity.train(texts, [int(i % 4 == 0) for i in range(len(texts))], landmarks=160)
    finally:
        toxicity.explicit = explicit
    return seen


def test_words_are_counted_as_before_and_once(spark, edges, monkeypatch):
    alphabet = "ab \t\n\x0b\x0c\r\x1f\x85 é𝄞$.\\"
    draw = random.Random(1)
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 12))) for _ in range(3000)]
    odd = spark.createDataFrame([(t,) for t in texts], "text string")
    assert odd.filter(F.regexp_count("text", F.lit(tables.WORD)) != tables.count_words(F.col("text"))).count() == 0
    plans, settle = [], mixing.settle

    def watched(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return settle(frame)

    monkeypatch.setattr(mixing, "settle", watched)
    mixing.mix_sources(edges, corpus_pipeline.MIX)
    assert sum("regexp_replace(" in p or "regexp_extract_all(" in p for p in plans) == 1


def test_tables_of_rules_take_no_python_workers(spark, edges):
    table = secrets.local_table(spark, [("a", 1), ("b", 2)], "kind string, n int")
    assert sorted(map(tuple, table.collect())) == [("a", 1), ("b", 2)] and table.schema.simpleString() == "struct<kind:string,n:int>"
    plan = secrets.candidates(spark, edges, secrets.RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") == 2 and "LogicalRDD" not in plan.replace("LogicalRDD [doc_id", "")
