import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgrid.llm import quality, queries, secrets, toxicity

BASE = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2),
    ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0),
]


def brute_spans(text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, pattern, least, group) in enumerate(BASE)
             for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(found)]


def test_trigram_queries():
    queries_of = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert queries_of["hex"] == []
    assert queries_of["access"] == [[{"aki", "kia"}]]
    assert len(queries_of["private_key"]) == 2
    assert all({"ssw", "pas"} <= s or not s & {"ssw"} for s in queries_of["assign"][0])


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("AKIapiey_kosdtnwr=:'\" 0f9b"), max_size=50))
def test_no_match_without_its_trigrams(text):
    low = text.lower()
    for rule in secrets.RULES:
        if re.search(rule.pattern, text):
            assert all(any(all(t in low for t in s) for s in clause) for clause in secrets.trigram_query(rule.pattern))


def test_scan_of_edges_equals_brute_force(edges, nothing, make_docs):
    more = make_docs([(20, "TOKEN='abc' secret = aaaaaaaaaa"), (21, "é password: token=abcdefghij"), (22, "f" * 31 + " " + "0" * 40)])
    kinds = {n for n, *_ in BASE}
    for table in (edges, more):
        got = secrets.scan(table).collect()
        assert len(got) == table.count()
        for r in got:
            assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in kinds] == brute_spans(r.text)
    assert secrets.scan(nothing).count() == 0


def test_index_answers_like_the_text(spark, corpus):
    docs = spark.createDataFrame(corpus)
    index = {r.trigram: set(r.docs) for r in secrets.postings(docs.coalesce(1), [secrets.code("the"), secrets.code("qzx")]).collect()}
    want = {d for d, t in zip(corpus.doc_id, corpus.text, strict=True) if "the" in t.lower()}
    assert index.get(secrets.code("the"), set()) >= want - {None}
    assert secrets.code("qzx") not in index


def test_redaction(edges):
    clean = secrets.redact(edges)
    assert clean.columns == edges.columns and clean.count() == edges.count()
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[1].text.endswith("[secret] ends.") and rows[1].n_chars == len(rows[1].text) and rows[1].spans == 2
    assert rows[2].text is None and rows[3].text == ""


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": twice, "n_repeat_words": len(marked)}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t#|"), max_size=80))
def test_counts_equal_brute_force(text):
    assert quality.counts(text) == brute_counts(text)


def test_quality_of_edges(edges, nothing):
    model = quality.train(["good text " * 20, "b@d ### $$$ " * 20] * 20, [1, 0] * 20)
    got = quality.judge_documents(edges, model).collect()
    assert len(got) == edges.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].base_failed and not by_id[2].kept and by_id[10].base_failed and by_id[10].n_words == 40_000
    assert quality.judge_documents(nothing, model).count() == 0


def held_out(spark, column):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", column).toPandas()
    keep = np.array([zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id])
    return docs, labels, rows[keep]


def test_quality_on_held_out_labels(spark):
    docs, labels, rows = held_out(spark, "quality")
    model = quality.fit_documents(docs, labels)
    p = np.array([float(model.probability(quality.features(t))) for t in rows.text])
    good = rows.quality.to_numpy() == 1
    assert (p[good] >= quality.THRESHOLD).mean() > 0.97 and (p[~good] < quality.THRESHOLD).mean() > 0.9
    assert abs(p.mean() - good.mean()) < 0.05


def test_toxicity_on_held_out_labels(spark):
    docs, labels, rows = held_out(spark, "toxic")
    model = toxicity.fit_documents(docs, labels)
    score = model.scores(toxicity.Coder(), rows.text.tolist())
    toxic = rows.toxic.to_numpy() == 1
    assert (score[toxic] >= toxicity.THRESHOLD).mean() > 0.85 and (score[~toxic] < toxicity.THRESHOLD).mean() > 0.98


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        body = list(rng.choice(words, 25))
        if i % 4 == 0:
            body[3:3] = ["grumbold"]
            body[9:9] = ["wackerdoo"]
        texts.append(" ".join(body))
        labels.append(int(i % 4 == 0))
    return toxicity.train(texts, labels), words


def test_gapped_and_inserted_characters(small_model):
    model, words = small_model
    coder = toxicity.Coder()
    clean = " ".join(words[:20])
    for insult in ("grumbold wackerdoo", "GRUMBOLD Wackerdoo!", "grum-bold wacker.doo", "gruxmbold wackezrdoo", "g r u m b o l d w a c k e r d o o"):
        assert model.scores(coder, [f"{clean} {insult}"])[0] > model.scores(coder, [clean])[0], insult
    assert model.scores(coder, [f"{clean} grumbold wackerdoo"])[0] > 0.7 > model.scores(coder, [clean])[0]


def test_toxicity_of_edges(edges, nothing, small_model):
    model, _ = small_model
    got = toxicity.score_documents(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_clean(edges, model)
    assert kept.columns == edges.columns
    assert toxicity.score_documents(nothing, model).count() == 0
    assert 0 <= toxicity.train([], []).scores(toxicity.Coder(), [""])[0] <= 1


def test_every_dealt_query_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
