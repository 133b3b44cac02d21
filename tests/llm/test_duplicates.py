import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkgrid.llm import fingerprints, groups, paragraphs, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, near):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near(i, j) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_of_edges(edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    rows = edges.select("doc_id", "text").collect()
    prints = sorted((str(d), brute_fingerprint(t)) for d, t in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == prints
    by_print = {}
    for r in got:
        by_print.setdefault(r.fp, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by_print.values())
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_components_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = []
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 12))):
            values.append(x)
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(b)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
    want = reach(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 4)
    assert got == dict(enumerate(want))


def test_keep_first(make_docs, edges):
    docs = make_docs([(5, "a b c d e"), (3, "A B C D E"), (9, "quite another text here"), (9, "one more with id nine"), (None, "a b c d e")])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "A B C D E"), ("9", "one more with id nine"), ("None", "a b c d e")]
    found = simhash.keep_first(edges).collect()
    stay = {r.component_id for r in simhash.near_duplicates(edges).collect()}
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted(stay - {None})
    assert sum(r.doc_id is None for r in found) == 2
    assert all(r["_rows"] == "rows" and r["id"] == 7 and r["n"] == 6 for r in found)


def test_components_of_a_star_and_a_chain(spark):
    star = spark.range(1, 3000).selectExpr("0L AS a", "id AS b")
    chain = spark.range(5000, 5060).selectExpr("id AS a", "id + 1 AS b")
    got = {r.node: r.root for r in groups.components(star.union(chain)).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {i: 5000 for i in range(5001, 5061)}
    assert groups.components(star.limit(0)).count() == 0


def test_stars_are_seen_without_another_step(spark, monkeypatch):
    """A whole step ran, and a digest of all edges, to see that nothing changed."""
    from sparkgrid.llm import groups

    written, write = [], groups.write_aside
    monkeypatch.setattr(groups, "write_aside", lambda df: written.append(0) or write(df))
    links = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 30), (30, 20), (5, 5)], "a long, b long")
    assert sorted(groups.components(links).collect()) == [(i, 1) for i in range(2, 9)] + [(30, 20)]
    assert len(written) == 2


def test_hot_buckets_are_compared_whole(spark):
    rows = spark.range(300).select(F.lit(1).cast("long").alias("key"), "id")
    cells = groups.cells_of(rows, "key", "id", 64).collect()
    held = {}
    for r in cells:
        held.setdefault(r.cell, set()).add(r.id)
    assert max(map(len, held.values())) < 300
    assert all(any(i in h and j in h for h in held.values()) for i in range(0, 300, 7) for j in range(300))


def test_components_of_chains_and_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(200, 100), (300, 200), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in groups.components(links).collect()}
    assert got == dict.fromkeys(range(1, 51), 0) | {200: 100, 300: 100}
    assert groups.components(links.limit(0)).count() == 0


PASSAGE = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(60)) + "."


def test_repeated_passages_inside_other_texts(make_docs):
    filler = lambda k: " ".join(f"own{k}x{i}" for i in range(30))
    docs = make_docs([(1, f"{filler(1)} {PASSAGE} {filler(2)}"), (2, f"{filler(3)}. {PASSAGE} {filler(4)}"), (3, filler(5) + ". " + filler(6))])
    got = paragraphs.repeated_paragraphs(docs).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.component_doc_id for r in got} == {1}
    assert all(r.removed == (r.doc_id == 2) for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in PASSAGE
    cleaned = {r.doc_id: r for r in paragraphs.remove_repeats(docs).collect()}
    assert cleaned[1].text == texts[1] and cleaned[3].text == texts[3] and len(cleaned[2].text) < len(texts[2]) - 150


def test_near_paragraphs(make_docs):
    long = [f"term{i}" for i in range(80)]
    edited = [*long[:40], "changed", *long[41:]]
    got = paragraphs.repeated_paragraphs(make_docs([(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(long[::-1]))])).collect()
    assert sorted((r.doc_id, r.removed) for r in got) == [(1, False), (2, True)]


def test_paragraph_edges(edges, nothing):
    assert {r.doc_id for r in paragraphs.repeated_paragraphs(edges).collect()} <= {1, 10}
    assert paragraphs.repeated_paragraphs(nothing).count() == 0
    assert paragraphs.remove_repeats(edges).count() == edges.count()


def test_bands_are_tuned_for_recall():
    bands, rows = paragraphs.tune_bands(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and (bands, rows) == (3, 1)


def test_fingerprints_of_edges(edges, nothing):
    rows = fingerprints.fingerprint_documents(edges).collect()
    assert len(rows) == edges.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[2].fingerprint
    assert by_id[5].fingerprint == by_id[6].fingerprint
    assert by_id[3].near_next == 1.0 and by_id[2].near_edited == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 256 for r in rows)
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def test_single_document_is_its_own_next(make_docs):
    one = fingerprints.fingerprint_documents(make_docs([(1, "a b c d e f g h")])).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("shared", [20, 80])
def test_collision_rate_is_generalised_jaccard(make_docs, shared):
    a = [f"w{i} " * (1 + i % 4) for i in range(100)]
    b = [f"w{i} " * (1 + (i + 1) % 4) for i in range(shared)] + [f"v{i} " for i in range(100 - shared)]
    docs = make_docs([(1, "".join(a)), (2, "".join(b))])
    from collections import Counter
    x, y = Counter("".join(a).split()), Counter("".join(b).split())
    want = sum((x & y).values()) / sum((x | y).values())
    assert abs(fingerprints.fingerprint_documents(docs).filter("doc_id = 1").first().near_next - want) < 0.2


def test_collision_rate_of_long_texts(spark):
    """100,000 terms of weight 1 or 8, swapped in the other text: generalised Jaccard 1/8, over six pairs of texts."""
    times = lambda i: F.when((i + F.col("side")) % 2 == 0, 8).otherwise(1)
    word = lambda i: F.concat_ws("_", F.col("pair").cast("string"), i.cast("string"))
    words = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.array_repeat(word(i), times(i))))
    texts = spark.range(12).select((F.col("id") / 2).cast("int").alias("pair"), (F.col("id") % 2).cast("int").alias("side"))
    texts = texts.repartition(12, "pair", "side").withColumn("text", F.array_join(words, " "))
    prints = fingerprints.fingerprint_texts(texts, ["pair", "side"], "text")
    both = prints.groupBy("pair").pivot("side", [0, 1]).agg(F.first("fingerprint"))
    rate = both.agg(F.avg(fingerprints.likeness(F.col("0"), F.col("1")))).first()[0]
    assert abs(rate - 0.125) <= 3 * (0.125 * 0.875 / (6 * fingerprints.SAMPLES)) ** 0.5


def test_draws_follow_the_gamma_distribution():
    middle, small, large = fingerprints.gamma_tables()
    below = lambda x: 1 - (1 + x) * np.exp(-x)
    assert np.allclose(below(middle), (np.arange(len(middle)) + 0.5) / len(middle))
    n = fingerprints.QUANTILES * fingerprints.FINE
    assert np.allclose(small[:50] ** 2 / 2 * (1 - 2 * small[:50] / 3), (np.arange(50) + 0.5) / n, rtol=1e-5)
    assert np.allclose((1 + large) * np.exp(-large), (np.arange(len(large)) + 0.5) / n, rtol=1e-6)
    assert np.all(np.diff(small) > 0) and np.all(np.diff(large) < 0)


def test_edited_texts_take_from_the_next_document(spark, corpus):
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    texts = [t or "" for t in corpus.text]
    for doc_id, text, after in zip(corpus.doc_id, texts, [*texts[1:], texts[0]], strict=True):
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert got[doc_id].n_chars == len(text) and got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def texts_of_units(text):
    data, spans, _, _ = paragraphs.Splitter()(text)
    return [data[a:b].decode() for a, b in spans[:, :2].tolist()]


def words_in_units(text):
    _, spans, words, _ = paragraphs.Splitter()(text)
    held = np.zeros(len(words), dtype=bool)
    for first, n in spans[:, 2:4].tolist():
        held[first : first + n] = True
    return int(held.sum()), len(words)


def short_lines(name, n, width=5):
    return "\n".join(" ".join(f"{name}{i}w{j}" for j in range(width)) for i in range(n)) + "\n"


PROSE_LINE = "a sentence of more than six words stands here. Ends so.\n"


@pytest.mark.parametrize("text", [
    short_lines("a", 40), short_lines("a", 40, 1), "Title\n\n" + PROSE_LINE, PROSE_LINE + "tail\n", "one two three\n\nfour five six", "这是一个没有空格的句子，它有很多字。第二个句子也没有空格，同样很长！",
])
def test_every_word_is_in_a_paragraph(text):
    held, n = words_in_units(text)
    assert held == n > 0


def test_a_line_keeps_its_own_paragraph_behind_a_short_one():
    assert "a sentence of more than six words stands here." in texts_of_units("Title\n" + PROSE_LINE)


def test_repeats_among_short_lines(make_docs):
    shared = short_lines("both", 16)
    docs = make_docs([(1, short_lines("a", 3) + shared + short_lines("b", 4)), (2, short_lines("c", 6) + shared), (3, short_lines("d", 30))])
    rows = paragraphs.repeated_paragraphs(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2} and all(r.removed == (r.doc_id == 2) for r in rows)
    assert all(sum(r.n_words for r in rows if r.doc_id == d) >= 40 for d in (1, 2))


def test_a_part_is_no_repeat_of_its_whole(make_docs):
    line = " ".join(f"only{i}" for i in range(30))
    assert paragraphs.repeated_paragraphs(make_docs([(1, f"Title\n{line}\n"), (2, short_lines("e", 20))])).count() == 0
    rows = paragraphs.repeated_paragraphs(make_docs([(1, f"Title\n{line}\n"), (2, f"Other one\n{line}\n"), (3, line)])).collect()
    assert {(r.doc_id, r.removed) for r in rows} == {(1, False), (2, True), (3, True)}


def test_repeats_inside_long_sentences(make_docs):
    own = lambda name: " ".join(f"{name}{i}" for i in range(200))
    shared = " ".join(f"both{i}" for i in range(80))
    texts = {1: f"{own('a')} {shared} {own('b')}", 2: f"{own('c')} {shared} {own('d')}", 3: f"{own('e')} {own('f')}"}
    rows = paragraphs.repeated_paragraphs(make_docs(list(texts.items()))).collect()
    assert {r.doc_id for r in rows} == {1, 2} and all(r.removed == (r.doc_id == 2) for r in rows)
    assert all(sum(w in shared.split() for r in rows if r.doc_id == d for w in texts[d][r.start : r.end].split()) >= 40 for d in (1, 2))


def test_a_repeat_of_a_piece_stays_where_its_whole_stays(make_docs):
    whole = [f"term{i}" for i in range(80)]
    edited = [*whole[:40], "changed", *whole[41:]]
    other = [f"own{i}" for i in range(60)]
    texts = {1: " ".join(whole), 2: " ".join(edited), 3: " ".join(other + edited[28:54] + other[::-1])}
    docs = make_docs(list(texts.items()))
    rows = paragraphs.repeated_paragraphs(docs).collect()
    assert [(r.start, r.end) for r in rows if r.doc_id == 2 and r.removed] == [(0, len(texts[2]))]
    kept = " ".join(r.text for r in paragraphs.remove_repeats(docs).collect())
    assert set(kept.split()) == {w for t in texts.values() for w in t.split()}


def test_a_text_of_many_documents_is_no_window_group(spark, make_docs):
    line = "this license line of nine words stands in all"
    docs = make_docs([(i, f"{line}\n" + " ".join(f"own{i}x{j}" for j in range(12))) for i in range(40)])
    said = []
    keep = paragraphs.settle
    paragraphs.settle = lambda df: said.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    try:
        rows = paragraphs.repeated_paragraphs(docs).collect()
    finally:
        paragraphs.settle = keep
    assert sorted((r.doc_id, r.removed) for r in rows) == [(i, i > 0) for i in range(40)]
    assert not [p for p in said if "Window" in p and "paragraph" in p]
