import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from sparkgrid.llm import alignment, queries
from sparkgrid.llm.tokenize import byte_characters

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(A)
LIBRARY.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=B)
BYTE = {c: b for b, c in enumerate(byte_characters())}


def tokens(text):
    """Both sides of a whole text by the libraries: [(id, bytes)]; none where the bytes differ."""
    whole = (" " + text).encode()
    a = [(i, bytes(BYTE[c] for c in LIBRARY.id_to_token(i))) for i in LIBRARY.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if MODEL.is_byte(i) else p.replace("▁", " ").encode())
         for i in MODEL.encode(text) for p in [MODEL.id_to_piece(i)]]
    same = text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
    return (a, b) if same else ([], [])


def spans(side):
    at, out = 0, []
    for i, data in side:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts):
    """Rows by looking up every token's bytes among the other side's."""
    rows, count = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text or ""))
        ends, starts = [y[2] for y in b], [y[1] for y in b]
        linked = [(x[0], y[0]) for x in a for y in b[bisect_right(ends, x[1]) : bisect_left(starts, x[2])]]
        count.update(linked)
        groups, at = [], 0
        for cut in sorted({x[2] for x in a} & {y[2] for y in b}):
            side = lambda s: ",".join(str(x[0]) for x in s if at < x[2] <= cut)  # noqa: B023
            groups.append(f"{side(a)}|{side(b)}")
            at = cut
        rows.append((len(a), len(b), len(groups), linked, ";".join(groups)))
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [(na, nb, ng, len(li), sum(count[p] == highest[p[1]] for p in li), sum(count[p] for p in li), g) for na, nb, ng, li, g in rows]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.lists(st.booleans(), max_size=40))
def test_shared_groups(cuts_a, cuts_b):
    size = max(len(cuts_a), len(cuts_b)) + 1
    a = [i + 1 for i, cut in enumerate(cuts_a) if cut] + [size + 1]
    b = [i + 1 for i, cut in enumerate(cuts_b) if cut] + [size + 1]
    groups = alignment.shared_groups(a, b)
    assert [a[g[1] - 1] for g in groups] == sorted(set(a) & set(b))
    assert [b[g[3] - 1] for g in groups] == sorted(set(a) & set(b))
    assert [g[0] for g in groups[1:]] == [g[1] for g in groups[:-1]] and alignment.shared_groups([], []) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab '.s\n\t <|endoftext|>1²é日▁\0", max_size=60))
def test_segments_give_the_text_s_tokens(text):
    text = text.encode("utf-8", "ignore").decode()
    own = alignment.aligner(A, B)
    [found] = own.segments([text])
    ok = all(own.sizes[4 * i + 3] for i in found)
    got = ";".join(own.texts[i] for i in found) if ok else ""
    assert got == brute([text])[0][6]


def fields(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups


@pytest.mark.parametrize("block", [50, alignment.BLOCK])
def test_align_edges(edges, block):
    small = edges.filter("length(text) < 5000 OR text IS NULL")
    texts = [r.text for r in small.select("text").collect()]
    got = alignment.align_documents(small, A, B, block_chars=block).collect()
    assert sorted(map(fields, got)) == sorted(brute(texts))
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((r.doc_id is None, r.doc_id) for r in small.select("doc_id").collect())


def test_align_very_long_texts(make_docs):
    rows = {r.doc_id: r for r in alignment.align_documents(make_docs([(1, "x" * 200_000), (2, "word " * 40_000)]), A, B).collect()}
    for doc_id, text in ((1, "x" * 200_000), (2, "word " * 40_000)):
        a, b = tokens(text)
        r = rows[doc_id]
        assert (r.n_a, r.n_b, r.n_links) == (len(a), len(b), len(a) + len(b) - r.n_groups)


def test_pair_counts(make_docs):
    blocks = alignment.align_blocks(make_docs([(1, "the cat"), (2, "the cat sat"), (3, None)]), A, B)
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.pair_counts(blocks).collect()}
    assert sum(n for n, _ in got.values()) == sum(r[3] for r in brute(["the cat", "the cat sat"]))
    assert all(best for n, best in got.values() if n == max(m for m, _ in got.values()))


def test_align_nothing(nothing):
    assert alignment.align_documents(nothing, A, B).count() == 0


def test_op13_matches_the_libraries(spark, corpus):
    got = {r.doc_id: r for r in queries.op13_alignment(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, want in zip(corpus.doc_id, brute(corpus.text), strict=True):
        r = got[doc_id]
        digest = hashlib.sha256(want[6].encode()).hexdigest() if want[0] else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (*want[:6], digest)
