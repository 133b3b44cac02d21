import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from sparkgrid.llm import bpe, queries, tokenfiles, tokenize
from sparkgrid.llm.tokenize import Encoder, Words

FILE = path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab '.s\n\t <|endoftext|>1²é", max_size=60))
def test_words_encoded_alone_give_the_text_s_ids(text):
    words = Words(FILE)
    text = text.encode("utf-8", "ignore").decode()
    assert [i for w in words.split(text) for i in words.encode(w)] == library_ids(text)


ODD = st.text(max_size=40) | st.text("ab '.s\n\t <|endoftext|>1²é", max_size=40) | st.text("'stmdrevlle x\n\x1c\x85!", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=12), st.sampled_from([1, 7, 50, tokenize.CHARS]))
def test_texts_encoded_together_give_each_text_s_ids(texts, chars):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    before, tokenize.CHARS = tokenize.CHARS, chars
    try:
        got = Encoder(FILE).encode_all(texts)
    finally:
        tokenize.CHARS = before
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library_ids(t) for t in texts]


def test_every_character_is_split_as_the_pattern_does():
    every = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f" {c}'s{c}\n{c}1{c}" for c in every[i : i + 50_000]) for i in range(0, len(every), 50_000)]
    words, marks = tokenize.split_all(texts)
    at, words = 0, words.to_pylist()
    for text, end in zip(texts, marks, strict=True):
        assert words[at:end] == Words(FILE).find(text) and words[end] == "\n"
        at = end + 1
    assert at == len(words)


def test_frequent_words_are_looked_up_once_in_many_texts():
    class Counting(Encoder):
        looked = 0

        def __getitem__(self, word):
            Counting.looked += 1
            return super().__getitem__(word)

    texts = [f"The same few words and it's number {i % 10}\n" for i in range(2000)]
    coder = Counting(FILE)
    assert coder.encode_all(texts) == [np.array(library_ids(t), "<u2").tobytes() for t in texts]
    assert Counting.looked < 100


def test_token_files_round_trip(spark, edges):
    folder = tokenfiles.new_folder(spark)
    manifest = tokenfiles.write_tokens(edges, FILE, folder)
    got = tokenfiles.read_tokens(manifest, folder).orderBy("start").collect()
    assert len(got) == edges.count()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r.start == at and r.ids[-1] == 0
        at += len(r.ids)
    want = sorted((-1 if d is None else d, [*library_ids(t), 0]) for d, t in edges.select("doc_id", "text").collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == want
    fs, where = tokenfiles.open_folder(folder)
    flat = np.concatenate([np.frombuffer(fs.open_input_file(f"{tokenfiles.stem(where, m.part)}.tokens").read_buffer(), "<u2")
                           for m in manifest.orderBy("part").collect()])
    assert len(flat) == at and (flat == np.concatenate([r.ids for r in got])).all()


def test_token_files_of_nothing(spark, nothing):
    folder = tokenfiles.new_folder(spark)
    assert tokenfiles.checksums(tokenfiles.write_tokens(nothing, FILE, folder), folder).count() == 0


def test_op1_matches_the_library(spark, corpus):
    got = {r.doc_id: r for r in queries.op1_tokens(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for doc_id, text in zip(corpus.doc_id, corpus.text, strict=True):
        ids = np.array([*library_ids(text), 0], dtype="<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("block", [100, bpe.BLOCK])
def test_bpe_round_trip(edges, block):
    got = bpe.decode_documents(bpe.encode_documents(edges, FILE, block), FILE).collect()
    key = lambda d: (-1 if d[0] is None else d[0], d[1])
    want = sorted(((d, library_ids(t)) for d, t in edges.select("doc_id", "text").collect()), key=key)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == want
    texts = sorted(t or "" for _, t in edges.select("doc_id", "text").collect())
    assert sorted(r.decoded for r in got) == texts


def test_decode_replaces_what_is_no_utf8(spark):
    ids = library_ids("日本")[:1]
    table = spark.createDataFrame([(1, ids), (2, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode_documents(table, FILE).collect()}
    assert got == {1: LIBRARY.decode(ids, skip_special_tokens=False), 2: ""}


def test_bpe_of_nothing(nothing):
    assert bpe.digests(bpe.decode_documents(bpe.encode_documents(nothing, FILE), FILE)).count() == 0


def test_op8_matches_the_library(spark, corpus):
    got = {r.doc_id: r for r in queries.op8_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in zip(corpus.doc_id, corpus.text, strict=True):
        ids = library_ids(text)
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
