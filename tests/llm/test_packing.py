import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from sparkgrid.llm import packing, queries

FILE = path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def fewest_bins(items, limit):
    """Exact optimum by dynamic programming over subsets."""
    best = {0: (0, 0)}  # mask -> (full bins, filled part of the last)
    for mask in range(1, 1 << len(items)):
        options = []
        for i, w in enumerate(items):
            if mask >> i & 1:
                bins, load = best[mask ^ 1 << i]
                options.append((bins, load + w) if bins and load + w <= limit else (bins + 1, w))
        best[mask] = min(options)
    return best[(1 << len(items)) - 1][0]


def counted(items, limit):
    return np.bincount(items, minlength=limit + 1)


def unfold(groups):
    return Counter(length for pattern, times in groups for length, n in pattern for _ in range(n * times))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=10))
def test_reduction_keeps_an_optimum(items):
    limit = 24
    fixed, rest = packing.reduce_by_dominance(counted(items, limit), limit)
    left = [w for w in range(limit + 1) for _ in range(rest[w])]
    assert unfold(fixed) + Counter(left) == Counter(items)
    assert all(sum(length * n for length, n in pattern) <= limit for pattern, _ in fixed)
    assert sum(t for _, t in fixed) + fewest_bins(left, limit) == fewest_bins(items, limit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_best_fit_on_counts_is_best_fit_one_by_one(items):
    limit, rooms = 24, []
    for w in sorted(items, reverse=True):
        fitting = [r for r in rooms if r >= w]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else limit) - w)
    groups = packing.best_fit(counted(items, limit), limit)
    assert sorted(limit - sum(length * n for length, n in p) for p, t in groups for _ in range(t)) == sorted(rooms)
    assert unfold(groups) == Counter(items)


def test_dominating_sets_by_hand():
    def of(item, *others, limit=100):
        return packing.dominating_set(item, counted([item, *others], limit), limit)
    assert of(60, 50, 70) == ()
    assert of(60, 40, 30, 10) == (40,)
    assert of(60, 38, 25, 30) == (38,)
    assert of(60, 38, 16, 15, 55) == (38,)          # two fit, 31 is less than 38
    assert of(60, 25, 14, 27, 55, 50) is None       # the best pair, 25 and 14, lacks the largest single
    assert of(60, 10, 11, 12) is None               # three fit
    for pair in combinations(range(15, 26), 2):     # the largest single belongs to the best pair
        found = of(60, *pair)
        assert found == (max(pair), min(pair)) if sum(pair) <= 40 else found == (max(pair),)


def check_packed(rows, texts, limit, end_id):
    """Every contract of the packing, from the rows and the library's ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, texts_of in texts.items():
        want = []
        for text in texts_of:
            ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
            cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
            want += [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == sorted(want)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by_sequence), sum(r.length for r in rows)


@pytest.mark.parametrize("limit", [16, 1024])
def test_pack_edges(edges, limit):
    packed = packing.pack_documents(edges, FILE, limit, end_id=2).selectExpr("*", "crc32(ids) AS ids_crc32")
    texts = defaultdict(list)
    for d, t in edges.select("doc_id", "text").collect():
        texts[d].append(t)
    used, tokens = check_packed(packed.collect(), texts, limit, 2)
    assert used <= -(-tokens // limit) + 2
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * tokens and len(whole) == used
    assert all(r.starts == sorted(r.starts) and r.starts[0] == 0 for r in whole)


def test_pack_nothing(nothing):
    assert packing.pack_documents(nothing, FILE).count() == 0


def test_op11_matches_the_library(spark, corpus):
    rows = queries.op11_packing(spark, "/root/testdata/sf0.001").collect()
    used, tokens = check_packed(rows, {d: [t] for d, t in zip(corpus.doc_id, corpus.text, strict=True)}, 1024, 2)
    assert used <= -(-tokens // 1024) * 1.02 + 1
