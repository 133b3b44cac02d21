import math

import numpy as np
import pytest

from sparkgrid.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, q int, w string, score string, cell int, vec string, ids string, place int"


@pytest.fixture(scope="module")
def make_rows(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "w", "s", 2, "v", "i", 3) for r in rows], SCHEMA).repartition(3)
    return make


def brute(rows, every=50, positives=5, most=3, low=50, high=95):
    whole = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = (label, np.floor(256 * np.float32([*v, *[0] * (16 - len(v))]).astype(float)).astype(int))
    out = []
    for a, (label, q) in whole.items():
        if a % every:
            continue
        scores = sorted((-int(q @ v), i, other == label) for i, (other, v) in whole.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            found = [(-n, i) for n, i, same in scores if not same and low * -s <= 100 * -n <= high * -s][:most]
            out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(found)]
    return sorted(out)


def fields(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def random_rows(n, seed, dims=12, labels=4, clusters=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    v = centres[rng.integers(clusters, size=n)] + 0.3 * rng.normal(size=(n, dims))
    return [(i, [float(x) for x in np.float32(v[i])], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_cells_and_slices(make_rows, monkeypatch, seed):
    """Small cells, slices and first rounds, so that stopping and passing over cells decide the result."""
    for name, value in (("PER_CELL", 8), ("SLICE", 7), ("FIRST_LOOK", 20), ("TOGETHER", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = random_rows(500, seed)
    assert fields(negatives.hard_negatives(make_rows(rows), anchors_every=20)) == brute(rows, every=20)


def test_copies_ties_and_odd_rows(make_rows):
    rows = random_rows(120, 3, dims=4)
    rows += [(200 + i, [1.0, 0.0, 0.5, 0.0], i % 2) for i in range(80)]  # copies, many of them anchors
    rows += [(400, None, 1), (450, [1.0, None, 0.0, 0.0], 1), (500, [float("nan"), 0.0, 0.0, 0.0], 1), (550, [float("inf")] * 4, 1),
             (None, [1.0] * 4, 1), (600, [1.0] * 4, None), (650, [], 1), (700, [1.0, 0.25], 0), (750, [-1.0, 0.5, 0.0, 0.0], 3)]
    got = fields(negatives.hard_negatives(make_rows([*rows, rows[0], rows[50]]), anchors_every=10))
    assert got == brute(rows, every=10)


def test_nothing(make_rows):
    assert negatives.hard_negatives(make_rows([])).count() == 0
    assert negatives.hard_negatives(make_rows([(1, [1.0], 1), (50, [1.0], 1)])).count() == 0


def test_heap_visits_every_cell_in_order_of_its_bound():
    rng = np.random.default_rng(4)
    index = negatives.Index((rng.normal(size=(6, 3)), rng.normal(size=(5, 4))), (rng.random(6), rng.random(5)), np.ones(30, int))
    seen = list(index.visit(rng.normal(size=7)))
    assert [u for u, _, _ in seen] == sorted((u for u, _, _ in seen), reverse=True)
    assert sorted(c for _, _, c in seen) == list(range(30)) and all(lo <= u for u, lo, _ in seen)


def test_op12_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert fields(queries.op12_negatives(spark, "/root/testdata/sf0.001")) == brute(rows)
