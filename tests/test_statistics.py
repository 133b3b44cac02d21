import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.core import attach
from sparkgrid.operators import hist, rank, shape, stats


def one(df):
    return df.collect()[0].asDict()


def test_percentiles_match_numpy_with_ties_and_signs(to_cells):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(0, 3, (17, 19)), 1)
    got = one(rank.percentiles(to_cells(a=a), {"p1": 1, "p50": 50, "p995": 99.5}))
    for k, p in (("p1", 1), ("p50", 50), ("p995", 99.5)):
        assert got[k] == pytest.approx(np.percentile(a, p), abs=1e-12)


@pytest.mark.parametrize("shape_", [(1, 1), (1, 7), (3, 3), (12, 13)])
def test_background_and_noise_are_lower_medians(to_cells, shape_):
    rng = np.random.default_rng(2)
    a = np.round(rng.exponential(5, shape_), 1)
    low = np.sort(a.ravel())
    tenth = low[: max(int(a.size * 0.1), 1)]
    quart = low[: max(int(a.size * 0.25), 1)]
    med = lambda v: np.sort(v)[(len(v) - 1) // 2]
    cells = to_cells(a=a)
    assert one(rank.background_level(cells))["background"] == med(tenth)
    sigma = max(1.4826 * med(np.abs(quart - med(quart))), 1e-12)
    assert one(rank.noise_sigma(cells))["sigma"] == pytest.approx(sigma)


def test_lowest_fraction_cuts_ties_exactly(to_cells):
    a = np.array([[1.0, 1, 1, 1, 2, 2, 2, 2, 3, 4]])
    got = {r.v: r.copies for r in rank.lowest_fraction(to_cells(a=a), 0.6).collect()}
    assert got == {1.0: 4, 2.0: 2}


def test_gini_bounds_and_zero_image(to_cells):
    peak = np.zeros((5, 5))
    peak[2, 2] = 7
    rows = {r.img: r.gini for r in rank.gini(to_cells(flat=np.ones((5, 5)), zero=np.zeros((5, 5)), peak=peak)).collect()}
    assert rows["flat"] == pytest.approx(0, abs=1e-12)
    assert rows["zero"] == 0
    assert 0.9 < rows["peak"] < 1


def test_bucket_code_is_monotone(spark):
    vals = sorted([-1e300, -5.5, -1.0, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.0001, 2.0, 1024.0, 65535.0, 1e300])
    df = spark.createDataFrame([(v,) for v in vals], "v double").select("v", rank.bucket_of(F.col("v")).alias("b"))
    codes = [r.b for r in df.orderBy("v").collect()]
    assert codes == sorted(codes)


def test_array_stats_ignores_non_finite(to_cells):
    a = np.array([[1.0, np.nan, np.inf, 3.0, 0.0]])
    got = one(stats.array_stats(to_cells(a=a)))
    assert (got["min"], got["max"], got["p50"]) == (0.0, 3.0, 1.0)
    assert got["nonzero_percent"] == pytest.approx(80.0)
    none = one(stats.array_stats(to_cells(a=np.array([[np.nan, np.inf]]))))
    assert none["max"] == 0 and none["p50"] == 0


def test_normalize_constant_is_zero(to_cells):
    assert {r.v for r in stats.normalize(to_cells(a=np.full((3, 3), 4.0))).collect()} == {0.0}


def test_histogram_matches_numpy(to_cells):
    a = np.random.default_rng(3).gamma(2, 3, (20, 20))
    cells = to_cells(a=a)
    lim = hist.pane_limits(cells, ["img"])
    rows = hist.histogram(cells, lim, 32, ["img"]).orderBy("bin").collect()
    want, _ = np.histogram(a, 32, (0, a.max()))
    assert [r.n for r in rows] == want.tolist()


@pytest.mark.parametrize("limit", [0, 1000])
def test_attach_gives_the_same_rows_broadcast_or_salted(spark, limit):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    groups = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    got = sorted((r.id, r.name) for r in attach(rows, groups, ["k"], limit=limit).collect())
    assert got == [(i, "ab"[i % 3]) for i in range(500) if i % 3 < 2]
    assert attach(rows, groups, ["k"], "left", limit=limit).count() == 500


def test_pyramid_crops_odd_sides_per_level(to_cells, to_array):
    a = np.arange(7 * 10, dtype=float).reshape(7, 10)
    p = shape.pyramid(to_cells(a=a), 3)
    one_ = a[:6, :10].reshape(3, 2, 5, 2).mean((1, 3))
    two = one_[:2, :4].reshape(1, 2, 2, 2).mean((1, 3))
    assert np.allclose(to_array(p.filter("level = 1"))[0], one_)
    assert np.allclose(to_array(p.filter("level = 2"))[0], two)


def test_center_crop_and_stride(to_cells, to_array):
    a = np.arange(9 * 11, dtype=float).reshape(9, 11)
    cells = to_cells(a=a)
    assert np.array_equal(to_array(shape.center_crop(cells, 1, 4, 5))[0], a[2:6, 3:8])
    assert np.array_equal(to_array(shape.strided_sample(cells, 1, 4))[0], a[::3, ::3])


def test_simpson_and_even_sample_count(spark):
    rows = [(float(i), i, float((i * 0.5) ** 3)) for i in range(9)]
    df = spark.createDataFrame([("a", i, f) for _, i, f in rows], "k string, i int, f double")
    assert one(shape.simpson(df, 0.5, ["k"]))["integral"] == pytest.approx(4**4 / 4)
    with pytest.raises(Exception, match="odd number"):
        shape.simpson(df.filter("i < 8"), 0.5, ["k"]).collect()


def test_validate_shapes_fails_on_ragged_channels(spark, to_cells):
    ok = to_cells(a=np.ones((3, 3)))
    ragged = ok.unionByName(ok.filter("y < 2").withColumn("c", F.lit(1)))
    assert stats.validate_shapes(ok).count() == 9
    with pytest.raises(Exception, match="differ in shape"):
        stats.validate_shapes(ragged).count()


def test_no_window_sees_a_whole_bucket_of_an_offset_signal(spark):
    """200,000 distinct values in one bucket are ranked in parts of a few hundred."""
    rows = spark.range(200_000).select(F.lit("i").alias("img"), F.lit(0).alias("t"), F.lit(0).alias("c"), (300 + F.col("id") / 1e6).alias("v"))
    buckets = rows.select(rank.bucket_of(F.col("v")).alias("b"), rank.bucket_of(F.col("v"), rank.RESOLUTION * rank.PARTS).alias("f"))
    assert buckets.select("b").distinct().count() <= 2
    assert buckets.groupBy("f").count().agg(F.max("count")).first()[0] < 1000
    got = rank.percentiles(rows, {"p": 25.0}).first()
    assert abs(got.p - (300 + 0.25 * 199_999 / 1e6)) < 1e-9


def test_kernel_size_at_whole_radii(spark):
    """Four Airy radii of exactly 1,403 pixels; 2.44 as a double gave 1,402."""
    from sparkgrid.functions.scalar import kernel_size

    rows = spark.createDataFrame([(460, 0.4, 2.0), (460, 0.4, 46.76), (520, 1.4, 65.0)], "nm int, na double, px double")
    assert [r[0] for r in rows.select(kernel_size(F.col("nm"), F.col("na"), F.col("px"))).collect()] == [2807, 121, 65]
