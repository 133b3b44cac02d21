import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgrid.operators import conv, kernel as kn, spectral, stencil as sc

K = kn.separable([1.0], [1, 2, 1], [1, 3, 2, 1])


def dense(a, taps, sign=1):
    """Full-support convolution as a dict of coordinates."""
    out = {}
    for (y, x), v in np.ndenumerate(a):
        for dz, dy, dx, w in taps:
            k = (y + sign * dy, x + sign * dx)
            out[k] = out.get(k, 0) + v * w
    return out


@pytest.mark.parametrize("block", [2, 3, 64])
def test_convolution_does_not_depend_on_block_size(to_cells, block):
    a = np.random.default_rng(0).random((7, 9))
    got = {(r.y, r.x): r.v for r in conv.convolve(to_cells(a=a), K, block).collect()}
    want = dense(a, K)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 1000))
def test_correlation_is_the_adjoint(to_cells, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((5, 6)), rng.random((9, 10))
    x, y = to_cells(a=a), to_cells(a=b)
    on = ["img", "t", "c", "z", "y", "x"]
    dot = lambda p, q: p.join(q.withColumnRenamed("v", "u"), on).agg(F.sum(F.col("v") * F.col("u"))).first()[0]
    assert dot(conv.convolve(x, K), y) == pytest.approx(dot(conv.correlate(y, K), x))


def test_convolution_keeps_the_sum(to_cells):
    a = np.random.default_rng(1).random((6, 6))
    assert conv.convolve(to_cells(a=a), K).agg(F.sum("v")).first()[0] == pytest.approx(a.sum())


def test_edge_strength_is_numpy_gradient(to_cells):
    a = np.random.default_rng(2).random((6, 8))
    line = a[:1]
    got = {r.img: r.edge_strength for r in sc.edge_strength(to_cells(a=a, line=line, dot=a[:1, :1])).collect()}
    assert got["a"] == pytest.approx(np.mean(np.sqrt(sum(g * g for g in np.gradient(a)))))
    assert got["line"] == pytest.approx(np.mean(np.abs(np.gradient(line[0]))))
    assert got["dot"] == 0


def penalty(x, w, zs):
    def at(dz, dy, dx):
        z = slice(None) if x.shape[0] == 1 else slice(1 + dz, x.shape[0] - 1 + dz)
        return x[z, 1 + dy: x.shape[1] - 1 + dy, 1 + dx: x.shape[2] - 1 + dx]
    c = at(0, 0, 0)
    dxx, dyy = 2 * c - at(0, 0, 1) - at(0, 0, -1), 2 * c - at(0, 1, 0) - at(0, -1, 0)
    dxy = at(0, 1, 1) - at(0, 1, 0) - at(0, 0, 1) + c
    dzz = dxz = dyz = 0
    if x.shape[0] > 1:
        dzz = zs * zs * (2 * c - at(1, 0, 0) - at(-1, 0, 0))
        dxz, dyz = zs * (at(1, 0, 1) - at(1, 0, 0) - at(0, 0, 1) + c), zs * (at(1, 1, 0) - at(1, 0, 0) - at(0, 1, 0) + c)
    hv = w * w * (dxx**2 + dyy**2 + dzz**2 + 2 * (dxy**2 + dxz**2 + dyz**2)) + ((1 - w) * c) ** 2
    return np.mean(np.sqrt(hv + 1e-8))


@pytest.mark.parametrize("shape", [(1, 5, 6), (4, 5, 4)])
def test_penalty_gradient_is_its_derivative(to_cells, to_array, shape):
    from sparkgrid.plans.dense import hessian_gradient

    x = np.random.default_rng(3).random(shape) * 5
    cells = to_cells(a=x)
    assert sc.sparse_hessian_penalty(cells, 0.6, 0.4).first().penalty == pytest.approx(penalty(x, 0.6, 0.4))
    g = to_array(sc.sparse_hessian_gradient(cells, 0.6, 0.4), "g")
    num = np.zeros_like(x)
    for i in np.ndindex(shape):
        d = np.zeros_like(x)
        d[i] = 1e-5
        num[i] = (penalty(x + d, 0.6, 0.4) - penalty(x - d, 0.6, 0.4)) / 2e-5
    assert np.allclose(g, num, atol=1e-7)
    assert np.allclose(hessian_gradient(x, 0.6, 0.4), num, atol=1e-7)


def test_small_sides_have_no_penalty(to_cells):
    assert sc.sparse_hessian_penalty(to_cells(a=np.ones((2, 9)))).first().penalty == 0


def test_smoothing_reflects_and_rejects_short_axes(to_cells, to_array):
    a = np.random.default_rng(4).random((9, 8))
    w = np.array(sc.gaussian_weights(1.0))
    p = np.pad(a, 3, mode="reflect")
    want = np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 0, p)
    want = np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 1, want)
    assert np.allclose(to_array(sc.gaussian_smooth(to_cells(a=a), 1.0))[0], want)
    with pytest.raises(Exception, match="shorter than the filter"):
        sc.gaussian_smooth(to_cells(a=a[:3]), 1.0).collect()


def test_detail_energy_matches_a_full_transform(to_cells):
    for shape in ((1, 8, 9), (5, 6, 7), (1, 1, 12)):
        a = np.random.default_rng(5).random(shape)
        sq = a[tuple(slice(None) if n > 1 else 0 for n in shape)]
        power = np.abs(np.fft.fftn(sq - sq.mean())) ** 2
        r = np.sqrt(sum(f**2 for f in np.meshgrid(*[np.fft.fftfreq(n) for n in sq.shape], indexing="ij")))
        want = power[r > 0.25 * r.max()].sum() / (power.sum() + 1e-12)
        assert spectral.detail_energy(to_cells(a=a)).first().detail_energy == pytest.approx(want, abs=1e-9)


def test_constant_image_has_no_detail(to_cells):
    assert spectral.detail_energy(to_cells(a=np.full((6, 6), 3.0))).first().detail_energy == pytest.approx(0)


def test_kernel_crop_and_collapse(spark):
    w = np.exp(-0.5 * (np.arange(-10, 11) / 3.0) ** 2)
    k = spark.createDataFrame([("k", i - 10, 0, 0, float(v / w.sum())) for i, v in enumerate(w)],
                              "kid string, dz int, dy int, dx int, w double")
    kept = sorted(r.dz for r in kn.kernel_crop_support(k, 0.9, 3, 15).collect())
    total, r = w[10], 0
    while total < 0.9 * w.sum():
        r += 1
        total += w[10 - r] + w[10 + r]
    assert kept == list(range(-r, r + 1))
    assert kn.kernel_collapse_z(k, "strong").agg(F.sum("w")).first()[0] == pytest.approx(1)


def test_sparse_hessian_leaves_out_any_axis_of_length_one(to_cells, to_array):
    a = np.round(np.random.default_rng(8).gamma(1.0, 4.0, (5, 6)), 2)
    flat = to_cells(a=a)
    want = sc.sparse_hessian_penalty(flat).first().penalty
    grad = to_array(sc.sparse_hessian_gradient(flat), "g")[0]
    assert want > 0 and not np.allclose(grad, 0)
    for shape in ((5, 1, 6), (5, 6, 1)):
        stack = to_cells(a=a.reshape(shape))
        assert np.isclose(sc.sparse_hessian_penalty(stack).first().penalty, want)
        assert np.allclose(to_array(sc.sparse_hessian_gradient(stack), "g"), grad.reshape(shape))


@pytest.mark.parametrize("shape", [(1, 7, 9), (3, 8, 5), (1, 1, 6), (4, 6, 1)])
def test_high_band_share_is_that_of_the_whole_transform(to_cells, shape):
    a = np.random.default_rng(9).normal(size=shape)
    power = np.abs(np.fft.fftn(a)) ** 2
    freq = np.meshgrid(*[np.fft.fftfreq(n) for n in shape], indexing="ij")
    top = np.sqrt(sum((n // 2 / n) ** 2 for n in shape))
    for cut in (0.25, 0.9):
        want = power[np.sqrt(sum(f * f for f in freq)) > cut * top].sum() / (power.sum() + 1e-12)
        got = spectral.high_band_share(to_cells(a=a), cut).first().share
        assert np.isclose(got, want, atol=1e-9)
