import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.catalog.kernels import K35
from sparkgrid.catalog.restoration import taps_block
from sparkgrid.operators import kernel as kn, tiles as tl
from sparkgrid.plans import batch, restore as rs, tiled

K = kn.separable([1.0], [1, 2, 1], [1, 3, 2, 1])
K3 = kn.separable([1, 2, 1], [1, 2, 1], [1, 2, 1])


def blurred(shape, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.gamma(1.0, 4.0, shape)
    a[tuple(n // 2 for n in shape)] += 60
    return np.round(a, 2)


def spectral_rl(image, taps, niter, bg, offset=5.0, tv=0.0, every=5):
    """The published loop on the circular work box, by transforms."""
    nd = image.ndim
    taps = [t[3 - nd:] for t in taps]
    lo = [min(t[i] for t in taps) for i in range(nd)]
    size = [max(t[i] for t in taps) - lo[i] + 1 for i in range(nd)]
    box = [n + k - 1 for n, k in zip(image.shape, size)]
    psf = np.zeros(box)
    for *o, w in taps:
        psf[tuple(i % n for i, n in zip(o, box))] = w
    H = np.fft.fftn(psf)
    conv = lambda a, h: np.fft.ifftn(np.fft.fftn(a) * h).real
    d, bg = image + offset, bg + offset
    s = tuple(slice(0, n) for n in image.shape)
    ones = np.zeros(box)
    ones[s] = 1
    m = conv(ones, H.conj())
    W = np.where(m > 0.01, 1 / np.where(m > 0.01, m, 1), 0)
    x = prev = np.full(box, max(d.mean(), bg))
    hist = []
    for k in range(1, niter + 1):
        a = 0 if k < 3 else min((k - 1) / (k + 2), 1 - 2 / np.sqrt(k + 3))
        p = np.maximum(x + a * (x - prev), bg)
        r = np.zeros(box)
        r[s] = d / np.maximum(conv(p, H)[s], bg)
        new = p * conv(r, H.conj()) * W
        if tv:
            g = []
            for ax in range(nd):
                q = np.zeros(box)
                q[(slice(None),) * ax + (slice(1, None),)] = np.diff(new, axis=ax)
                g.append(q)
            mag = np.sqrt(sum(q * q for q in g) + 1e-8)
            div = np.zeros(box)
            for ax in range(nd):
                div[(slice(None),) * ax + (slice(0, -1),)] -= np.diff(g[ax] / mag, axis=ax)
            new = new * np.clip(1 / (1 - tv * div), 0.1, 10)
        prev, x = x, np.maximum(new, bg)
        if k % every == 0 or k == niter:
            e = np.maximum(conv(x, H)[s], bg)
            hist.append(np.mean(d * np.log(d / e) - d + e))
    return np.maximum(x[s] - offset, 0), hist


@pytest.mark.parametrize("engine", ["columns", "blocks"])
def test_rl_matches_the_transform_form(to_cells, to_array, engine):
    a = blurred((9, 11))
    r = rs.richardson_lucy(to_cells(a=a), K, niter=6, background=1.0, block=4, dense_block=4, engine=engine, check_every=3)
    want, hist = spectral_rl(a, K, 6, 1.0, every=3)
    assert np.allclose(to_array(r.cells)[0], want, atol=1e-8)
    assert np.allclose([h.metric for h in r.history.orderBy("iter").collect()], hist)


@pytest.mark.parametrize("engine", ["columns", "blocks"])
def test_rl_3d(to_cells, to_array, engine):
    a = blurred((4, 6, 5))
    r = rs.richardson_lucy(to_cells(a=a), K3, niter=3, background=1.0, engine=engine, track=False, dense_block=4)
    assert np.allclose(to_array(r.cells), spectral_rl(a, K3, 3, 1.0)[0], atol=1e-8)


def test_tv_uses_storage_order(to_cells, to_array):
    a = blurred((7, 8))
    r = rs.richardson_lucy_tv(to_cells(a=a), K, 0.1, niter=3, background=1.0, track=False)
    assert np.allclose(to_array(r.cells)[0], spectral_rl(a, K, 3, 1.0, tv=0.1)[0], atol=1e-8)


def test_tiles_match_columns_for_one_tile_with_damping_and_prefilter(spark, to_cells, to_array):
    a = blurred((12, 14), 3)
    cells = to_cells(a=a)
    grid = spark.createDataFrame([("a", 12, 14, 1, 1)], "img string, h int, w int, ny int, nx int")
    opts = dict(niter=3, damping="auto", prefilter_sigma=0.6, start="observed")
    t = tiled.restore_tiled(cells, taps_block(K), grid, **opts)
    c = rs.richardson_lucy(cells, K, track=False, **opts)
    assert np.allclose(to_array(t.cells), to_array(c.cells), atol=1e-8)


def test_tiles_smaller_than_the_kernel_fall_back(spark, to_cells):
    cells = to_cells(a=blurred((8, 8)))
    grid = spark.createDataFrame([("a", 8, 8, 4, 4)], "img string, h int, w int, ny int, nx int")
    r = tiled.restore_tiled(cells, taps_block(K), grid, niter=2)
    assert r.cells.count() == 64 and r.cells.filter("v < 0").isEmpty()


def test_blending_equal_tiles_is_identity(spark, to_cells, to_array):
    a = blurred((20, 23))
    cells = to_cells(a=a)
    grid = spark.createDataFrame([("a", 20, 23, 3, 2)], "img string, h int, w int, ny int, nx int")
    parts = tl.assign_halo(cells, grid, 3, 2).drop("h", "w", "ny", "nx")
    assert np.allclose(to_array(tl.blend_tiles(parts, grid, 3))[0], a)


@pytest.mark.parametrize("engine", ["columns", "blocks"])
def test_images_stop_on_their_own(to_cells, engine):
    flat, busy = np.full((6, 6), 9.0), blurred((6, 6), 5) * 4
    r = rs.richardson_lucy(to_cells(flat=flat, busy=busy), K, niter=16, check_every=4, rel_threshold=0.02, engine=engine)
    used = {x.img: x.iterations for x in r.used.collect()}
    per = {}
    for h in r.history.orderBy("iter").collect():
        per.setdefault(h.img, []).append((h.iter, h.metric))
    for img, hist in per.items():
        want = 16
        for (_, b), (k, m) in zip(hist, hist[1:]):
            if k > 10 and b > 0 and (b - m) / b < 0.02:
                want = k
                break
        assert used[img] == want
        assert hist[-1][0] == want


def test_sparse_objective_starts_near_one_and_cells_stay_positive(to_cells):
    # dim images, where the likelihood without constants is positive
    dim = np.random.default_rng(0).uniform(0.5, 1.5, (7, 7))
    r = rs.sparse_hessian_deconvolve(to_cells(a=dim), K, volume=False, niter=2, offset=0)
    assert r.cells.filter("v < 0").isEmpty()
    assert 0 < r.history.first().metric < 2


def test_dispatch_checks_names_and_crops_kernels(to_cells):
    cells = to_cells(a=blurred((5, 6)))
    with pytest.raises(ValueError, match="unknown method"):
        batch.restore_dispatch(cells, K, "wiener")
    assert batch.restore_dispatch(cells, K3, "rl", shape=(1, 5, 6), niter=1, track=False, tv_lambda=9).cells.count() == 30
    assert [t[0] for t in batch.crop_taps(K3, (1, 5, 6))] == [0] * 9


def test_constant_image_is_a_fixed_point_inside(to_cells, to_array):
    r = rs.richardson_lucy(to_cells(a=np.full((9, 9), 4.0)), K, niter=3, track=False)
    assert np.allclose(to_array(r.cells), 4.0, atol=1e-6)


def test_best_grid_prefers_square_tiles(spark):
    df = spark.createDataFrame([("a", 100, 300, 6), ("b", 7, 7, 1)], "img string, h int, w int, n int")
    got = {r.img: (r.ny, r.nx) for r in tl.best_tile_grid(df).collect()}
    # 1 x 6 tiles are 100 x 50, 2 x 3 tiles 50 x 100: equally square, the first wins
    assert got == {"a": (1, 6), "b": (1, 1)}


def test_tile_grid_matches_tiles_solved_one_by_one(spark, to_cells, to_array):
    a = blurred((30, 33), 7)
    ny, nx, overlap, margin = 2, 3, 2, 4
    num, den = np.zeros_like(a), np.zeros_like(a)
    for iy in range(ny):
        for ix in range(nx):
            core = [(round(i * n / k), round((i + 1) * n / k)) for i, n, k in ((iy, 30, ny), (ix, 33, nx))]
            ext = [(max(lo - overlap, 0), min(hi + overlap, n)) for (lo, hi), n in zip(core, a.shape)]
            far = [(max(lo - margin, 0), min(hi + margin, n)) for (lo, hi), n in zip(ext, a.shape)]
            part = a[far[0][0]: far[0][1], far[1][0]: far[1][1]]
            low = np.sort(part.ravel())[: max(int(part.size * 0.1), 1)]
            done, _ = spectral_rl(part, K, 3, max(low[(len(low) - 1) // 2], 1e-6))
            weight = 1.0
            for ax, ((c0, c1), (e0, e1)) in enumerate(zip(core, ext)):
                w = np.ones(e1 - e0)
                if c0 > e0:
                    w[: c0 - e0] *= np.linspace(0, 1, c0 - e0 + 1)[1:]
                if e1 > c1:
                    w[c1 - e0:] *= np.linspace(1, 0, e1 - c1 + 1)[:-1]
                weight = weight * (w[:, None] if ax == 0 else w[None, :])
            at = tuple(slice(lo, hi) for lo, hi in ext)
            cut = tuple(slice(e0 - f0, e1 - f0) for (e0, e1), (f0, _) in zip(ext, far))
            num[at] += weight * done[cut]
            den[at] += weight
    grid = spark.createDataFrame([("a", 30, 33, ny, nx)], "img string, h int, w int, ny int, nx int")
    got = to_array(tiled.restore_tiled(to_cells(a=a), taps_block(K), grid, niter=3, margin=margin).cells)[0]
    assert np.allclose(got, num / den, atol=1e-8)


def test_preset_wires_kernel_background_damping_and_offset(spark, to_cells, to_array):
    cells = to_cells(a=blurred((9, 10), 9))
    g = [np.exp(-0.5 * i * i) for i in (-1, 0, 1)]
    z = [np.exp(-0.5 * (i / 4) ** 2) for i in range(-10, 11)]
    k3 = spark.createDataFrame([("k", *map(float, t)) for t in kn.separable(z, g, g)],
                               "kid string, dz double, dy double, dx double, w double").select(
        "kid", *[F.col(c).cast("int").alias(c) for c in ("dz", "dy", "dx")], "w")
    got = rs.restore_2d_preset(cells, k3, "strong", radius=2, niter=2, track=False)
    want = rs.richardson_lucy(
        cells, kn.separable([1.0], g, g), niter=2, track=False, damping=1.0, offset=1.5,
        background=rs.preset_background(cells, 2, 0.9))
    assert np.allclose(to_array(got.cells), to_array(want.cells), atol=1e-8)


def test_benchmark_reports_each_method(spark, to_cells):
    df = batch.benchmark_methods(spark, to_cells(a=blurred((6, 6))), K, niter=1, methods=["rl"], track=False)
    row = df.first().asDict()
    assert row["label"] == "rl_1i" and row["channels_compared"] == 1 and row["time_s"] > 0


def test_benchmark_raises_the_error_of_a_failing_method(spark, to_cells, monkeypatch):
    """The table lacked the method's row and looked whole."""
    def fails(cells, taps, **params):
        raise ArithmeticError("no update")

    monkeypatch.setitem(batch.METHODS, "rl_tv", (fails, set(), 8))
    with pytest.raises(ArithmeticError) as caught:
        batch.benchmark_methods(spark, to_cells(a=blurred((6, 6))), K, niter=1, methods=["rl", "rl_tv"], quality=False, track=False)
    assert "rl_tv" in caught.value.__notes__[0]


def test_sparse_updates_leave_no_copies_behind(to_cells, monkeypatch):
    """Both full-size tables of an update go once the next state is saved."""
    written, removed = [], []
    write, drop = rs.write_aside, rs.discard
    monkeypatch.setattr(rs, "write_aside", lambda df: (out := write(df), written.append(out[1]))[0])
    monkeypatch.setattr(rs, "discard", lambda spark, path: (drop(spark, path), removed.append(path)))
    cells = to_cells(i=np.random.default_rng(2).poisson(9, (5, 7)).astype(float))
    out = rs.sparse_hessian_deconvolve(cells, K35, volume=False, niter=2, track=False, checkpoint_every=1)
    assert out.cells.count() == 35 and len(written) == 6 and len(removed) == 4


def test_short_runs_are_dense_blocks(to_cells, monkeypatch):
    """Fewer updates than a check apart: one exchange for all of them, the cells of the column plan."""
    legs = []
    steps = rs.block_steps
    monkeypatch.setattr(rs, "block_steps", lambda *a: legs.append(a[2]) or steps(*a))
    cells = to_cells(a=blurred((20, 70)), b=blurred((4, 6, 5)))
    run = lambda **o: rs.richardson_lucy(cells, K3, niter=3, track=False, **o).cells.orderBy("img", "z", "y", "x").toPandas()
    blocks, columns = run(dense_block=16), run(engine="columns")
    assert legs == [3] and len(blocks) == len(columns) and np.allclose(blocks["v"], columns["v"])


@pytest.mark.parametrize("method,own", [("rl_tv", {"tv_lambda": 0.05}), ("sparse_hessian", {"weight": 0.6, "reg": 0.9})])
def test_small_images_are_solved_whole(to_cells, monkeypatch, method, own):
    """Images up to a block in one task, larger ones by columns: the cells are those of columns alone."""
    from sparkgrid.plans import batch, tiled

    solved = []
    whole = tiled.restore_tiled
    monkeypatch.setattr(tiled, "restore_tiled", lambda *a, **o: solved.append(1) or whole(*a, **o))
    cells = to_cells(a=blurred((9, 11)), b=blurred((20, 23), 2), d=blurred((3, 6, 5), 3))
    run = lambda **o: batch.restore_dispatch(cells, K3, method, niter=3, track=False, **own, **o).cells.orderBy("img", "z", "y", "x").toPandas()
    some, none = run(dense_block=10), run(engine="columns")
    assert solved == [1] and len(some) == len(none) and np.allclose(some["v"], none["v"])
