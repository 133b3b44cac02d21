import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.operators import kernel as kn
from sparkgrid.plans import fourier, keyed, restore as rs, routing, tiled
from tests.test_restoration import K, K3, blurred, spectral_rl

KERNEL = "dz int, dy int, dx int, w double"


def gaussian(size, sigma):
    return [float(np.exp(-0.5 * ((i - size // 2) / sigma) ** 2)) for i in range(size)]


@pytest.fixture(scope="module")
def table(spark):
    def make(taps, **more):
        return spark.createDataFrame([tuple(t) for t in taps], KERNEL).withColumns({k: F.lit(v) for k, v in more.items()})
    return make


def of(result, to_array, img):
    return to_array(result.cells.filter(F.col("img") == img))


@pytest.mark.parametrize("shape,taps", [((9, 11), K), ((4, 6, 5), K3), ((7, 8), [(0, 0, 0, 0.5), (0, 0, 2, 0.2), (0, 1, 3, 0.3)])])
def test_blocks_match_the_transform_form(to_cells, to_array, table, shape, taps):
    a = blurred(shape)
    r = keyed.restore_each(to_cells(a=a), table(taps), [], niter=6, background=1.0, dense_block=4, check_every=3)
    want, hist = spectral_rl(a, taps, 6, 1.0, every=3)
    got = to_array(r.cells)
    assert np.allclose(got if a.ndim == 3 else got[0], want, atol=1e-8)
    assert np.allclose([h.metric for h in r.history.orderBy("iter").collect()], hist)


def test_a_kernel_of_default_size(to_cells, to_array, table):
    """65 x 65 on an image larger than it: several blocks, one Fourier transform each."""
    a = blurred((70, 72), 5)
    taps = kn.separable([1.0], gaussian(65, 6.0), gaussian(65, 5.0))
    r = keyed.restore_each(to_cells(a=a), table(taps), [], niter=2, background=1.0, track=False, dense_block=48)
    assert np.allclose(to_array(r.cells)[0], spectral_rl(a, taps, 2, 1.0)[0], atol=1e-6)


def test_a_preset_with_a_3d_kernel_of_default_size(to_cells, to_array, table):
    a = blurred((66, 67), 6)
    wz, wy, wx = gaussian(21, 4.0), gaussian(65, 3.0), gaussian(65, 4.0)
    cells = to_cells(a=a)
    r = rs.restore_2d_preset(cells, table(kn.separable(wz, wy, wx), kid="k"), "strong", 3, damping=0.0, niter=2, track=False)
    _, offset, factor = rs.PRESETS["strong"]
    bg = rs.preset_background(cells, 3, factor).first().background
    want = spectral_rl(a, kn.separable([1.0], wy, wx), 2, bg, offset=offset)[0]
    assert np.allclose(to_array(r.cells)[0], want, atol=1e-6)


def test_kernels_and_parameters_per_image(spark, to_cells, to_array, table):
    a, b = blurred((8, 9)), blurred((6, 7), 2)
    kernels = table(K, img="a").unionByName(table([(0, 0, 0, 1.0), (0, 0, 1, 1.0)], img="b"))
    params = spark.createDataFrame([("a", 2, 1.0), ("b", 4, 0.5)], "img string, niter int, background double")
    r = keyed.restore_each(to_cells(a=a, b=b), kernels, ["img"], params, dense_block=4)
    assert np.allclose(of(r, to_array, "a")[0], spectral_rl(a, K, 2, 1.0)[0], atol=1e-8)
    assert np.allclose(of(r, to_array, "b")[0], spectral_rl(b, [(0, 0, 0, 0.5), (0, 0, 1, 0.5)], 4, 0.5)[0], atol=1e-8)
    assert {(u.img, u.iterations) for u in r.used.collect()} == {("a", 2), ("b", 4)}


def test_images_stop_on_their_own_and_are_read_no_more(to_cells, to_array, table, monkeypatch):
    """One image stops early; the legs after that move the other one only."""
    rough, smooth = blurred((10, 10), 7) * 20, np.add.outer(np.linspace(5, 30, 10), np.linspace(0, 9, 10))
    sent = []
    plain = keyed.keyed_steps
    monkeypatch.setattr(keyed, "keyed_steps", lambda state, *a: sent.append(state.count()) or plain(state, *a))
    r = keyed.restore_each(to_cells(rough=rough, smooth=smooth), table(K), [], niter=20, background=1.0, check_every=4, rel_threshold=0.02)
    used = {u.img: u.iterations for u in r.used.collect()}
    want = {u.img: u.iterations for u in rs.richardson_lucy(
        to_cells(rough=rough, smooth=smooth), K, niter=20, background=1.0, check_every=4, rel_threshold=0.02, engine="blocks").used.collect()}
    assert used == want == {"rough": 16, "smooth": 20} and 2 * sent[-1] == sent[0]
    assert np.allclose(of(r, to_array, "rough")[0], spectral_rl(rough, K, 16, 1.0)[0], atol=1e-7)
    assert np.allclose(of(r, to_array, "smooth")[0], spectral_rl(smooth, K, 20, 1.0)[0], atol=1e-7)


def test_several_kernels_are_not_mixed(spark, to_cells, table):
    two = table(K, kid="p").unionByName(table(K, kid="q"))
    with pytest.raises(ValueError, match="several kernels"):
        tiled.kernel_array(two)
    with pytest.raises(ValueError, match="several kernels"):
        keyed.restore_each(to_cells(a=blurred((5, 5))), two, [], niter=1)
    with pytest.raises(Exception, match="no kernel for image"):
        keyed.restore_each(to_cells(a=blurred((5, 5))), table(K, c=3), ["c"], niter=1).cells.count()


def test_pack_crops_around_the_middle():
    dz, dy, dx = (np.array(v) for v in zip(*[(0, y, x) for y in range(-2, 3) for x in range(-3, 4)]))
    block, low = fourier.pack(dz, dy, dx, np.ones(len(dz)), [1, 3, 4])
    assert block.shape == (1, 3, 4) and low == [0, -1, -2] and np.isclose(block.sum(), 1)


def test_coarser_grids_keep_tiles_as_large_as_the_kernel(spark):
    grids = spark.createDataFrame([("a", 100, 40, 10, 10), ("b", 5, 5, 2, 2)], "img string, h int, w int, ny int, nx int")
    got = {r.img: (r.ny, r.nx) for r in routing.coarsened(grids, 16).collect()}
    assert got == {"a": (6, 2), "b": (1, 1)}


def test_routes(spark, to_cells, table):
    cells = to_cells(large=blurred((40, 6)), flat=blurred((6, 6)), stack=blurred((4, 6, 6)), tiny=blurred((2, 2)))
    modes = spark.createDataFrame([("flat", "WideField"), ("tiny", "confocal")], "img string, mode string")
    routes = routing.routing_table(cells, table(K3), [], modes, 20, short=True)
    assert {r.img: r.route for r in routes.collect()} == {"large": "tiles", "flat": "plane", "stack": "columns", "tiny": "blocks"}
    r = routing.restore_routed(cells, table(K3), modes=modes, tile_side=20, niter=2, radius=2, dense_block=16)
    n = {x.img: x["count"] for x in r.cells.groupBy("img").count().collect()}
    assert n == {"large": 240, "flat": 36, "stack": 144, "tiny": 4}
    assert {u.img for u in r.used.collect()} == set(n)


def test_large_tiles_run_in_blocks(spark, to_cells, monkeypatch):
    """Tiles above the limit give the cells, iterations and metrics of whole tiles."""
    from sparkgrid.plans import tiled as td

    rng = np.random.default_rng(3)
    cells = to_cells(a=rng.random((40, 30)) * 50 + 5)
    grid = spark.createDataFrame([("a", 40, 30, 2, 2)], "img string, h int, w int, ny int, nx int")
    kernel = np.zeros((1, 3, 5))
    kernel[0, :, :4] = rng.random((3, 4))
    run = lambda: td.restore_tiled(cells, kernel, grid, margin=4, niter=12, damping="auto", dense_block=16, track=False)
    whole = run()
    groups = []
    monkeypatch.setattr(td, "MAX_TILE", 100)
    monkeypatch.setattr(td.dense, "solve", lambda *_: groups.append(1))
    blocks = run()
    for part, order in (("cells", ["y", "x"]), ("history", ["iy", "ix"]), ("used", ["img"])):
        a, b = (getattr(r, part).orderBy(*order).toPandas() for r in (whole, blocks))
        assert list(a) == list(b) and len(a) == len(b)
        n = a.select_dtypes("number").columns
        assert np.allclose(a[n], b[n], rtol=1e-6)
    assert not groups


def test_an_image_about_as_large_as_a_block_is_one(to_cells, table, monkeypatch):
    """The work box of 24 x 30 cells is 26 x 34: one block of about 32 a side, four when cut at multiples of 32."""
    from sparkgrid.catalog.kernels import K35

    seen, steps = [], keyed.keyed_steps
    monkeypatch.setattr(keyed, "keyed_steps", lambda state, blocks, *rest: seen.append(blocks.count()) or steps(state, blocks, *rest))
    keyed.restore_each(to_cells(a=blurred((24, 30))), table(K35), [], niter=1, dense_block=32)
    assert seen == [1]
