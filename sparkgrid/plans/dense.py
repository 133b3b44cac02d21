"""Numeric step for one dense tile, run inside grouped-map tasks.

The same updates as the column plan, written for a NumPy block whose size is
bounded by the tile grid.  Kept to the loop itself; everything around it
(halo, background of other tiles, blending) is relational.  Imports nothing
but NumPy, so it can be shipped to executors by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Job:
    """Plain settings of a tile run, resolved on the driver."""

    kernel: np.ndarray
    momentum: list[float]
    offset: float
    background: float | None
    damping: float
    start: str
    auto_stop: bool
    earliest_stop: int
    rel_threshold: float
    check_every: int
    prefilter: list[float] | None
    lowpass: list[float]
    tv_lambda: float
    z_scale: float
    sparse: tuple[float, float] | None


def lower_median(values: np.ndarray) -> float:
    return float(np.partition(values, (values.size - 1) // 2)[(values.size - 1) // 2])


def lowest(values: np.ndarray, frac: float) -> np.ndarray:
    n = max(int(values.size * frac), 1)
    return np.partition(values.ravel(), n - 1)[:n]


def fast_size(n: int) -> int:
    """Next size made of factors 2, 3 and 5."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def tv(x: np.ndarray, lam: float, scales: list[float]) -> np.ndarray:
    diffs = [np.diff(x, axis=a, prepend=np.take(x, [0], axis=a)) * s for a, s in enumerate(scales)]
    norm = np.sqrt(sum(g * g for g in diffs) + 1e-8)
    div = 0.0
    for a, (g, s) in enumerate(zip(diffs, scales)):
        n = g / norm
        div = div - np.diff(n, axis=a, append=np.take(n, [-1], axis=a)) * s
    return np.clip(1.0 / (1.0 - lam * div), 0.1, 10.0)


def smooth(a: np.ndarray, weights: list[float]) -> np.ndarray:
    w = np.array(weights)
    r = w.size // 2
    for ax in range(a.ndim):
        if a.shape[ax] > 1:
            wide = np.moveaxis(np.pad(a, [(r, r) if i == ax else (0, 0) for i in range(a.ndim)], mode="reflect"), ax, -1)
            a = np.moveaxis(np.lib.stride_tricks.sliding_window_view(wide, w.size, axis=-1) @ w, -1, ax)
    return a


def hessian_gradient(x: np.ndarray, w: float, z_scale: float) -> np.ndarray:
    """Gradient of the mean sparse-Hessian penalty of a (z, y, x) block."""
    flat = x.shape[0] == 1
    if x.shape[1] < 3 or x.shape[2] < 3 or (not flat and x.shape[0] < 3):
        return np.zeros_like(x)

    def at(dz: int, dy: int, dx: int) -> tuple[slice, ...]:
        z = slice(None) if flat else slice(1 + dz, x.shape[0] - 1 + dz)
        return z, slice(1 + dy, x.shape[1] - 1 + dy), slice(1 + dx, x.shape[2] - 1 + dx)

    centre = (0, 0, 0)
    units = [((0, 0, 1), 1.0), ((0, 1, 0), 1.0)] + ([] if flat else [((1, 0, 0), z_scale)])
    second = [(u, s * s * (2 * x[at(*centre)] - x[at(*u)] - x[at(*(-i for i in u))]), s * s) for u, s in units]
    pairs = [(a, b, sa * sb) for i, (a, sa) in enumerate(units) for b, sb in units[i + 1:]]
    both = lambda a, b: tuple(i + j for i, j in zip(a, b))
    mixed = [(a, b, s * (x[at(*both(a, b))] - x[at(*a)] - x[at(*b)] + x[at(*centre)]), s) for a, b, s in pairs]
    hv = w * w * (sum(d * d for _, d, _ in second) + 2 * sum(d * d for _, _, d, _ in mixed))
    core = x[at(*centre)]
    f = np.sqrt(hv + ((1 - w) * core) ** 2 + 1e-8) * core.size
    g = np.zeros_like(x)
    g[at(*centre)] += (1 - w) ** 2 * core / f
    for u, d, s in second:
        part = w * w * d * s / f
        g[at(*centre)] += 2 * part
        g[at(*u)] -= part
        g[at(*(-i for i in u))] -= part
    for a, b, d, s in mixed:
        part = 2 * w * w * d * s / f
        g[at(*centre)] += part
        g[at(*both(a, b))] += part
        g[at(*a)] -= part
        g[at(*b)] -= part
    return g


def solve(image: np.ndarray, job: Job):
    """Restored block, last divergence and iterations used."""
    kernel = job.kernel
    bg = max(lower_median(lowest(image, 0.1)) if job.background is None else job.background, 1e-6) + job.offset
    d = image + job.offset
    if job.prefilter is not None:
        d = np.maximum((smooth(2 * np.sqrt(np.maximum(d, 0) + 0.375), job.prefilter) / 2) ** 2 - 0.375, 0)
    if job.damping > 0:
        low = lowest(d, 0.25)
        sigma = max(1.4826 * lower_median(np.abs(low - lower_median(low))), 1e-12)
    box = [n + k - 1 for n, k in zip(d.shape, kernel.shape)]
    # the total-variation factor depends on the circular box, so keep its size
    size = box if job.tv_lambda > 0 else [fast_size(n) for n in box]
    axes = tuple(range(d.ndim))
    pad = np.zeros(size)
    pad[tuple(slice(0, k) for k in kernel.shape)] = kernel / kernel.sum()
    pad = np.roll(pad, [-(k // 2) for k in kernel.shape], axes)
    otf = np.fft.rfftn(pad)
    inner = tuple(slice(0, n) for n in d.shape)
    conv = lambda a, h: np.fft.irfftn(np.fft.rfftn(a) * h, size, axes)
    ones = np.zeros(size)
    ones[inner] = 1.0
    mass = conv(ones, otf.conj())
    weight = np.where(mass > 0.01, 1.0 / np.where(mass > 0.01, mass, 1.0), 0.0)
    x = np.full(size, max(float(d.mean()), bg) if job.start == "flat" else bg)
    if job.start == "observed":
        x[inner] = d
    elif job.start == "lowpass":
        x[inner] = np.maximum(smooth(d, job.lowpass), bg)
    prev, metrics, used = x, [], len(job.momentum)
    for k, alpha in enumerate(job.momentum, start=1):
        p = np.maximum(x + alpha * (x - prev), bg)
        r = np.zeros(size)
        r[inner] = d / np.maximum(conv(p, otf)[inner], bg)
        corr = conv(r, otf.conj())
        if job.damping > 0:
            gamma = 1 - np.exp(-np.maximum(p - bg, 0) / max(job.damping * sigma, 1e-12))
            corr = np.maximum(corr, 1e-12) ** np.clip(gamma, 1e-3, 1.0)
        new = p * corr * weight
        if job.tv_lambda > 0:
            new = new * tv(new, job.tv_lambda, [job.z_scale, 1.0, 1.0])
        new = np.maximum(new, bg)
        if job.sparse is not None:
            g = hessian_gradient(new[inner], job.sparse[0], job.z_scale)
            step = 0.1 * max(1.0 - job.sparse[1], 0.0) * max(float(new[inner].mean()) - bg, 1.0)
            new[inner] = np.maximum(new[inner] - step * g / max(float(np.abs(g).mean()), 1e-12), bg)
        prev, x = x, new
        if k % job.check_every == 0 or k == len(job.momentum):
            e = np.maximum(np.maximum(conv(x, otf)[inner], bg), 1e-12)
            o = np.maximum(d, 1e-12)
            metrics.append(float(np.mean(o * np.log(o / e) - o + e)))
            if job.auto_stop and len(metrics) > 1 and k > job.earliest_stop and metrics[-2] > 0:
                if (metrics[-2] - metrics[-1]) / metrics[-2] < job.rel_threshold:
                    used = k
                    break
    return np.maximum(x[inner] - job.offset, 0.0), metrics[-1], used


def shift_sum(a: np.ndarray, taps: list[tuple[int, int, int, float]], sign: int) -> np.ndarray:
    """``out[j] = sum w a[j - sign * o]`` with zeros beyond the block."""
    out = np.zeros_like(a)
    for *offset, w in taps:
        to, come = [], []
        for o, n in zip(offset, a.shape):
            o *= sign
            to.append(slice(max(o, 0), n + min(o, 0)))
            come.append(slice(max(-o, 0), n + min(-o, 0)))
        if all(s.start < s.stop for s in to):
            out[tuple(to)] += w * a[tuple(come)]
    return out


def advance(
    at: tuple[np.ndarray, np.ndarray, np.ndarray], d: np.ndarray, xp: np.ndarray, xc: np.ndarray,
    bg: float, sigma: float, taps: list[tuple[int, int, int, float]], momentum: list[float], damping: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several updates of one block with its halo.

    Values nearer to the rim than the halo needs are not exact; callers keep
    the cells of the block itself.  Returns previous, current and re-blurred
    current values in row order.
    """
    low = [int(i.min()) for i in at]
    pos = tuple(i - o for i, o in zip(at, low))
    shape = [int(i.max()) + 1 for i in pos]
    dense = lambda values: _fill(shape, pos, values)
    have, seen = dense(np.ones(len(d))) > 0, dense(~np.isnan(d) * 1.0) > 0
    obs, cur, prev = dense(np.nan_to_num(d)), dense(xc), dense(xp)
    mass = shift_sum(seen * 1.0, taps, -1)
    weight = np.where(mass > 0.01, 1.0 / np.where(mass > 0.01, mass, 1.0), 0.0)
    for alpha in momentum:
        p = np.where(have, np.maximum(cur + alpha * (cur - prev), bg), 0.0)
        ratio = np.where(seen, obs / np.maximum(shift_sum(p, taps, 1), bg), 0.0)
        corr = shift_sum(ratio, taps, -1)
        if damping > 0:
            gamma = 1 - np.exp(-np.maximum(p - bg, 0) / max(damping * sigma, 1e-12))
            corr = np.maximum(corr, 1e-12) ** np.clip(gamma, 1e-3, 1.0)
        prev, cur = cur, np.where(have, np.maximum(p * corr * weight, bg), 0.0)
    return prev[pos], cur[pos], shift_sum(cur, taps, 1)[pos]


def _fill(shape: list[int], pos: tuple[np.ndarray, ...], values: np.ndarray) -> np.ndarray:
    out = np.zeros(shape)
    out[pos] = values
    return out
