"""Blurring a block by one Fourier transform.  Imports nothing but NumPy, so it travels by value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def pack(dz: np.ndarray, dy: np.ndarray, dx: np.ndarray, w: np.ndarray, image: Sequence[int]) -> tuple[np.ndarray, list[int]]:
    """Offsets and weights as a block that sums to one, and its lowest offsets.

    An axis longer than the image is cropped around its middle, which becomes
    offset zero again.
    """
    low = [int(o.min()) for o in (dz, dy, dx)]
    block = np.zeros([int(o.max()) - lo + 1 for o, lo in zip((dz, dy, dx), low)])
    np.add.at(block, tuple(o - lo for o, lo in zip((dz, dy, dx), low)), w)
    for axis, n in enumerate(image):
        size = block.shape[axis]
        if size > n:
            cut = (size - n) // 2
            block = np.take(block, range(cut, cut + n), axis=axis)
            low[axis] = -(n // 2)
    # offset zero belongs to the block even where it has no weight: the image is then part of its dilation
    block = np.pad(block, [(max(lo, 0), max(-(lo + n - 1), 0)) for lo, n in zip(low, block.shape)])
    return np.ascontiguousarray(block / block.sum()), [min(lo, 0) for lo in low]


def blurs(kernel: np.ndarray, low: Sequence[int], shape: Sequence[int]) -> tuple[Callable, Callable]:
    """Forward and adjoint blur of blocks of ``shape``, zero beyond them."""
    size = [n + k - 1 for n, k in zip(shape, kernel.shape)]
    axes = tuple(range(len(size)))
    spectrum = np.fft.rfftn(kernel, size, axes)
    high = [k - 1 + lo for k, lo in zip(kernel.shape, low)]

    def part(values: np.ndarray, spectrum: np.ndarray, first: Sequence[int]) -> np.ndarray:
        """Entries from ``first`` on of the linear convolution; those outside its range are zero."""
        whole = np.fft.irfftn(np.fft.rfftn(values, size, axes) * spectrum, size, axes)
        out = np.zeros(shape)
        come = tuple(slice(max(f, 0), min(f + n, s)) for f, n, s in zip(first, shape, size))
        to = tuple(slice(c.start - f, c.stop - f) for c, f in zip(come, first))
        if all(c.stop > c.start for c in come):
            out[to] = whole[come]
        return out

    mirrored = np.fft.rfftn(kernel[::-1, ::-1, ::-1], size, axes)
    return (lambda x: part(x, spectrum, [-lo for lo in low])), (lambda r: part(r, mirrored, high))


def advance(
    at: tuple[np.ndarray, ...], d: np.ndarray, xp: np.ndarray, xc: np.ndarray, bg: float, sigma: float,
    kernel: np.ndarray, low: Sequence[int], momentum: Sequence[float], damping: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several updates of a block with its rim: previous, current and re-blurred values in row order."""
    origin = [int(i.min()) for i in at]
    pos = tuple(i - o for i, o in zip(at, origin))
    shape = [int(i.max()) + 1 for i in pos]

    def dense(values: np.ndarray) -> np.ndarray:
        out = np.zeros(shape)
        out[pos] = values
        return out

    forward, adjoint = blurs(kernel, low, shape)
    have, seen = dense(np.ones(len(d))) > 0, dense(~np.isnan(d) * 1.0) > 0
    observed, cur, prev = dense(np.nan_to_num(d)), dense(xc), dense(xp)
    mass = adjoint(seen * 1.0)
    weight = np.where(mass > 0.01, 1.0 / np.where(mass > 0.01, mass, 1.0), 0.0)
    for alpha in momentum:
        p = np.where(have, np.maximum(cur + alpha * (cur - prev), bg), 0.0)
        ratio = np.where(seen, observed / np.maximum(forward(p), bg), 0.0)
        corr = adjoint(ratio)
        if damping > 0:
            gamma = 1 - np.exp(-np.maximum(p - bg, 0) / max(damping * sigma, 1e-12))
            corr = np.maximum(corr, 1e-12) ** np.clip(gamma, 1e-3, 1.0)
        prev, cur = cur, np.where(have, np.maximum(p * corr * weight, bg), 0.0)
    return prev[pos], cur[pos], forward(cur)[pos]
