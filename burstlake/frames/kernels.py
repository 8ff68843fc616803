"""Filters of one window of an image, each in constant time a pixel whatever its radius.

They return an array of the window's size.  What they give near the window's own border is not meant to be kept: a window
is laid out wide enough (see tiles.windowed) that its core is right.
"""

from __future__ import annotations

import math

import numpy as np

LUMA = (0.2126, 0.7152, 0.0722)


def _padded(a: np.ndarray, radius: int, axis: int, **how) -> np.ndarray:
    return np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in range(a.ndim)], **how)


def _part(a: np.ndarray, start: int, stop: int, axis: int) -> np.ndarray:
    return a[tuple(slice(start, stop) if k == axis else slice(None) for k in range(a.ndim))]


def box(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean of a square, by running sums along both axes."""
    for axis in range(a.ndim):
        n = a.shape[axis]
        sums = np.cumsum(_padded(a, radius, axis, mode="edge"), axis=axis)
        sums = np.concatenate([np.zeros_like(_part(sums, 0, 1, axis)), sums], axis=axis)
        a = (_part(sums, 2 * radius + 1, 2 * radius + 1 + n, axis) - _part(sums, 0, n, axis)) / (2 * radius + 1)
    return a


def extreme(a: np.ndarray, radius: int, most: bool) -> np.ndarray:
    """Largest (or smallest) value of a square: of blocks as long as the square, from both of their ends."""
    pick, size = (np.maximum, 2 * radius + 1) if most else (np.minimum, 2 * radius + 1)
    for axis in range(a.ndim):
        n = a.shape[axis]
        fill = -np.inf if most else np.inf
        blocks = -(-(n + 2 * radius) // size)
        wide = np.pad(a, [(radius, blocks * size - n - radius) if k == axis else (0, 0) for k in range(a.ndim)], constant_values=fill)
        split = np.moveaxis(wide, axis, 0).reshape(blocks, size, *np.delete(np.array(a.shape), axis))
        onward = pick.accumulate(split, axis=1).reshape(blocks * size, *split.shape[2:])
        back = pick.accumulate(split[:, ::-1], axis=1)[:, ::-1].reshape(blocks * size, *split.shape[2:])
        a = np.moveaxis(pick(back[:n], onward[size - 1 : size - 1 + n]), 0, axis)
    return a


def reach(sigma: float) -> int:
    """How far a Gaussian of this width is taken: four sigma."""
    return (round(sigma * 8 + 1) | 1) // 2


def bell(sigma: float) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-reach(sigma), reach(sigma) + 1) / sigma) ** 2)
    return k / k.sum()


def blur(a: np.ndarray, *sigmas: float) -> np.ndarray:
    """Gaussian blur, one width for each axis (the last one counts for all that follow); 0 leaves an axis alone."""
    for axis in range(a.ndim):
        sigma = sigmas[min(axis, len(sigmas) - 1)]
        if sigma:
            k, n = bell(sigma), a.shape[axis]
            wide = _padded(a, len(k) // 2, axis, mode="edge")
            a = sum(w * _part(wide, i, i + n, axis) for i, w in enumerate(k.tolist()))
    return a


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Indices outside 0..n-1 mirrored at the border without repeating the border cell."""
    i = np.abs(i) % max(1, 2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)


def mirrored_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Blur of a line, mirrored at its ends."""
    r = reach(sigma)
    return np.convolve(a[mirrored(np.arange(-r, len(a) + r), len(a))], bell(sigma), "valid")


def smooth(low: float, high: float, x: np.ndarray) -> np.ndarray:
    """0 below low, 1 above high, and a cubic with level ends in between."""
    t = np.clip((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def spread_of(a: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a square around each place."""
    mean = box(a, radius)
    return mean, np.maximum(box(a * a, radius) - mean * mean, 0.0)


def guided(guide: np.ndarray, estimate: np.ndarray, radius: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of the gray guided filter, both smoothed once more; it reaches twice the radius."""
    mean_g, mean_e = box(guide, radius), box(estimate, radius)
    slope = (box(guide * estimate, radius) - mean_g * mean_e) / np.maximum(box(guide * guide, radius) - mean_g * mean_g + epsilon, 1e-7)
    return box(slope, radius), box(mean_e - slope * mean_g, radius)


def area_weights(n: int, m: int, start: int, stop: int) -> tuple[int, np.ndarray]:
    """(first, weights): how the places start..stop of n count in the mean values of m equal parts; weights[j - first, i - start]."""
    i = np.arange(start, stop)
    first, last = start * m // n, min(m, -(-stop * m // n))
    j = np.arange(first, last)[:, None]
    shared = np.minimum((i + 1) * m, (j + 1) * n) - np.maximum(i * m, j * n)
    return first, np.maximum(shared, 0) / n


def stretched(part: np.ndarray, first: int, m: int, n: int, start: int, stop: int, axis: int) -> np.ndarray:
    """Places start..stop of n of an axis that is enlarged linearly from m to n places; part holds the places of m from first on."""
    at = np.clip((np.arange(start, stop) + 0.5) * m / n - 0.5, 0, m - 1)
    lo = np.floor(at).astype(int)
    f = (at - lo).reshape([-1 if k == axis else 1 for k in range(part.ndim)])
    return np.take(part, lo - first, axis) * (1 - f) + np.take(part, np.minimum(lo + 1, m - 1) - first, axis) * f


def stretch_needs(m: int, n: int, start: int, stop: int) -> tuple[int, int]:
    """The places of m that ``stretched`` reads."""
    lo = np.floor(np.clip((np.array([start, stop - 1]) + 0.5) * m / n - 0.5, 0, m - 1)).astype(int)
    return int(lo[0]), int(min(lo[1] + 1, m - 1)) + 1
