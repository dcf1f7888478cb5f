"""Weights of linear operators along one axis, as (o, i, w) rows; their number follows the frame's edge, never the data."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable

Taps = list[tuple[int, int, float]]


def reflect(i: int, n: int) -> int:
    """Reflect-101 border."""
    while n > 1 and not 0 <= i < n:
        i = (n - 1) - abs((n - 1) - abs(i))
    return i if n > 1 else 0


def gather(rows: Iterable[tuple[int, int, float]]) -> Taps:
    total: dict[tuple[int, int], float] = defaultdict(float)
    for o, i, w in rows:
        total[o, i] += w
    return [(o, i, w) for (o, i), w in sorted(total.items()) if w]


def reduce_taps(n: int) -> Taps:
    return gather((o, reflect(2 * o + t - 2, n), w / 16) for o in range((n + 1) // 2) for t, w in enumerate((1, 4, 6, 4, 1)))


def expand_taps(n: int) -> Taps:
    coarse, rows = (n + 1) // 2, []
    for o in range(n):
        c = o // 2
        rows += [(o, reflect(c + d, coarse), w) for d, w in (((-1, 0.125), (0, 0.75), (1, 0.125)) if o % 2 == 0 else ((0, 0.5), (1, 0.5)))]
    return gather(rows)


def linear_taps(n: int) -> Taps:
    """EXPAND to n of samples that have one more at each end, twice the last less the one before it."""
    coarse = (n + 1) // 2
    near, far = min(1, coarse - 1), max(coarse - 2, 0)
    padded = [[(0, 2.0), (near, -1.0)], *[[(i, 1.0)] for i in range(coarse)], [(coarse - 1, 2.0), (far, -1.0)]]
    return gather((o - 2, i, w * v) for o, c, w in expand_taps(2 * coarse + 4) if 2 <= o < n + 2 for i, v in padded[c])


def binomial(r: int) -> list[float]:
    return [math.comb(2 * r, k) / 4**r for k in range(2 * r + 1)]


def window_taps(n: int, weights: list[float]) -> Taps:
    r = len(weights) // 2
    return gather((o, reflect(o + k - r, n), w) for o in range(n) for k, w in enumerate(weights))


def burt_taps(n: int, a: float = 0.33) -> Taps:
    """The registration pyramid: weights beyond the border are left out and the rest renormalised."""
    weights, rows = (0.25 - a / 2, 0.25, a, 0.25, 0.25 - a / 2), []
    for o in range((n + 1) // 2):
        inside = [(2 * o + t - 2, w) for t, w in enumerate(weights) if 0 <= 2 * o + t - 2 < n]
        total = sum(w for _, w in inside)
        rows += [(o, i, w / total) for i, w in inside]
    return gather(rows)


def bilinear_taps(coarse: int, n: int, k: int) -> Taps:
    """Samples stand at the centres of blocks of k."""
    rows = []
    for o in range(n):
        at = min(max((o + 0.5) / k - 0.5, 0.0), coarse - 1.0)
        i = min(int(at), coarse - 1)
        rows += [(o, i, 1 - (at - i)), (o, min(i + 1, coarse - 1), at - i)]
    return gather(rows)


def shrink_taps(n: int, m: int) -> Taps:
    """Boxes with whole-number borders, averaged."""
    rows = []
    for o in range(m):
        a, b = o * n // m, max((o + 1) * n // m, o * n // m + 1)
        rows += [(o, i, 1 / (b - a)) for i in range(a, b)]
    return gather(rows)


def _spline16(t: float) -> list[float]:
    return [((-1 / 3 * t + 4 / 5) * t - 7 / 15) * t, ((t - 9 / 5) * t - 1 / 5) * t + 1, ((6 / 5 - t) * t + 4 / 5) * t, ((1 / 3 * t - 1 / 5) * t - 2 / 15) * t]


def _spline36(d: float) -> float:
    x = abs(d)
    if x < 1:
        return ((13 / 11 * x - 453 / 209) * x - 3 / 209) * x + 1
    if x < 2:
        x -= 1
        return ((-6 / 11 * x + 270 / 209) * x - 156 / 209) * x
    x -= 2
    return ((1 / 11 * x - 45 / 209) * x + 26 / 209) * x if x < 1 else 0.0


def _keys(d: float, a: float = -0.5) -> float:
    x = abs(d)
    return ((a + 2) * x - (a + 3)) * x * x + 1 if x < 1 else ((a * x - 5 * a) * x + 8 * a) * x - 4 * a if x < 2 else 0.0


def _lanczos3(d: float) -> float:
    x = math.pi * abs(d)
    return 1.0 if x < 1e-12 else 3 * math.sin(x) * math.sin(x / 3) / (x * x) if abs(d) < 3 else 0.0


def _normal(w: list[float]) -> list[float]:
    return [x / sum(w) for x in w]


#: Kernel name -> (taps, function of the fraction t giving weights; the first tap is at floor - taps / 2 + 1).
KERNELS: dict[str, tuple[int, Callable[[float], list[float]]]] = {
    "nearest": (2, lambda t: [1.0, 0.0] if t < 0.5 else [0.0, 1.0]),
    "bilinear": (2, lambda t: [1 - t, t]),
    "bicubic": (4, lambda t: [_keys(t + 1 - k) for k in range(4)]),
    "spline4x4": (4, _spline16),
    "spline6x6": (6, lambda t: _normal([_spline36(t + 2 - k) for k in range(6)])),
    "lanczos3": (6, lambda t: _normal([_lanczos3(t + 2 - k) for k in range(6)])),
}


def resample_taps(n: int, m: int, kernel: str) -> Taps:
    """Resizing one axis from n to m samples; taps beyond the border are clamped to it."""
    count, weights = KERNELS[kernel]
    rows = []
    for o in range(m):
        at = (o + 0.5) * n / m - 0.5
        first = math.floor(at) - count // 2 + 1
        rows += [(o, min(max(first + k, 0), n - 1), w) for k, w in enumerate(weights(at - math.floor(at)))]
    return gather(rows)
