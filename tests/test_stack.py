"""Depth from focus and the aligned stack against plain numpy."""

import numpy as np
import pytest

from rasterfold.functions.kernels import bilinear_taps, expand_taps, linear_taps
from rasterfold.operators import focus, run, solvers
from rasterfold.operators.geometry import Transform

RNG = np.random.default_rng(7)


def frame_rows(planes, *lead):
    return [(*lead, f, y, x, float(p[y, x])) for f, p in enumerate(planes) for y in range(p.shape[0]) for x in range(p.shape[1])]


def blurred(p, times=3):
    for _ in range(times):
        q = np.pad(p, 1, mode="reflect")
        p = sum(q[dy : dy + p.shape[0], dx : dx + p.shape[1]] for dy in range(3) for dx in range(3)) / 9
    return p


def scene(h=16, w=40, n=5):
    """A texture of which each frame shows one band sharply; frames have noise of their own, so that no two values of a profile tie."""
    sharp = RNG.random((h, w))
    soft, band = blurred(sharp), np.arange(w) * n // w
    return sharp, [np.where(band[None, :] == m, sharp, soft) + 0.02 * RNG.random((h, w)) for m in range(n)], band


def box(p, r):
    h, w = p.shape
    return np.array([[p[max(y - r, 0) : y + r + 1, max(x - r, 0) : x + r + 1].mean() for x in range(w)] for y in range(h)])


def coefficients(g, v, r, eps):
    a = (box(g * v, r) - box(g, r) * box(v, r)) / (box(g * g, r) - box(g, r) ** 2 + eps)
    return box(a, r), box(box(v, r) - a * box(g, r), r)


def blocks(p, k):
    h, w = p.shape
    return np.array([[p[y : y + k, x : x + k].mean() for x in range(0, w, k)] for y in range(0, h, k)])


def upsampled(p, h, w, k):
    def matrix(n, m):
        out = np.zeros((m, n))
        for o, i, t in bilinear_taps(n, m, k):
            out[o, i] += t
        return out

    return matrix(p.shape[0], h) @ p @ matrix(p.shape[1], w).T


def brute_depth(frames, fused, s):
    h, w = fused.shape
    k = 2**s.scale
    q, a, b = 3, s.measure[1], s.measure[2]
    offsets = [(dy, dx, dy * dy + dx * dx) for dy in range(-b, b + 1) for dx in range(-b, b + 1)]
    disk, ring = [(y, x) for y, x, d in offsets if d <= a * a], [(y, x) for y, x, d in offsets if a * a < d <= b * b]
    guide, volume = blocks(fused, k), []
    for f in frames:
        p = np.pad(f, q, mode="reflect")
        at = lambda y, x: p[q + y : q + y + h, q + x : q + x + w]
        m = blocks(np.abs(sum(at(*o) for o in disk) / len(disk) - sum(at(*o) for o in ring) / len(ring)), k)
        ca, cb = coefficients(guide, m, s.radius, s.eps)
        volume.append(np.maximum(ca * guide + cb, 0))
    v = np.array(volume)
    d, c, low = np.zeros(guide.shape), np.zeros(guide.shape), v.min(0)
    floor = np.sort(low.ravel()[::7])
    floor = floor[min(len(floor) // 2, len(floor) - 1)]
    for y, x in np.ndindex(*guide.shape):
        line = np.concatenate([[-1.0], v[:, y, x], [-1.0]])
        tops = sorted([(line[i], -(i - 1)) for i in range(1, len(line) - 1) if line[i] >= line[i - 1] and line[i] > line[i + 1]], reverse=True)
        c1, i = tops[0][0], -tops[0][1]
        l, r = line[i], line[i + 2]
        ll, lc, lr = (np.log(max(t, 1e-12)) for t in (l, c1, r))
        den = ll - 2 * lc + lr
        d[y, x] = i + (np.clip(0.5 * (ll - lr) / den, -0.5, 0.5) if l >= 0 and r >= 0 and c1 > 0 and den < 0 else 0)
        ratio = np.clip(1 - (tops[1][0] if len(tops) > 1 else 0) / c1, 0, 1)
        gate = np.clip((c1 - floor) / (s.gate * floor), 0, 1) if s.gate > 0 and floor > 0 else 1.0
        c[y, x] = np.clip(1 - v[:, y, x].mean() / c1, 0, 1) * ratio * gate
    if s.median:
        p = np.pad(d, 1, mode="reflect")
        d = np.median([p[dy : dy + d.shape[0], dx : dx + d.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
    some = np.sort(c.ravel()[::7])
    p90 = some[min(len(some) * 9 // 10, len(some) - 1)]
    c = np.minimum(c / p90, 1) if p90 > 1e-6 else c
    if s.strength > 0:
        d = dense(d, c, guide, s)
    ca, cb = coefficients(guide, d, s.up_radius, s.up_eps)
    full = upsampled(ca, h, w, k) * fused + upsampled(cb, h, w, k)
    return np.clip(full, 0, len(frames) - 1), upsampled(c, h, w, k)


def dense(d, conf, guide, s):
    """The least-squares problem and its Huber step by a dense solve."""
    h, w = d.shape
    n, lap = h * w, np.zeros((h * w, h * w))
    at = np.arange(n).reshape(h, w)
    for one, two in ((at[:, :-1].ravel(), at[:, 1:].ravel()), (at[:-1].ravel(), at[1:].ravel())):
        e = np.exp(-np.abs(guide.ravel()[one] - guide.ravel()[two]) / s.sigma)
        for i, j, t in zip(one, two, e):
            lap[[i, j], [i, j]] += t
            lap[[i, j], [j, i]] -= t

    def solve(data):
        return np.linalg.solve(np.diag(data.ravel()) + s.strength * lap, (data * d).ravel()).reshape(h, w)

    u = solve(np.maximum(conf, 0) + 1e-4)
    return solve(conf * np.minimum(1, s.robust / np.maximum(np.abs(d - u), 1e-12)) + 1e-4) if s.robust > 0 else u


@pytest.mark.parametrize("strength", [0.0, 3.0])
def test_depth_from_focus_equals_numpy(spark, strength):
    sharp, frames, band = scene()
    s = focus.DepthSettings(strength=strength, robust=0.4)
    f = spark.createDataFrame(frame_rows(frames, 5), "stack long, frame int, y int, x int, v double")
    g = spark.createDataFrame([(5, y, x, float(sharp[y, x])) for y, x in np.ndindex(*sharp.shape)], "stack long, y int, x int, v double")
    got = focus.depth_from_focus(f, g, *sharp.shape, s).collect()
    want, conf = brute_depth(frames, sharp, s)
    assert len(got) == sharp.size
    assert max(abs(r["depth"] - want[r["y"], r["x"]]) for r in got) < 2e-3
    assert max(abs(r["conf"] - conf[r["y"], r["x"]]) for r in got) < 1e-9
    assert np.median([abs(r["depth"] - band[r["x"]]) for r in got]) < 0.3
    assert focus.depth_from_focus(f.limit(0), g, *sharp.shape, s).isEmpty()


def test_sweeps_weigh_the_first_pass_only():
    d, data, guide = RNG.random((3, 6)), RNG.random((3, 6)), RNG.random((3, 6))
    lam, sigma, u = 2.0, 0.3, d
    def matrix(edge, strength, weight):
        lap = np.diag(weight + strength * (np.append(edge, 0) + np.insert(edge, 0, 0)))
        i = np.arange(len(edge))
        lap[i, i + 1] = lap[i + 1, i] = -strength * edge
        return lap

    for t in range(3):
        k = 1.5 * lam * 4 ** (2 - t) / 63
        ex, ey = np.exp(-np.abs(np.diff(guide, axis=1)) / sigma), np.exp(-np.abs(np.diff(guide, axis=0)) / sigma)
        weight = np.ones_like(d) if t else data
        u = np.array([np.linalg.solve(matrix(ex[r], k, weight[r]), weight[r] * u[r]) for r in range(3)])
        u = np.array([np.linalg.solve(matrix(ey[:, c], k, np.ones(3)), u[:, c]) for c in range(6)]).T
    assert np.abs(solvers.sweeps(d, data, guide, lam, sigma) - u).max() < 1e-12


def test_linear_expand_keeps_a_slope():
    for n in (1, 2, 3, 8, 11, 24):
        coarse = 3.0 - 2.0 * np.arange((n + 1) // 2)
        out = np.zeros(n)
        for o, i, t in linear_taps(n):
            out[o] += t * coarse[i]
        want = 3.0 - np.arange(n) if len(coarse) > 1 else np.full(n, 3.0)
        assert np.abs(out - want).max() < 1e-12
    assert linear_taps(24) != expand_taps(24)


def test_fuse_stack_undoes_shifts_and_dimming(spark):
    yy, xx = np.mgrid[0:40, 0:48]
    base = lambda dx: 0.5 + 0.2 * np.sin((xx + dx) / 3.1) * np.cos(yy / 2.7) + 0.1 * np.sin((xx + dx) / 7 + yy / 5)
    planes = [base(0), 0.8 * base(1.5), base(3.0)]
    rows = [(*r[:3], r[3], r[3], r[3]) for r in frame_rows(planes)]
    frames = spark.createDataFrame(rows, "frame int, y int, x int, r double, g double, b double")
    moves = spark.createDataFrame([(f, Transform(xoff=1.5 * f / 48).inverse(40, 48)) for f in range(3)], "frame int, m array<double>")
    out = run.fuse_stack(frames, 40, 48, moves, levels=1, rule="avg")
    area = out["area"].first()
    assert area["w"] < 48 and area["h"] <= 40
    image = out["image"].collect()
    assert len(image) == area["w"] * area["h"] == out["depth"].count()
    want = base(0)
    assert np.mean([abs(r["g"] - want[r["y"] + area["y"], r["x"] + area["x"]]) for r in image]) < 0.01
    assert run.fuse_stack(frames.limit(0), 40, 48, moves.limit(0), levels=1, rule="avg")["image"].isEmpty()
