"""Sequential solvers, one stack in one task: registration, depth smoothing.

A stack's planes fit one executor (tens of MB each); stacks are independent, so the work spreads over them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterfold.functions.kernels import KERNELS, burt_taps
from rasterfold.operators.geometry import Transform

FIELDS = ("xoff", "yoff", "scale", "rot", "aspect", "shear", "px", "py")
#: Which of FIELDS a model frees.
MODELS = {"similarity": (0, 1, 2, 3), "affine": (0, 1, 2, 3, 4, 5), "projective": (0, 1, 2, 3, 4, 5, 6, 7)}


def plane(table: pa.Table, name: str) -> np.ndarray:
    y, x = table["y"].to_numpy(), table["x"].to_numpy()
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
    out[y, x] = table[name].to_numpy(zero_copy_only=False)
    return out


def dense(taps: list, n: int) -> np.ndarray:
    m = np.zeros((max(o for o, _, _ in taps) + 1, n))
    for o, i, w in taps:
        m[o, i] += w
    return m


# ---- registration -----------------------------------------------------------------------------


def warped(img: np.ndarray, t: Transform, kernel: str = "spline4x4") -> tuple[np.ndarray, np.ndarray]:
    """The plane resampled through its transform, with clamped taps, and which pixels have their source inside of it."""
    h, w = img.shape
    count, weights = KERNELS[kernel]
    m = t.inverse(h, w)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    d = m[6] * x + m[7] * y + m[8]
    sx, sy = (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d
    ok = (sx >= 0) & (sx <= w - 1) & (sy >= 0) & (sy <= h - 1)
    lx, ly = np.floor(sx), np.floor(sy)
    of = weights if kernel in ("bilinear", "spline4x4") else np.vectorize(weights, otypes=[float] * count, signature=None)
    wx, wy = of(sx - lx), of(sy - ly)
    out = np.zeros_like(img)
    for j in range(count):
        row = np.clip(ly + (j - count // 2 + 1), 0, h - 1).astype(int)
        for i in range(count):
            out += wy[j] * wx[i] * img[row, np.clip(lx + (i - count // 2 + 1), 0, w - 1).astype(int)]
    return out, ok


def cost(ref: np.ndarray, img: np.ndarray, t: Transform) -> float:
    """Root mean square of the difference without its mean, over the overlap; 1e9 if that is under 16 pixels."""
    got, ok = warped(img, t)
    n = int(ok.sum())
    if n < 16:
        return 1e9
    d = (ref - got)[ok]
    return float(np.sqrt(max((d * d).mean() - d.mean() ** 2, 0.0)))


def nelder_mead(f, x0: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray, tol: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Reflection 1, expansion 2, contraction and shrinking 1/2, within the box.

    It stops when the values agree to 1e-4 (relative, from 1 up) and all points lie within tol of the best, or after `rounds`.
    """
    if not len(x0):
        return x0
    points = np.vstack([x0, np.clip(x0 + np.diag(step), lo, hi)])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= 1e-4 * (1 + abs(values[0])) and (np.abs(points[1:] - points[0]) <= tol).all():
            break
        middle, worst = points[:-1].mean(0), points[-1]

        def tried(far: float) -> tuple[np.ndarray, float]:
            at = np.clip(middle + far * (middle - worst), lo, hi)
            return at, f(at)

        at, v = tried(1.0)
        if v < values[0]:
            # The expansion goes on from the reflected point, which may lie on the box.
            beyond = np.clip(middle + 2.0 * (at - middle), lo, hi)
            bv = f(beyond)
            points[-1], values[-1] = (beyond, bv) if bv < v else (at, v)
        elif v < values[-2]:
            points[-1], values[-1] = at, v
        else:
            near, nv = tried(-0.5)
            if nv < values[-1]:
                points[-1], values[-1] = near, nv
            else:
                points[1:] = np.clip((points[1:] + points[0]) / 2, lo, hi)
                values[1:] = [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


# Half-widths of the search box a parameter (a tenth of the frame, of the scale, five degrees, a twentieth of the others).
SPAN = (0.10, 0.10, 0.10, math.radians(5), 0.05, 0.05, 0.05, 0.05)


def gains_of(h: int, w: int) -> np.ndarray:
    """Pixels that a point at the frame's edge moves, for a unit of each of FIELDS."""
    r = max(h, w) / 2
    return np.array([w, h, r, r, h / 2, h / 2, w / 4, h / 4])


def align_pair(ref: np.ndarray, img: np.ndarray, start: Transform, free: tuple[int, ...], coarsen: int = 0) -> Transform:
    """Coarse to fine over the registration pyramid (halved while it is over 64 high and over 8 wide), stopping `coarsen` levels short of full size.

    A level's simplex starts one of its pixels wide and stops at a tenth of one; the box is SPAN about the start.
    """
    levels = [(ref, img)]
    while levels[-1][0].shape[0] > 64 and levels[-1][0].shape[1] > 8:
        a, b = levels[-1]
        ty, tx = dense(burt_taps(a.shape[0]), a.shape[0]), dense(burt_taps(a.shape[1]), a.shape[1])
        levels.append((ty @ a @ tx.T, ty @ b @ tx.T))
    x = np.array([getattr(start, f) for f in FIELDS])
    index = list(free)
    lo, hi = x[index] - np.array(SPAN)[index], x[index] + np.array(SPAN)[index]
    for k in range(len(levels) - 1, min(coarsen, len(levels) - 1) - 1, -1):
        a, b = levels[k]

        def value(v: np.ndarray) -> float:
            at = x.copy()
            at[index] = v
            return cost(a, b, Transform(*at))

        pixel = 2.0**k / gains_of(*ref.shape)[index]
        x[index] = nelder_mead(value, x[index], lo, hi, pixel, 0.1 * pixel)
    return Transform(*x)


def align(luma: DataFrame, model: str = "similarity", coarsen: int = 0, fixed: tuple[str, ...] = ()) -> DataFrame:
    """stack, frame, xoff .. py, m: frames (stack, frame, y, x, v) registered in a chain, each to the one before as aligned; m is the inverse that warp() takes."""
    free = tuple(i for i in MODELS[model] if FIELDS[i] not in fixed)

    def run(group: pa.Table) -> pa.Table:
        frames = sorted(set(group["frame"].to_pylist()))
        at = group["frame"].to_numpy()
        ref, last, rows = None, Transform(), []
        for f in frames:
            img = plane(group.filter(pa.array(at == f)), "v")
            if ref is not None:
                last = align_pair(ref, img, last, free, coarsen)
            got, ok = warped(img, last)
            ref = np.where(ok, got, img)
            rows.append({"stack": group["stack"][0].as_py(), "frame": f, **{k: float(getattr(last, k)) for k in FIELDS}, "m": last.inverse(*img.shape)})
        return pa.Table.from_pylist(rows, pa.schema([("stack", pa.int64()), ("frame", pa.int32()), *[(k, pa.float64()) for k in FIELDS], ("m", pa.list_(pa.float64()))]))

    return luma.groupBy("stack").applyInArrow(run, "stack long, frame int, " + ", ".join(f"{k} double" for k in FIELDS) + ", m array<double>")


# ---- depth smoothing --------------------------------------------------------------------------


def _edges(guide: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(-np.abs(np.diff(guide, axis=1)) / sigma), np.exp(-np.abs(np.diff(guide, axis=0)) / sigma)


def _apply(u: np.ndarray, data: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    out = data * u
    d = ax * (u[:, :-1] - u[:, 1:])
    out[:, :-1] += d
    out[:, 1:] -= d
    d = ay * (u[:-1] - u[1:])
    out[:-1] += d
    out[1:] -= d
    return out


def _cycle(r: np.ndarray, data: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """A V-cycle: damped Jacobi, 2 x 2 aggregation, damped Jacobi."""
    diag = data.copy()
    diag[:, :-1] += ax
    diag[:, 1:] += ax
    diag[:-1] += ay
    diag[1:] += ay
    inv = 0.8 / np.maximum(diag, 1e-12)
    u = inv * r
    h, w = r.shape
    if min(h, w) < 4:
        for _ in range(32):
            u += inv * (r - _apply(u, data, ax, ay))
        return u
    u += inv * (r - _apply(u, data, ax, ay))
    H, W = (h + 1) // 2, (w + 1) // 2
    yi, xi = np.arange(h) // 2, np.arange(w) // 2

    def pooled(v: np.ndarray, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        np.add.at(out, (rows[:, None], cols[None, :]), v)
        return out

    res = pooled(r - _apply(u, data, ax, ay), yi, xi, (H, W))
    cx = pooled(ax[:, 1::2], yi, np.arange(ax[:, 1::2].shape[1]), (H, max(W - 1, 0)))
    cy = pooled(ay[1::2], np.arange(ay[1::2].shape[0]), xi, (max(H - 1, 0), W))
    u += _cycle(res, pooled(data, yi, xi, (H, W)), cx, cy)[yi[:, None], xi[None, :]]
    u += inv * (r - _apply(u, data, ax, ay))
    return u + inv * (r - _apply(u, data, ax, ay))


#: Weight of the data where there is no confidence at all.
LEAST_DATA = 1e-4


def _solve(d: np.ndarray, data: np.ndarray, guide: np.ndarray, lam: float, sigma: float, most: int) -> np.ndarray:
    """(data + lam L) u = data d, from the sweeps' result on, to a residual of 1e-5."""
    ax, ay = (lam * e for e in _edges(guide, sigma))
    u = sweeps(d, data, guide, lam, sigma)
    r = data * d - _apply(u, data, ax, ay)
    top = max(np.linalg.norm(data * d), 1e-30)
    z = _cycle(r, data, ax, ay)
    p, rz = z, float((r * z).sum())
    for _ in range(most):
        if np.linalg.norm(r) < 1e-5 * top:
            break
        q = _apply(p, data, ax, ay)
        steep = float((p * q).sum())
        if steep <= 0:
            break
        u = u + rz / steep * p
        r = r - rz / steep * q
        z = _cycle(r, data, ax, ay)
        new = float((r * z).sum())
        p, rz = z + new / rz * p, new
    return u


def wls(d: np.ndarray, conf: np.ndarray, guide: np.ndarray, lam: float, sigma: float, robust: float = 0.0, most: int = 200) -> np.ndarray:
    """Weighted least squares along the guide's edges by conjugate gradients with a V-cycle; one Huber step, solved anew, if robust > 0."""
    u = _solve(d, np.maximum(conf, 0) + LEAST_DATA, guide, lam, sigma, most)
    if robust > 0:
        u = _solve(d, np.maximum(conf, 0) * np.minimum(1.0, robust / np.maximum(np.abs(d - u), 1e-12)) + LEAST_DATA, guide, lam, sigma, most)
    return u


def _lines(f: np.ndarray, data: np.ndarray, edge: np.ndarray, strength: float) -> np.ndarray:
    """Each row of u with (data + strength L) u = data f, L along the row: elimination, then substitution, over all rows at once."""
    n = f.shape[1]
    side = np.pad(strength * edge, ((0, 0), (1, 1)))
    diag, rhs = data + side[:, :-1] + side[:, 1:], data * f
    c, u = np.zeros_like(f), np.zeros_like(f)
    for k in range(n):
        before = side[:, k]
        m = diag[:, k] - (before * c[:, k - 1] if k else 0)
        c[:, k] = side[:, k + 1] / m
        u[:, k] = (rhs[:, k] + (before * u[:, k - 1] if k else 0)) / m
    for k in range(n - 2, -1, -1):
        u[:, k] += c[:, k] * u[:, k + 1]
    return u


def sweeps(d: np.ndarray, data: np.ndarray, guide: np.ndarray, lam: float, sigma: float, passes: int = 3) -> np.ndarray:
    """The fast global smoother: rows, then columns, with falling strength. Only the first sweep weighs by data, so that holes are filled; later ones smooth what it made."""
    ex, ey = _edges(guide, sigma)
    u, ones = d, np.ones_like(d)
    for t in range(passes):
        strength = 1.5 * lam * 4 ** (passes - 1 - t) / (4**passes - 1)
        u = _lines(u, ones if t else data, ex, strength)
        u = _lines(u.T, ones.T, ey.T, strength).T
    return u


def smooth_depth(df: DataFrame, lam: float = 1.0, sigma: float = 0.1, robust: float = 0.0, method: str = "wls") -> DataFrame:
    """stack, y, x, depth, conf from stack, y, x, depth, conf, guide."""

    def run(group: pa.Table) -> pa.Table:
        d, c, g = (plane(group, n) for n in ("depth", "conf", "guide"))
        u = wls(d, c, g, lam, sigma, robust) if method == "wls" else sweeps(d, np.maximum(c, 0) + LEAST_DATA, g, lam, sigma)
        y, x = np.indices(d.shape)
        return pa.table({"stack": pa.array(np.full(d.size, group["stack"][0].as_py()), pa.int64()), "y": pa.array(y.ravel(), pa.int32()), "x": pa.array(x.ravel(), pa.int32()), "depth": u.ravel(), "conf": c.ravel()})

    return df.groupBy("stack").applyInArrow(run, "stack long, y int, x int, depth double, conf double")


# ---- report -----------------------------------------------------------------------------------


def report(t: Transform, h: int, w: int) -> str:
    """Shift in pixels, scale and turn; the other parameters only where they differ from none."""
    out = f"dx={t.xoff * w:+7.2f}px dy={t.yoff * h:+7.2f}px scale={t.scale:.5f} rot={math.degrees(t.rot):+.3f} deg"
    if t.aspect != 1 or t.shear != 0:
        out += f" aspect={t.aspect:.5f} shear={t.shear:+.5f}"
    if t.px != 0 or t.py != 0:
        out += f" persp={t.px:+.5f}/{t.py:+.5f}"
    return out
