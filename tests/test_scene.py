"""Views, regions, dust and retouching against brute force: numpy and plain loops over small scenes."""

import random

import numpy as np
import pytest

from rasterfold.functions.kernels import KERNELS
from rasterfold.operators import dust, refold, regions, retouch
from rasterfold.plans.scene_queries import SCENE_QUERIES

DIR = "/root/testdata/sf0.001"


def plane_rows(spark, planes, name="frame"):
    """Rows (name, y, x, v) of planes by key."""
    rows = [(k, y, x, float(v[y, x])) for k, v in planes.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, f"{name} int, y int, x int, v double")


def as_plane(rows, h, w, value="v"):
    out = np.full((h, w), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r[value]
    return out


# ---- brute force


def reflect(i, n):
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def shrunk(v):
    h, w = v.shape
    k = (1, 4, 6, 4, 1)
    once = np.array([[sum(k[t] * v[y, reflect(2 * o + t - 2, w)] for t in range(5)) / 16 for o in range((w + 1) // 2)] for y in range(h)])
    return np.array([[sum(k[t] * once[reflect(2 * o + t - 2, h), x] for t in range(5)) / 16 for x in range(once.shape[1])] for o in range((h + 1) // 2)])


def line_up(v, n):
    c = len(v)
    at = lambda i: v[reflect(i, c)]
    return np.array([0.125 * at(o // 2 - 1) + 0.75 * at(o // 2) + 0.125 * at(o // 2 + 1) if o % 2 == 0 else 0.5 * (at(o // 2) + at(o // 2 + 1)) for o in range(n)])


def grown(v, h, w):
    once = np.array([line_up(row, w) for row in v])
    return np.array([line_up(c, h) for c in once.T]).T


def grown_on_a_slope(v, h, w):
    pad = np.pad(v, 1, mode="edge")
    for _ in range(2):
        pad[0] = 2 * pad[1] - pad[min(2, len(pad) - 2)]
        pad[-1] = 2 * pad[-2] - pad[max(len(pad) - 3, 1)]
        pad = pad.T
    return grown(pad, 2 * pad.shape[0], 2 * pad.shape[1])[2 : h + 2, 2 : w + 2]


def back(v, wt, levels):
    h, w = v.shape
    edge = max(h, w)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y, x = (y - h / 2) / edge, (x - w / 2) / edge
    basis = [np.ones_like(v), x, y]
    m = {(i, j): wt * basis[i] * basis[j] for i in range(3) for j in range(3)} | {(i, 3): wt * basis[i] * v for i in range(3)}
    sizes = [(h, w)]
    for _ in range(levels):
        m = {k: shrunk(a) for k, a in m.items()}
        sizes.append(m[0, 0].shape)
    out = np.full(sizes[-1], np.nan)
    for j, i in np.ndindex(out.shape):
        if m[0, 0][j, i] < 1e-3:
            continue
        a = np.array([[m[p, q][j, i] for q in range(3)] for p in range(3)])
        at = np.array([1, (i * 2**levels - w / 2) / edge, (j * 2**levels - h / 2) / edge])
        try:
            out[j, i] = at @ np.linalg.solve(a, np.array([m[p, 3][j, i] for p in range(3)]))
        except np.linalg.LinAlgError:
            out[j, i] = m[0, 3][j, i] / m[0, 0][j, i]
    while np.isnan(out).any() and not np.isnan(out).all():
        was = out.copy()
        for j, i in zip(*np.nonzero(np.isnan(was))):
            near = [was[p, q] for p, q in ((j, i - 1), (j, i + 1), (j - 1, i), (j + 1, i)) if 0 <= p < out.shape[0] and 0 <= q < out.shape[1] and not np.isnan(was[p, q])]
            if near:
                out[j, i] = np.mean(near)
    out = np.where(np.isnan(out), 1.0, out)
    for h, w in reversed(sizes[:-1]):
        out = grown_on_a_slope(out, h, w)
    return out


def flood(mask):
    h, w = mask.shape
    label, n = np.zeros((h, w), int), 0
    for y, x in np.argwhere(mask):
        if not label[y, x]:
            n += 1
            label[y, x], todo = n, [(y, x)]
            while todo:
                a, b = todo.pop()
                for i in range(max(a - 1, 0), min(a + 2, h)):
                    for j in range(max(b - 1, 0), min(b + 2, w)):
                        if mask[i, j] and not label[i, j]:
                            label[i, j] = n
                            todo.append((i, j))
    return label


def filled(v, wt):
    nums, dens = [v * wt], [wt]
    while max(nums[-1].shape) > 1:
        nums.append(shrunk(nums[-1]))
        dens.append(shrunk(dens[-1]))
    f = np.where(dens[-1] > 1e-9, nums[-1] / np.maximum(dens[-1], 1e-300), 0.0)
    for n, d in zip(nums[-2::-1], dens[-2::-1]):
        share = np.clip(d, 0, 1)
        up = grown(f, *n.shape)
        f = np.where(d > 1e-9, share * n / np.maximum(d, 1e-300) + (1 - share) * up, up)
    return f


def spots_of(luma, s):
    """Spots in order, each with its window, mask and gain; and the number of blobs too wide."""
    h, w = luma.shape
    half = shrunk(luma)
    levels, size, a = 0, 1, half.shape
    while size < 16 and min((a[0] + 1) // 2, (a[1] + 1) // 2) >= 2:
        a, size, levels = ((a[0] + 1) // 2, (a[1] + 1) // 2), size * 2, levels + 1
    bg = back(half, np.ones_like(half), levels)
    dark = half / bg < 1 - s.threshold
    near = np.zeros_like(dark)
    for y, x in np.argwhere(dark):
        near[max(y - 2, 0) : y + 3, max(x - 2, 0) : x + 3] = True
    bg = back(half, 1.0 - near, levels)
    label = flood((bg > 1e-6) & (half / bg < 1 - s.threshold))
    out, wide = [], 0
    for k in range(1, label.max() + 1):
        at = np.argwhere(label == k)
        (y0, x0), (y1, x1) = at.min(0), at.max(0)
        if len(at) * 4 < s.min_area:
            continue
        if max(y1 - y0, x1 - x0) * 4 + 4 > min(half.shape):
            wide += 1
            continue
        mask, m = np.zeros((h, w), bool), s.margin
        for y, x in at:
            mask[max(2 * y - m, 0) : 2 * y + 2 + m, max(2 * x - m, 0) : 2 * x + 2 + m] = True
        window = max(2 * x0 - m, 0), max(2 * y0 - m, 0), min(2 * x1 + 2 + m, w), min(2 * y1 + 2 + m, h)
        out.append((-4 * len(at), k, window, mask))
    ratio = np.where((half > 1e-6) & (bg > half), np.minimum(bg / np.maximum(half, 1e-6), 10), 1.0)
    gain = np.array([[np.mean([ratio[min((y + i) // 2, half.shape[0] - 1), min((x + j) // 2, half.shape[1] - 1)] for i in (0, 1) for j in (0, 1)]) for x in range(w)] for y in range(h)])
    return sorted(out, key=lambda o: o[:2]), gain, wide


def fill_in_turn(v, spots):
    """Each spot after the other, as one goes through a list: what an earlier one wrote is there for the next."""
    v = v.copy()
    h, w = v.shape
    every = np.zeros((h, w), bool)
    for *_, mask in spots:
        every |= mask
    for _, _, (x0, y0, x1, y1), mask in spots:
        pad = max(max(x1 - x0, y1 - y0) // 2, 6)
        a, b = slice(max(y0 - pad, 0), min(y1 + pad, h)), slice(max(x0 - pad, 0), min(x1 + pad, w))
        v[a, b] = np.where(mask[a, b], filled(v[a, b], 1.0 - every[a, b]), v[a, b])
    return v


# ---- dust


def map_frame(h, w, spots, slope=0.0):
    y, x = np.mgrid[0:h, 0:w].astype(float)
    v = (0.9 - 0.02 * ((x / w - 0.5) ** 2 + (y / h - 0.5) ** 2)) * (1 - slope * x / w)
    for cx, cy, r, depth in spots:
        d = np.hypot(x - cx, y - cy) / r
        v *= np.where(d < 1, 1 - depth * (1 - np.minimum(d, 1) ** 2) ** 2, 1.0)
    return v


@pytest.fixture(scope="module")
def maps():
    h, w = 60, 81
    return {0: map_frame(h, w, [(20, 18, 5, 0.4), (60, 40, 6, 0.25), (33, 44, 4, 0.4)]), 1: map_frame(h, w, []), 2: map_frame(h, w, [(40, 30, 16, 0.5)]), 3: map_frame(h, w, [(72, 30, 4, 0.4)], 0.4), 4: map_frame(h, w, [(20, 18, 4, 0.5), (33, 18, 4, 0.4), (26, 29, 3.5, 0.5)])}


@pytest.fixture(scope="module")
def found(spark, maps):
    s = dust.DustSettings()
    return dust.detect(plane_rows(spark, maps), *maps[0].shape, s, ["frame"]), {k: spots_of(v, s) for k, v in maps.items()}


def test_spots_are_those_of_the_definition(maps, found):
    got, want = found
    rows = {(r["frame"], r["spot"]): r for r in got.spots.collect()}
    pixels = {}
    for r in got.pixels.collect():
        pixels.setdefault((r["frame"], r["spot"]), {})[r["y"], r["x"]] = r["gain"]
    wide = {r["frame"]: r["rejected"] for r in got.rejected.collect()}
    assert len(want[0][0]) >= 2 and not want[1][0] and want[2][2] == 1 and len(want[3][0]) == 1
    for k, (spots, gain, rejected) in want.items():
        assert wide.get(k, 0) == rejected
        assert sum(f == k for f, _ in rows) == len(spots)
        for n, (area, _, (x0, y0, x1, y1), mask) in enumerate(spots, 1):
            r = rows[k, n]
            assert (r["x"], r["y"], r["w"], r["h"], r["area"]) == (x0, y0, x1 - x0, y1 - y0, -area)
            assert set(pixels[k, n]) == set(map(tuple, np.argwhere(mask)))
            assert all(abs(g - gain[at]) < 1e-9 for at, g in pixels[k, n].items())


def test_fills_at_once_are_fills_in_turn(spark, maps, found):
    """Spots 4 overlap, so later fills see earlier ones; all windows at once still give the same."""
    got, want = found
    h, w = maps[0].shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    scene = 0.3 + 0.3 * (np.sin(x / 9) * 0.5 + 0.5) + 0.2 * np.cos((x + y) / 13) * 0.3
    masks = [m for *_, m in want[4][0]]
    assert sum(m.astype(int) for m in masks).max() > 1
    frames = plane_rows(spark, {k: scene * maps[k] for k in maps})
    both = frames.selectExpr("frame", "0 shot", "y", "x", "v").unionByName(frames.selectExpr("frame", "1 shot", "y", "x", "1 - v v"))
    rows = dust.fill(both, got, ["v"], ["frame"], "shot").collect()
    assert len(rows) == both.count()
    for k in maps:
        for shot in (0, 1):
            v = scene * maps[k] if shot == 0 else 1 - scene * maps[k]
            mine = as_plane([r for r in rows if (r["frame"], r["shot"]) == (k, shot)], h, w)
            assert np.abs(mine - fill_in_turn(v, want[k][0])).max() < 1e-9


def test_flat_brings_the_scene_back(spark, maps, found):
    got, want = found
    h, w = maps[0].shape
    clean = map_frame(h, w, [])
    texture = 0.5 + 0.3 * np.sin(np.add.outer(np.arange(h), 2 * np.arange(w)) * 0.9)
    rows = dust.flatten(plane_rows(spark, {0: texture * maps[0] / clean}).withColumnRenamed("frame", "shot").selectExpr("0 frame", "*"), got, ["v"], ["frame"], "shot").collect()
    assert np.abs(as_plane(rows, h, w) - texture).max() < np.abs(texture * maps[0] / clean - texture).max() / 2
    gains = np.prod([np.where(m, want[0][1], 1.0) for *_, m in want[0][0]], axis=0)
    assert np.abs(as_plane(rows, h, w) - texture * maps[0] / clean * gains).max() < 1e-9


def test_report_says_what_was_found(found):
    got, want = found
    rows = {r["frame"]: r for r in dust.describe(got, ["frame"]).collect()}
    assert rows[2]["report"] == "no dust spots (1 blob wider than a quarter of the frame left out: not dust)"
    one = rows[3]
    assert one["report"].startswith("1 dust spot, ") and one["report"].endswith(f"{100 * one['covered'] / (60 * 81):.2f} % of the frame")
    assert 1 not in rows and rows[0]["spots"] == len(want[0][0])


def test_background_fills_cells_without_weight(spark):
    h, w = 40, 70
    y, x = np.mgrid[0:h, 0:w].astype(float)
    v, wt = 0.5 + x / 200 + y / 300, np.where((x < 52) & (y < 38), 0.0, 1.0)
    rows = plane_rows(spark, {0: v}).join(plane_rows(spark, {0: wt}).withColumnRenamed("v", "wt"), ["frame", "y", "x"])
    got = as_plane(dust.background(rows, h, w, 3, ["frame"]).collect(), h, w)
    assert np.abs(got - back(v, wt, 3)).max() < 1e-7
    none = rows.selectExpr("frame", "y", "x", "v", "0.0D wt")
    assert {r["v"] for r in dust.background(none, h, w, 3, ["frame"]).collect()} == {1.0}


def test_a_map_without_keys_and_one_too_small(spark):
    v = map_frame(60, 81, [(20, 18, 5, 0.4)])
    got = dust.detect(plane_rows(spark, {0: v}).drop("frame"), 60, 81)
    assert got.spots.count() == 1 and dust.describe(got).first()["report"].startswith("1 dust spot, ")
    assert dust.detect(plane_rows(spark, {0: v[:3, :3]}).drop("frame"), 3, 3).spots.count() == 0
    near = dust.neighbours(got).collect()
    assert [(r["spot"], r["other_spot"]) for r in near] == [(1, 1)]


def test_fill_query_is_brute_force(spark):
    from rasterfold.operators.dust import DustSettings
    from rasterfold.plans.scene_queries import _dusty, _shot

    rows = SCENE_QUERIES["dust_fill"](spark, DIR).collect()
    planes, shots = {}, {}
    for r in _dusty(spark, DIR).collect():
        planes.setdefault(r["frame"], []).append(r)
    for r in _shot(spark, DIR).collect():
        shots.setdefault((r["frame"], r["shot"]), []).append(r)
    assert any(r["spot"] for r in rows)
    for k, own in planes.items():
        spots, *_ = spots_of(as_plane(own, 24, 32), DustSettings(0.1, 1, 8))
        for shot in (0, 1):
            got = as_plane([r for r in rows if (r["frame"], r["shot"]) == (k, shot)], 24, 32)
            assert np.abs(got - fill_in_turn(as_plane(shots[k, shot], 24, 32), spots)).max() < 1e-6


# ---- regions


def test_regions_are_those_of_a_flood(spark):
    rng = np.random.default_rng(1)
    snake = np.zeros((21, 150), int)
    snake[::2] = 1
    snake[1::4, -1] = 1
    snake[3::4, 0] = 1
    masks = {0: (rng.random((30, 200)) < 0.4).astype(int), 1: (rng.random((30, 200)) < 0.62).astype(int), 2: snake, 3: np.zeros((4, 4), int), 4: np.eye(9, dtype=int)}
    rows = plane_rows(spark, masks).withColumnRenamed("v", "mask")
    got = {}
    for r in regions.regions(rows, ["frame"]).collect():
        got.setdefault(r["frame"], {})[r["y"], r["x"]] = r["region"]
    assert 3 not in got
    for k, mask in masks.items():
        label = flood(mask)
        assert got.get(k, {}) == {tuple(map(int, at)): int(label[tuple(at)]) for at in np.argwhere(label)}


def test_windows_meet_once(spark):
    rng = random.Random(2)
    a = [(k % 3, k, rng.randrange(-40, 300), rng.randrange(-40, 300), rng.randrange(1, 200), rng.randrange(1, 90)) for k in range(120)]
    df = spark.createDataFrame(a, "frame int, n int, x int, y int, w int, h int")
    got = sorted((r["n"], r["other_n"]) for r in regions.windows_meeting(df, df, ["frame"]).collect())
    meet = lambda p, q: p[0] == q[0] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4] and p[3] < q[3] + q[5] and q[3] < p[3] + p[5]
    assert got == sorted((p[1], q[1]) for p in a for q in a if meet(p, q))


# ---- views


@pytest.mark.parametrize(("k", "kernel"), [(1, "spline4x4"), (1, "bilinear"), (2, ""), (5, "")])
def test_moved_frames(spark, k, kernel):
    rng = np.random.default_rng(3)
    h, w, n, views = 7, 23, 4, [-0.31, 0.0, 0.2]
    planes = {f: rng.random((h, w)) for f in range(n)}
    rows = refold.moved(plane_rows(spark, planes), views, n, h, w, k, ["v"], [], False, kernel).collect()
    oh, ow = -(-h // k), -(-w // k)
    assert len(rows) == len(views) * n * oh * ow
    got = {(r["view"], r["frame"], r["y"], r["x"]): r["v"] for r in rows}
    for view, s in enumerate(views):
        for f, v in planes.items():
            dx = -s * w * (f / (n - 1) - 0.5)
            for y in range(oh):
                for x in range(ow):
                    if k > 1:
                        at = [x * k + p - int(np.rint(dx)) for p in range(k) if np.rint(dx) or x * k + p < w]
                        want = np.mean([v[q, min(max(a, 0), w - 1)] for q in range(y * k, min(y * k + k, h)) for a in at])
                    else:
                        count, weights = KERNELS[kernel]
                        low = int(np.floor(x - dx))
                        want = sum(g * v[y, min(max(low - count // 2 + 1 + j, 0), w - 1)] for j, g in enumerate(weights(x - dx - low)))
                    assert abs(got[view, f, y, x] - want) < 1e-9


def test_refold_of_a_still_view_is_the_fold(spark):
    from rasterfold.operators.fuse import fuse

    rng = np.random.default_rng(4)
    rows = [(s, f, y, x, *map(float, rng.random(3))) for s in range(2) for f in range(3) for y in range(8) for x in range(10)]
    df = spark.createDataFrame(rows, "stack int, frame int, y int, x int, r double, g double, b double")
    got = {(r["stack"], r["y"], r["x"]): r for r in refold.refold(df, [0.0, 0.4], 3, 8, 10, 1, ["stack"], levels=1, rule="avg").filter("view = 0").collect()}
    want = fuse(df, 8, 10, 1, rule="avg", keys=["stack"])["image"].collect()
    assert len(got) == len(want) == 160
    for r in want:
        mine = got[r["stack"], r["y"], r["x"]]
        assert mine["covered"] == 3 and all(abs(mine[c] - r[c]) < 1e-9 for c in "rgb")
    assert refold.proxy_area(3, 2, 24, 18, 4) == (1, 1, 5, 4) and refold.proxy_factor(5520, 8280, 690, 1035) == 8 and refold.proxy_factor(10, 10, 0, 0) == 1


# ---- retouching


def walk(log):
    slots, place, top = [], 0, 0
    for action, stroke in log:
        if action == "stroke":
            slots[place:] = [stroke]
            place = top = place + 1
        elif action == "undo":
            place = max(place - 1, 0)
        else:
            place = min(place + 1, top)
    return slots[:place], place, top - place


def test_history_is_a_stack_of_strokes(spark):
    rng = random.Random(5)
    logs = {k: [(rng.choices(retouch.ACTIONS, (3, 3 + k % 4, 2))[0], n) for n in range(rng.choice([1, 5, 60]))] for k in range(40)}
    logs[90], logs[91] = [("undo", 0)] * 4, [("stroke", 0), ("undo", 1), ("undo", 2), ("redo", 3), ("redo", 4), ("undo", 5), ("stroke", 6), ("redo", 7)]
    df = spark.createDataFrame([(k, n, a, s) for k, log in logs.items() for n, (a, s) in enumerate(log)], "list int, seq int, action string, stroke int")
    for upto in (None, 30):
        live = {}
        for r in retouch.live_strokes(df, ["list"], upto).collect():
            live.setdefault(r["list"], {})[r["slot"]] = r["stroke"]
        counts = {r["list"]: (r["undos"], r["redos"]) for r in retouch.depths(df, ["list"], upto).collect()}
        for k, log in logs.items():
            strokes, undos, redos = walk(log if upto is None else log[: upto + 1])
            assert [live.get(k, {})[s] for s in sorted(live.get(k, {}))] == strokes and sorted(live.get(k, {})) == list(range(1, len(strokes) + 1))
            assert counts[k] == (undos, redos)


def test_replay_blends_dab_after_dab(spark):
    h, w = 70, 90
    rng = np.random.default_rng(6)
    t, s = rng.integers(0, 65536, (h, w)), rng.integers(0, 65536, (h, w))
    dabs = [(0, 0, 64.0, 63.0, 9.0, 0.5), (0, 1, 66.0, 60.0, 4.0, 0.0), (1, 0, -2.0, 3.0, 6.0, 1.0), (2, 0, 10.0, 10.0, 0.1, 0.3), (3, 0, 50.0, 50.0, 40.0, 0.2)]
    table = spark.createDataFrame(dabs, "stroke int, seq int, dx double, dy double, r double, hard double")
    long = lambda v: spark.createDataFrame([(y, x, int(v[y, x])) for y in range(h) for x in range(w)], "y int, x int, v long")
    got = as_plane(retouch.replay(long(t), long(s), table, 2).collect(), h, w)
    want = t.astype(float)
    for stroke, _, cx, cy, r, hard in dabs:
        if stroke > 2:
            continue
        r, hard = max(r, 0.5), min(max(hard, 0.0), 0.999)
        for y in range(h):
            for x in range(w):
                d = np.hypot(x - cx, y - cy) / r
                if d < 1:
                    u = max((d - hard) / (1 - hard), 0.0)
                    want[y, x] = np.floor(want[y, x] + (s[y, x] - want[y, x]) * (1 - u * u * (3 - 2 * u)) + 0.5)
    assert (got == want).all()
